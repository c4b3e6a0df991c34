"""Attempt ledgers: first valid attempt of a cell, order checks, schedules, chains and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import CohortError, require_none
from .numbering import counted

# The checks of an attempt, those that make it a terminal success, the order in which a
# failing one is reported, and the stage and class of each failure.
CHECKS = (
    "provider_extraction_completed", "extraction_contract_valid", "provider_regeneration_completed", "regeneration_contract_valid", "java_structurally_valid",
    "terminal_success", "cell_identity_valid", "artifact_hashes_valid", "request_reconstruction_valid",
)
TERMINAL = CHECKS[:5]
REPORT_ORDER = (
    "cell_identity_valid", "artifact_hashes_valid", "request_reconstruction_valid", "provider_extraction_completed", "extraction_contract_valid",
    "provider_regeneration_completed", "regeneration_contract_valid", "java_structurally_valid",
)
FAILURES = {
    "provider_extraction_completed": ("extraction_provider", "provider"), "extraction_contract_valid": ("extraction_contract", "contract"),
    "provider_regeneration_completed": ("regeneration_provider", "provider"), "regeneration_contract_valid": ("regeneration_contract", "contract"),
    "java_structurally_valid": ("java_structure", "structural"), "cell_identity_valid": ("identity", "provenance"),
    "artifact_hashes_valid": ("artifact_hashes", "provenance"), "request_reconstruction_valid": ("request_reconstruction", "provenance"),
}


def first_valid(df: DataFrame, cell: list[str], attempt: str, valid: Column) -> DataFrame:
    """Per cell: attempts, and the first valid one (null if none)."""
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(valid, F.col(attempt))).alias("selected_attempt"))


def contiguous(df: DataFrame, cell: list[str], attempt: str, start: int = 1) -> DataFrame:
    """Per cell, whether attempt numbers are start, start + 1, ... without gaps or repeats."""
    rows = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min(attempt).alias("lo"), F.max(attempt).alias("hi"))
    return rows.select(*cell, "n", ((F.col("lo") == start) & (F.col("hi") - start + 1 == F.col("n"))).alias("contiguous"))


def nothing_after_selection(df: DataFrame, cell: list[str], attempt: str, valid: Column) -> DataFrame:
    """Cells with attempts after the first valid one."""
    earlier = Window.partitionBy(*cell).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_done", F.max(valid.cast("int")).over(earlier)).filter("_done = 1").groupBy(*cell).agg(F.count(F.lit(1)).alias("late_attempts"))


def schedule(units: DataFrame, unit: str, runs: int) -> DataFrame:
    """Every unit in every run, numbered by (run, unit) from 1.

    Units are numbered by ranges, so no window spans all rows.
    """
    spark = units.sparkSession
    rows = units.select(unit).distinct()
    number = counted(rows, [], [unit], "_i").select(unit, F.col("_i") + 1)
    number = number.toDF(unit, "_i")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    grid = number.crossJoin(F.broadcast(spark.range(runs).select(F.col("id").cast("int").alias("run_index")))).crossJoin(F.broadcast(n))
    return grid.select("run_index", unit, (F.col("run_index") * F.col("_n") + F.col("_i")).alias("ordinal"))


def hash_chain(df: DataFrame, cell: list[str], attempt: str, *fields: str) -> DataFrame:
    """Each attempt with its digest and that of the attempt before it in the cell, which its own digest takes in.

    So a digest binds all attempts up to its own.  A cell's attempts are folded in order; their number has a cap.
    """
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in (*cell, attempt, *fields)])
    cells = df.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(F.col(attempt).alias("a"), own.alias("said")))).alias("_rows"))
    first = F.array().cast("array<struct<a:%s,digest:string,previous:string>>" % df.schema[attempt].dataType.simpleString())

    def link(chain: Column, row: Column) -> Column:
        before = F.try_element_at(chain, F.lit(-1))["digest"]
        return F.concat(chain, F.array(F.struct(row["a"].alias("a"), F.sha2(F.concat_ws("|", F.coalesce(before, F.lit("")), row["said"]), 256).alias("digest"), before.alias("previous"))))

    links = cells.select(*cell, F.explode(F.aggregate("_rows", first, link)).alias("_l"))
    return links.select(*cell, F.col("_l.a").alias(attempt), F.col("_l.digest").alias("digest"), F.col("_l.previous").alias("previous_digest"))


def fixed_cohort(df: DataFrame, unit: str, run: str, attempt: str, checks: str, rows: int | None = None, runs: dict | None = None, per_unit: dict | None = None) -> DataFrame:
    """The cells of a closed cohort, in (run, unit) order: all rows must be a first attempt with every check holding.

    ``rows``, ``runs`` (rows by run) and ``per_unit`` (units by their number of rows) are what there must be.
    """
    require_none(df.filter((F.col(attempt) != 1) | ~F.forall(F.map_values(F.col(checks)), lambda x: F.coalesce(x, F.lit(False)))), "cohort_cell_not_eligible")
    found = lambda key, by: {r[0]: r[1] for r in by.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  one row a run or number of runs
    if rows is not None and df.count() != rows:
        raise CohortError("cohort_row_count")
    if runs is not None and found(run, df) != runs:
        raise CohortError("cohort_run_counts")
    if per_unit is not None and found("n", df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))) != per_unit:
        raise CohortError("cohort_unit_distribution")
    return df.orderBy(run, unit)


def gate(valid: Column, total: Column, rho: Column, lower: Column, p: Column, most: int | Column = 50, least: int = 45) -> Column:
    """(decision, category) of a fail-fast conjunction: enough units are valid, and the estimate, its lower bound and its one-sided p-value pass.

    A total other than ``most``, a number of valid units out of range and a p-value outside [0, 1] are errors.
    """
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    sound = known(rho.cast("double")) & known(lower.cast("double")) & known(p.cast("double"))
    go = F.coalesce(sound & (rho >= 0.30) & (lower > 0) & (p <= 0.05), F.lit(False))
    error = (
        F.when(total != most, "gate_total_methods_not_50").when((valid < 0) | (valid > total), "gate_invalid_valid_count")
        .when((valid >= least) & known(p.cast("double")) & ~p.between(0, 1), "gate_invalid_p_value")
    )
    told = F.when(valid < least, F.struct(F.lit("NO-GO").alias("decision"), F.lit("technical_no_go_inconclusive_association").alias("category")))
    told = told.when(go, F.struct(F.lit("GO").alias("decision"), F.lit("empirical_gate_pass").alias("category")))
    told = told.otherwise(F.struct(F.lit("NO-GO").alias("decision"), F.lit("empirical_fail_fast").alias("category")))
    return F.when(error.isNotNull(), F.raise_error(error).cast("struct<decision:string,category:string>")).otherwise(told)


def barrier(df: DataFrame, run: str, unit: str, selected: Column) -> DataFrame:
    """Per run: selected units, and whether the run before had as many as there are units."""
    total = df.select(unit).distinct().agg(F.count(F.lit(1)).alias("units"))
    per_run = df.filter(selected).groupBy(run).agg(F.count_distinct(unit).alias("selected_units"))
    order = Window.orderBy(run)  # one row a run
    rows = per_run.crossJoin(F.broadcast(total))
    return rows.withColumn("open", F.coalesce(F.lag("selected_units").over(order) == F.col("units"), F.lit(True)))


def primary_failure(checks: dict[str, Column]) -> Column:
    """The first failing check in the given order; null if all hold."""
    return F.coalesce(*[F.when(~on, F.lit(name)) for name, on in checks.items()])


def eligibility(df: DataFrame, checks: str = "checks") -> DataFrame:
    """Adds ``terminal_success``, ``eligible`` (all nine hold), ``rejection_codes`` in check order, and the
    failure that is reported: ``primary_check`` with its stage and class.  A missing check fails."""
    holds = lambda k: F.coalesce(F.element_at(F.col(checks), k), F.lit(False))
    names = lambda xs: F.array(*map(F.lit, xs))
    rows = df.withColumn("terminal_success", F.forall(names(TERMINAL), holds))
    ok = lambda k: F.when(k == "terminal_success", F.col("terminal_success")).otherwise(holds(k))
    rows = rows.withColumn("rejection_codes", F.transform(F.filter(names(CHECKS), lambda k: ~ok(k)), lambda k: F.concat(F.lit("check_failed_"), k)))
    rows = rows.withColumn("eligible", F.size("rejection_codes") == 0).withColumn("primary_check", F.get(F.filter(names(REPORT_ORDER), lambda k: ~holds(k)), F.lit(0)))
    place = F.array_position(names(FAILURES), F.col("primary_check"))
    told = lambda i: F.when(place > 0, F.element_at(names(v[i] for v in FAILURES.values()), place.cast("int")))
    return rows.withColumn("failure_stage", told(0)).withColumn("failure_class", told(1))


def blocked(df: DataFrame, cell: list[str], attempt: str, valid: Column, reason: str, cap: int, priority: list[str]) -> DataFrame:
    """Cells without a valid attempt that reached the cap or have a blocking reason, with the reason of highest priority."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(reason))
    rows = df.groupBy(*cell).agg(F.max(attempt).alias("last_attempt"), F.max(valid.cast("int")).alias("any_valid"), F.min_by(reason, F.when(place > 0, place)).alias("blocking"))
    found = F.when(F.col("blocking").isNotNull(), F.col("blocking")).when(F.col("last_attempt") >= cap, F.lit("attempt_cap_exhausted"))
    return rows.filter("any_valid = 0").withColumn("block_reason", found).filter("block_reason IS NOT NULL").select(*cell, "last_attempt", "block_reason")
