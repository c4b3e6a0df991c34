"""From scores and outcomes to the result table in one plan: correlations, intervals, permutation tests, Holm, gate.

Resampling draws are counters: a number is a hash of (purpose, seed, replicate, row), so any task can make the draws of
any replicate, a replicate or a stratum is never one task's work, and any engine gets the same ones.  Rows are numbered
by ranges; a bootstrap draw is a row number, a permutation an order by hashed keys, ranked in buckets of equal hash
ranges of about ``BUCKET`` rows.  The small seeded versions with a sequential generator are in ``resampling``.  Groups of
at most ``replicates.MOST`` rows go whole to a task for each block of replicates, which makes the draws itself.

Rows are per pair (metric, outcome); those without the metric, the outcome or the control have no part in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..sources.store import stored
from . import replicates as blocks
from . import selection
from .numbering import counted
from .resampled import defined, weighted_correlations
from .resampling import BOOTSTRAP_SEED, PRIMARY_SEED, hashed_draw

PAIR = ["metric", "outcome"]
#: Rows of a bucket in which permuted rows are put in order.
BUCKET = 50_000
#: Replicates of a larger group that are made at once.
ROUND = 50
#: Differences of statistics that count as rounding.
SLACK = 1e-12
_TINY = 2.220446049250313e-16


def _joined(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """Null-safe join of ``left`` columns with ``right`` ones, whose own are dropped."""
    renamed = right.withColumnsRenamed({b: f"_j{i}" for i, b in enumerate(keys.values())})
    on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(renamed[f"_j{i}"]) for i, a in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"_j{i}" for i in range(len(keys))])


def long_records(df: DataFrame, unit: str, stratum: str, control: str, predictors: list[str], outcomes: list[str]) -> DataFrame:
    """(metric, outcome, unit, stratum, x, y, z) of complete rows, one for each pair; stored."""
    each = lambda names, k, v: F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias(k, v)
    base = df.select(F.col(unit).alias("unit"), F.col(stratum).alias("stratum"), F.col(control).cast("double").alias("z"), F.struct(*[F.col(c).cast("double").alias(c) for c in outcomes]).alias("_o"), each(predictors, "metric", "x"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col("_o")[c].alias("y")) for c in outcomes])).alias("p")
    rows = base.select("metric", "unit", "stratum", "x", "z", pairs).select("metric", "p.outcome", "unit", "stratum", "x", "p.y", "z")
    real = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in "xyz"]
    return stored(rows.filter(reduce(lambda a, b: a & b, real)), "records")


def correlations(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, raw, partial): rank correlation of x and y, and with z held; null where undefined."""
    ranked = ranks.with_ranks(rows, {f"r{c}": c for c in "xyz"}, by)
    plain = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ranks.correlation("rx", "ry").alias("raw"), ranks.correlation("rx", "rz").alias("xz"), ranks.correlation("ry", "rz").alias("yz"))
    return plain.select(*by, "n", "raw", F.when(F.col("n") >= 4, ranks.partial(F.col("raw"), F.col("xz"), F.col("yz"))).alias("partial"))


def bootstrap_weights(records: DataFrame, replicates: int, seed: int = BOOTSTRAP_SEED, first: int = 1) -> DataFrame:
    """``records`` with ``w``: how often each row is drawn in every replicate from ``first`` on, if each stratum's rows are drawn from itself, as many as it has; stored."""
    group = [*PAIR, "stratum"]
    numbered = counted(records, group, ["unit"], "i")
    sizes = numbered.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    draws = _joined(numbered.select(*group, "i"), sizes, {c: c for c in group}).withColumn("r", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))))
    pick = F.pmod(hashed_draw(F.lit("boot"), F.lit(seed), F.col("stratum"), F.col("r"), F.col("i")), F.col("n"))
    drawn = draws.select(*group, "r", pick.alias("pick")).groupBy(*group, "pick").agg(_times(replicates, first))
    return _weighed(numbered, drawn, {**{c: c for c in group}, "i": "pick"}, replicates)


def whole_bootstrap_weights(records: DataFrame, replicates: int, seed: int = BOOTSTRAP_SEED, first: int = 1) -> DataFrame:
    """``records`` with ``w``: how often each row is drawn in every replicate from ``first`` on, if strata are drawn from all strata, each with all of its rows."""
    strata = counted(records.select(*PAIR, "stratum").distinct(), PAIR, ["stratum"], "j")
    sizes = strata.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    slots = _joined(strata.select(*PAIR, "j"), sizes, {c: c for c in PAIR}).withColumn("r", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))))
    pick = F.pmod(hashed_draw(F.lit("whole"), F.lit(seed), F.col("r"), F.col("j")), F.col("n"))
    drawn = _joined(slots.select(*PAIR, "r", pick.alias("pick")), strata, {**{c: c for c in PAIR}, "pick": "j"})
    group = [*PAIR, "stratum"]
    return _weighed(records, drawn.groupBy(*group).agg(_times(replicates, first)), {c: c for c in group}, replicates)


def _times(replicates: int, first: int) -> Column:
    return F.array(*[F.count(F.when(F.col("r") == r, 1)).cast("int") for r in range(first, first + replicates)]).alias("w")


def _weighed(rows: DataFrame, drawn: DataFrame, on: dict[str, str], replicates: int) -> DataFrame:
    """``rows`` with the ``drawn`` weights, zeros where there are none; stored."""
    never = F.array(*[F.lit(0)] * replicates)
    return stored(_joined(rows, drawn, on, "left").select(*PAIR, "x", "y", "z", F.coalesce("w", never).alias("w")), "weighed")


def _halves(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups that a task can hold, those of larger groups (None if there are none), and how many groups there are at most."""
    sizes = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    groups, most = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if (most or 0) <= blocks.MOST:
        return rows, None, groups
    keys, large = {c: c for c in by}, sizes.filter(F.col("_n") > blocks.MOST)
    return _joined(rows, sizes.filter(F.col("_n") <= blocks.MOST), keys).select(rows.columns), _joined(rows, large, keys).select(rows.columns), groups


def resampled_correlations(records: DataFrame, replicates: int, whole: bool = False, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(metric, outcome, k, n, raw, partial) in replicate ``k`` + 1: rows are drawn within strata or, if ``whole``, whole strata."""
    small, large, pairs = _halves(records, PAIR)
    found = defined(blocks.resampled_sums(small, PAIR, max(pairs, 1), replicates, seed, whole), PAIR)
    weights = whole_bootstrap_weights if whole else bootstrap_weights
    for done in range(0, replicates if large is not None else 0, ROUND):
        width = min(ROUND, replicates - done)
        more = weighted_correlations(weights(large, width, seed, done + 1), PAIR, width)
        found = found.unionByName(stored(more.withColumn("k", F.col("k") + done), "round"))
    return found


def intervals(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(metric, outcome, <name>_low, <name>_high, <name>_valid) of replicates' ``raw`` and ``partial``: percentiles of the defined ones."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    wide = found.groupBy(*PAIR).agg(*[q(c).alias(f"q_{c}") for c in kinds], *[F.count(c).alias(f"{n}_valid") for c, n in kinds.items()])
    return wide.select(*PAIR, *[x for c, n in kinds.items() for x in (F.col(f"q_{c}")[0].alias(f"{n}_low"), F.col(f"q_{c}")[1].alias(f"{n}_high"), F.col(f"{n}_valid"))])


def permuted(rows: DataFrame, group: list[str], replicates: int, key: Column) -> DataFrame:
    """``rows`` in every replicate 1, 2, ... with ``r`` and ``place``: each group's rows, from 0, in order of ``key`` (a hashed draw) and unit."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    drawn = _joined(rows, sizes, {c: c for c in group}).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("_key", key)
    drawn = drawn.withColumn("_b", F.floor(F.col("_key") * F.ceil(F.col("_n") / BUCKET) / F.lit(float(1 << 32))))
    bucket = [*group, "r", "_b"]
    counts = drawn.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group, "r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    counts = counts.select(*bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("_key", "unit")) - 1
    placed = _joined(drawn.withColumn("_in", inside), counts, {c: c for c in bucket})
    return placed.select(*rows.columns, "r", (F.col("_before") + F.col("_in")).cast("long").alias("place"))


def permutation_tests(records: DataFrame, replicates: int, seed: int = PRIMARY_SEED) -> DataFrame:
    """(metric, outcome, raw_one_p, raw_two_p, partial_one_p, partial_two_p) by Freedman and Lane within strata.

    Residuals of the outcome's ranks are permuted.  As the predictor's residuals are orthogonal to the controls, a
    replicate's statistic needs two sums: of products with the predictor's residuals and with the control.
    """
    ranked = ranks.with_ranks(records, {f"r{c}": c for c in "xyz"}, PAIR)
    mean = lambda c: F.avg(c).alias(f"m{c}")
    sums = ranked.groupBy(*PAIR).agg(*[mean(f"r{c}") for c in "xyz"], F.covar_pop("rx", "rz").alias("cxz"), F.covar_pop("ry", "rz").alias("cyz"), F.var_pop("rz").alias("vz"))
    rows = _joined(ranked, sums, {c: c for c in PAIR})
    px, py, pz = (F.col(f"r{c}") - F.col(f"mr{c}") for c in "xyz")
    slope = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("vz")), F.lit(0.0))
    rows = rows.select(*PAIR, "stratum", "unit", px.alias("px"), py.alias("py"), pz.alias("pz"), (px - slope("cxz") * pz).alias("qx"), (py - slope("cyz") * pz).alias("qy"))
    rows = stored(rows, "residuals")
    square = lambda c: F.sum(F.col(c) * F.col(c)).alias(f"s{c}")
    whole = rows.groupBy(*PAIR).agg(*[square(c) for c in ("px", "py", "pz", "qx", "qy")], F.sum(F.col("px") * F.col("py")).alias("pxy"), F.sum(F.col("qx") * F.col("qy")).alias("qxy"))
    part = lambda num, below: F.when(F.sqrt(below) > _TINY, num / F.sqrt(below))
    observed = whole.withColumn("o_raw", part(F.col("pxy"), F.col("spx") * F.col("spy"))).withColumn("o_partial", F.when(F.col("spz") > _TINY, part(F.col("qxy"), F.col("sqx") * F.col("sqy"))))
    small, large, _ = _halves(rows, ["stratum"])
    drawn = blocks.permuted_sums(small, PAIR, replicates, seed)
    if large is not None:
        drawn = drawn.unionByName(_permuted_sums(large, replicates, seed)).groupBy(*PAIR, "r").agg(*[F.sum(c).alias(c) for c in "abc"])
    drawn = _joined(drawn, observed, {c: c for c in PAIR})
    rest = F.greatest(F.col("sqy") - F.coalesce(F.try_divide(F.col("c") * F.col("c"), F.col("spz")), F.lit(0.0)), F.lit(0.0))
    drawn = drawn.withColumn("s_raw", part(F.col("a"), F.col("spx") * F.col("spy"))).withColumn("s_partial", part(F.col("b"), F.col("sqx") * rest))
    told = []
    for kind in ("raw", "partial"):
        s, o = F.col(f"s_{kind}"), F.col(f"o_{kind}")
        for name, reached in (("one", s >= o - SLACK), ("two", F.abs(s) >= F.abs(o) - SLACK)):
            told.append(F.when(F.first(o).isNotNull(), (1 + F.count(F.when(reached, 1))) / (1 + replicates)).alias(f"{kind}_{name}_p"))
    return drawn.groupBy(*PAIR).agg(*told)


def _permuted_sums(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``replicates.permuted_sums`` for strata of any size: each row is shuffled once for every replicate, in rounds."""
    group = [*PAIR, "stratum"]
    numbered = counted(rows, group, ["unit"], "i")
    fixed, found = numbered.select(*group, "i", "px", "qx", "pz"), None
    for done in range(0, replicates, ROUND):
        key = hashed_draw(F.lit("perm"), F.lit(seed), F.col("r") + done, F.col("unit"))
        shuffled = permuted(numbered.select(*group, "unit", "py", "qy"), group, min(ROUND, replicates - done), key)
        sums = _joined(shuffled, fixed, {**{c: c for c in group}, "place": "i"}).groupBy(*PAIR, (F.col("r") + done).alias("r"))
        sums = stored(sums.agg(F.sum(F.col("px") * F.col("py")).alias("a"), F.sum(F.col("qx") * F.col("qy")).alias("b"), F.sum(F.col("pz") * F.col("qy")).alias("c")), "round")
        found = sums if found is None else found.unionByName(sums)
    return found


def analyzed(df: DataFrame, unit: str, stratum: str, control: str, predictors: list[str], outcomes: list[str], replicates: int, permutations: int, primary: tuple[str, str] | None = None, least: int = 45, most: int | None = 50) -> DataFrame:
    """The result table: a row for each predictor and outcome.

    n_total, n_complete, n_missing; raw and partial correlation, each with Fisher's and a bootstrap interval and one- and
    two-sided permutation p-values; the partial one's interval over whole strata; Holm's adjustment of partial p-values
    over all predictors of an outcome (undefined ones keep their place); and for the ``primary`` pair the gate's decision,
    which counts complete units against ``least`` of ``most`` (any number of units if None).
    """
    records = long_records(df, unit, stratum, control, predictors, outcomes)
    plan = df.sparkSession.createDataFrame([(m, o) for m in predictors for o in outcomes], "metric string, outcome string")
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    out = plan.crossJoin(F.broadcast(total))  # one row
    points = correlations(records, PAIR).withColumnsRenamed({"raw": "raw_rho", "partial": "partial_rho", "n": "n_complete"})
    inside = intervals(resampled_correlations(records, replicates), {"raw": "raw", "partial": "partial"})
    whole = intervals(resampled_correlations(records, replicates, whole=True), {"partial": "whole"})
    for part in (points, inside, whole, permutation_tests(records, permutations)):
        out = _joined(out, stored(part, "part"), {c: c for c in PAIR}, "left")
    (low, high), (plow, phigh) = ranks.fisher_interval(F.col("raw_rho"), F.col("n_complete")), ranks.fisher_interval(F.col("partial_rho"), F.col("n_complete"), 1)
    out = out.withColumns({"raw_fisher_low": low, "raw_fisher_high": high, "partial_fisher_low": plow, "partial_fisher_high": phigh})
    out = out.withColumn("n_complete", F.coalesce("n_complete", F.lit(0))).withColumn("n_missing", F.col("n_total") - F.col("n_complete"))
    out = ranks.holm(out, "metric", "partial_two_p", ["outcome"])
    if primary is None:
        return out.withColumn("decision", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    is_primary = (F.col("metric") == primary[0]) & (F.col("outcome") == primary[1])
    gate = F.when(is_primary, selection.gate(F.col("n_complete"), F.col("n_total"), F.col("partial_rho"), F.col("partial_low"), F.col("partial_one_p"), F.col("n_total") if most is None else most, least))
    return out.withColumn("_g", gate).withColumn("decision", F.col("_g.decision")).withColumn("category", F.col("_g.category")).drop("_g")


def size_association(df: DataFrame, unit: str, stratum: str, size: str, predictors: list[str], replicates: int, permutations: int) -> DataFrame:
    """(metric, n, rho, Fisher's and bootstrap interval, p-values): each predictor against a size measure, with no control."""
    records = long_records(df, unit, stratum, size, predictors, [size])
    points = correlations(records, PAIR)
    inside = intervals(resampled_correlations(records, replicates), {"raw": "boot"})
    out = stored(points, "part")
    for part in (inside, permutation_tests(records, permutations)):
        out = _joined(out, stored(part, "part"), {c: c for c in PAIR}, "left")
    low, high = ranks.fisher_interval(F.col("raw"), F.col("n"))
    return out.select("metric", "n", F.col("raw").alias("rho"), low.alias("fisher_low"), high.alias("fisher_high"), "boot_low", "boot_high", F.col("raw_one_p").alias("one_p"), F.col("raw_two_p").alias("two_p"))

