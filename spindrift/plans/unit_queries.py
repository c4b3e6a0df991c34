"""Queries from evaluations to units: outcomes, descriptives, histograms, selection ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import aggregates as agg
from ..operators import selection as sel
from .tables import labelled, r6, table

_STATUSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _valid():
    return F.col("l_returnflag") != "R"


def ledger(spark, d):
    """Order lines as attempts 1, 2, ... of their order; line numbers repeat, so they are numbered anew."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("attempt", F.row_number().over(order).cast("long"))


def outcomes_by_source(spark, d):
    rows = agg.unit_outcomes(labelled(spark, d), "source", "n_chars", "quality")
    return rows.select("source", "n", r6("score_mean").alias("score_mean"), r6("score_sd").alias("score_sd"), r6("pass_mean").alias("pass_mean"), "pass_numerator", "pass_denominator")


def descriptive_by_event_type(spark, d):
    rows = agg.descriptive(table(spark, d, "events"), "value", ["event_type"])
    return rows.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "min", "max", "ci_low", "ci_high")])


def label_missingness(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = agg.missingness(docs, "quality", "lang")
    return rows.select("lang", F.col("is_total").cast("long").alias("is_total"), "total", "observed", "missing", r6("missing_fraction").alias("missing_fraction"))


def observed_against_missing(spark, d):
    """Length of documents with and without a label."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("observed", F.col("quality").isNotNull())
    rows = agg.descriptive(docs, "n_chars", ["observed"])
    return rows.select("observed", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("sd").alias("sd"))


def language_counts(spark, d):
    return agg.value_counts(table(spark, d, "documents"), "lang")


def valid_run_distribution(spark, d):
    return agg.count_distribution(table(spark, d, "lineitem").filter(_valid()), "l_orderkey")


def unit_mean_over_runs(spark, d):
    rows = agg.mean_over_runs(table(spark, d, "lineitem").filter(_valid()), "l_orderkey", "l_linenumber", ["l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "valid_run_count", F.array_join(F.transform("valid_runs", lambda x: x.cast("string")), ",").alias("valid_runs"), r6("l_quantity_mean").alias("quantity"), F.round("l_extendedprice_mean", 4).alias("price"))


def attempt_histogram(spark, d):
    """Attempts per unit, 1 to 10 with zeros, by origin."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("attempts"), F.max("l_linestatus").alias("origin"))
    return agg.zero_filled_histogram(rows, "attempts", range(1, 11), "origin").select("origin", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"))


def order_status_pivot(spark, d):
    return agg.status_pivot(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", _STATUSES).withColumn("is_total", F.col("is_total").cast("long"))


def run_success_rates(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("planned"), F.count(F.when(_valid(), 1)).alias("valid"))
    return rows.withColumn("rate", r6(F.col("valid") / F.col("planned")))


def ranges_within_unit(spark, d):
    rows = agg.ranges_within_unit(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    told = rows.agg(F.count(F.lit(1)).alias("units"), r6(F.max("spread")).alias("largest"))
    return ranks.with_median(told, rows, "spread", []).withColumn("median", r6("median"))


def mean_vector_by_label(spark, d):
    """Mean embedding of each label, weighted by place in the label."""
    v = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1)
    return agg.weighted_mean_vector(v, ["label"], "embedding", "w").select("label", F.col("place").cast("long").alias("place"), r6("value").alias("value"))


def metric_summary(spark, d):
    rows = agg.long_summary(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rows.select("metric", *[r6(c).alias(c) for c in ("mean", "median", "sd", "min", "max")])


def exact_match_rate(spark, d):
    """Documents whose text equals that of a smaller id, in all and as a share."""
    t = table(spark, d, "documents").select("doc_id", "text")
    first = t.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    return first.agg(F.sum(F.col("n") - 1).alias("repeats"), r6(F.sum(F.col("n") - 1) / F.sum("n")).alias("rate"))


def group_participants(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("participants"))


def cohort_invariants(spark, d):
    return labelled(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("units"), F.count_distinct("source").alias("projects"), F.count_distinct("lang").alias("languages"))


def first_valid_selection(spark, d):
    rows = sel.first_valid(ledger(spark, d), ["l_orderkey"], "attempt", _valid())
    return rows.select("l_orderkey", "attempts", "selected_attempt")


def contiguous_attempts(spark, d):
    return sel.contiguous(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


def attempts_after_selection(spark, d):
    return sel.nothing_after_selection(ledger(spark, d), ["l_orderkey"], "attempt", _valid())


def schedule(spark, d):
    return sel.schedule(table(spark, d, "nation"), "n_name", 3).select(F.col("run_index").cast("long").alias("run_index"), "n_name", F.col("ordinal").cast("long").alias("ordinal"))


def attempt_chain(spark, d):
    return sel.hash_chain(ledger(spark, d), ["l_orderkey"], "attempt", "l_returnflag")


def run_barrier(spark, d):
    rows = sel.barrier(table(spark, d, "lineitem"), "l_linenumber", "l_orderkey", _valid())
    return rows.select(F.col("l_linenumber").cast("long").alias("run"), "selected_units", "units", F.col("open").alias("is_open"))


def primary_failure(spark, d):
    code = sel.primary_failure({"quantity": F.col("l_quantity") < 45, "discount": F.col("l_discount") < 0.09, "flag": _valid()})
    return table(spark, d, "lineitem").withColumn("code", code).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def eligibility(spark, d):
    """Checks of each order line from its columns, in order."""
    on = [F.col("l_quantity") > 1, F.col("l_extendedprice") > 1000, F.col("l_discount") >= 0, F.col("l_tax") < 0.08, _valid(), F.col("l_linestatus") == "F", F.col("l_quantity") < 50, F.col("l_discount") < 0.1, F.col("l_tax") >= 0]
    rows = table(spark, d, "lineitem").withColumn("checks", F.map_from_arrays(F.array(*map(F.lit, sel.CHECKS)), F.array(*on)))
    return sel.eligibility(rows).groupBy("eligible", "primary_check", "failure_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rejection_codes")).cast("long").alias("codes"))


def blocked_cells(spark, d):
    rows = table(spark, d, "lineitem").withColumn("reason", F.when(F.col("l_discount") > 0.08, "java_infrastructure").when(F.col("l_tax") > 0.06, "provenance"))
    return sel.blocked(rows, ["l_orderkey"], "l_linenumber", _valid(), "reason", 3, ["provenance", "java_infrastructure"]).select("l_orderkey", F.col("last_attempt").cast("long").alias("last_attempt"), "block_reason")


QUERIES = {f.__name__: f for f in (outcomes_by_source, descriptive_by_event_type, label_missingness, observed_against_missing, language_counts, valid_run_distribution, unit_mean_over_runs, attempt_histogram, order_status_pivot, run_success_rates, ranges_within_unit, mean_vector_by_label, metric_summary, exact_match_rate, group_participants, cohort_invariants, first_valid_selection, contiguous_attempts, attempts_after_selection, schedule, attempt_chain, run_barrier, primary_failure, eligibility, blocked_cells)}

_CHECKS_SQL = ["l_quantity > 1", "l_extendedprice > 1000", "l_discount >= 0", "l_tax < 0.08", "l_returnflag <> 'R'", "l_linestatus = 'F'", "l_quantity < 50", "l_discount < 0.1", "l_tax >= 0"]

_LEDGER_SQL = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt FROM lineitem)"

ORACLE_SQL = {
    "outcomes_by_source": "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS score_mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS score_sd, round(avg(quality), 6) AS pass_mean, CAST(sum(quality) AS BIGINT) AS pass_numerator, count(quality) AS pass_denominator FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "descriptive_by_event_type": "WITH a AS (SELECT event_type, count(value) AS n, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY event_type) SELECT event_type, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max, round(mean - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 6) AS ci_high FROM a",
    "label_missingness": "SELECT lang, CAST(grouping(lang) AS BIGINT) AS is_total, count(*) AS total, count(quality) AS observed, count(*) - count(quality) AS missing, round((count(*) - count(quality)) / count(*)::DOUBLE, 6) AS missing_fraction FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())",
    "observed_against_missing": "SELECT quality IS NOT NULL AS observed, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(coalesce(stddev_samp(n_chars), 0), 6) AS sd FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "language_counts": "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "valid_run_distribution": "SELECT rows_per_unit, count(*) AS units FROM (SELECT count(*) AS rows_per_unit FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) GROUP BY 1",
    "unit_mean_over_runs": "SELECT l_orderkey, count(*) AS valid_run_count, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS valid_runs, round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey",
    "attempt_histogram": "WITH u AS (SELECT l_orderkey, count(*) AS a, max(l_linestatus) AS origin FROM lineitem GROUP BY 1), g AS (SELECT DISTINCT origin, b.range AS bin FROM u, range(1, 11) b) SELECT g.origin, g.bin, count(u.a) AS n FROM g LEFT JOIN u ON u.origin = g.origin AND u.a = g.bin GROUP BY ALL",
    "order_status_pivot": "SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS BIGINT) AS is_total, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{s}') AS \"{s.lower().replace(' ', '_').replace('-', '_')}\"" for s in _STATUSES) + " FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())",
    "run_success_rates": "SELECT CAST(l_linenumber AS BIGINT) AS run, count(*) AS planned, count(*) FILTER (l_returnflag <> 'R') AS valid, round(count(*) FILTER (l_returnflag <> 'R') / count(*)::DOUBLE, 6) AS rate FROM lineitem GROUP BY 1",
    "ranges_within_unit": "SELECT count(*) AS units, round(max(s), 6) AS largest, round(median(s), 6) AS median FROM (SELECT max(l_quantity) - min(l_quantity) AS s FROM lineitem GROUP BY l_orderkey HAVING count(l_quantity) >= 2)",
    "mean_vector_by_label": "SELECT label, i - 1 AS place, round(sum(CAST(embedding[i] AS DOUBLE) * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 6) AS value FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i",
    "metric_summary": "SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE v) GROUP BY metric",
    "exact_match_rate": "SELECT CAST(sum(n - 1) AS BIGINT) AS repeats, round(sum(n - 1) / sum(n)::DOUBLE, 6) AS rate FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "group_participants": "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS participants FROM events GROUP BY event_type",
    "cohort_invariants": "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS units, count(DISTINCT source) AS projects, count(DISTINCT lang) AS languages FROM documents JOIN labels USING (doc_id)",
    "first_valid_selection": f"SELECT l_orderkey, count(*) AS attempts, CAST(min(attempt) FILTER (l_returnflag <> 'R') AS BIGINT) AS selected_attempt FROM {_LEDGER_SQL} GROUP BY 1",
    "contiguous_attempts": "SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1",
    "attempts_after_selection": f"WITH a AS (SELECT * FROM {_LEDGER_SQL}), f AS (SELECT l_orderkey, min(attempt) AS m FROM a WHERE l_returnflag <> 'R' GROUP BY 1) SELECT l_orderkey, count(*) AS late_attempts FROM a JOIN f USING (l_orderkey) WHERE attempt > m GROUP BY 1",
    "schedule": "SELECT r.range AS run_index, n_name, row_number() OVER (ORDER BY r.range, n_name) AS ordinal FROM nation, range(3) r",
    "attempt_chain": f"WITH RECURSIVE l AS (SELECT l_orderkey, attempt, l_orderkey || '|' || attempt || '|' || l_returnflag AS said FROM {_LEDGER_SQL}), c(l_orderkey, attempt, digest, previous_digest) AS (SELECT l_orderkey, attempt, sha256('|' || said), CAST(NULL AS VARCHAR) FROM l WHERE attempt = 1 UNION ALL SELECT l.l_orderkey, l.attempt, sha256(c.digest || '|' || l.said), c.digest FROM c JOIN l ON l.l_orderkey = c.l_orderkey AND l.attempt = c.attempt + 1) SELECT * FROM c",
    "run_barrier": "WITH u AS (SELECT count(DISTINCT l_orderkey) AS units FROM lineitem), r AS (SELECT l_linenumber, count(DISTINCT l_orderkey) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT CAST(l_linenumber AS BIGINT) AS run, s AS selected_units, units, coalesce(lag(s) OVER (ORDER BY l_linenumber) = units, true) AS is_open FROM r, u",
    "primary_failure": "SELECT CASE WHEN NOT l_quantity < 45 THEN 'quantity' WHEN NOT l_discount < 0.09 THEN 'discount' WHEN NOT l_returnflag <> 'R' THEN 'flag' END AS code, count(*) AS n FROM lineitem GROUP BY 1",
    "eligibility": "WITH c AS (SELECT " + " + ".join(f"CASE WHEN {c} THEN 0 ELSE 1 END" for c in [*_CHECKS_SQL[:5], " AND ".join(_CHECKS_SQL[:5]), *_CHECKS_SQL[6:]]) + " AS k, CASE " + " ".join(f"WHEN NOT ({_CHECKS_SQL[sel.CHECKS.index(n)]}) THEN '{n}'" for n in sel.REPORT_ORDER) + " END AS primary_check, CASE " + " ".join(f"WHEN NOT ({_CHECKS_SQL[sel.CHECKS.index(n)]}) THEN '{sel.FAILURES[n][1]}'" for n in sel.REPORT_ORDER) + " END AS failure_class FROM lineitem) SELECT k = 0 AS eligible, primary_check, failure_class, count(*) AS n, CAST(sum(k) AS BIGINT) AS codes FROM c GROUP BY ALL",
    "blocked_cells": "WITH r AS (SELECT l_orderkey, max(l_linenumber) AS last_attempt, count(*) FILTER (l_returnflag <> 'R') AS ok, min(CASE WHEN l_discount > 0.08 THEN 2 WHEN l_tax > 0.06 THEN 1 END) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(last_attempt AS BIGINT) AS last_attempt, CASE p WHEN 1 THEN 'provenance' WHEN 2 THEN 'java_infrastructure' ELSE 'attempt_cap_exhausted' END AS block_reason FROM r WHERE ok = 0 AND (p IS NOT NULL OR last_attempt >= 3)",
}
