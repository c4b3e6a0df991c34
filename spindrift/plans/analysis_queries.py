"""From scores to the result table: whole analyses with resampled intervals, permutation tests, Holm and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks, similarity, text
from ..functions.probability import Z975
from ..operators import analysis
from ..operators.resampling import BOOTSTRAP_SEED, PRIMARY_SEED
from ..sources.store import stored
from .rank_queries import _UNITS_SQL, _corr, _units
from .tables import r6, table, turn_pairs
from .text_queries import _ROUGE_SQL

_RESULT = ("raw_rho", "partial_rho", "raw_low", "raw_high", "partial_low", "partial_high", "whole_low", "whole_high", "raw_fisher_low", "raw_fisher_high", "partial_fisher_low", "partial_fisher_high", "raw_one_p", "raw_two_p", "partial_one_p", "partial_two_p", "adjusted")
_COUNTS = ("n_total", "n_complete", "n_missing", "raw_valid", "partial_valid", "whole_valid")
_REPLICATES, _PERMUTATIONS = 20, 30
#: Bootstrap replicates and permutations of a primary analysis, as many as the reference makes.
_PRIMARY = 10_000, 100_000


def _told(rows):
    return rows.select("metric", "outcome", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS], *map(lambda c: r6(c).alias(c), _RESULT), "rejected", "decision", "category")


def resampled_analysis(spark, d):
    """Customers' prices and finished orders against their number of orders and their nation, balance held, within segments."""
    u = _units(spark, d).withColumn("price", F.when(F.col("c_custkey") % 11 != 0, F.col("price")))
    rows = analysis.analyzed(u, "c_custkey", "c_mktsegment", "balance", ["price", "done"], ["orders", "c_nationkey"], *_PRIMARY, ("price", "orders"), most=None)
    return _told(rows)


def score_and_analyze(spark, d):
    """Turns scored against the next ones, scores averaged by conversation, and these set against labels with length held, within languages."""
    pairs = turn_pairs(spark, d).select("conv_id", similarity.rouge(text.tokens(F.col("reference")), text.tokens(F.col("candidate"))).alias("x"))
    cells = pairs.select("conv_id", r6("x.rouge_1_f1").alias("rouge_1"), r6("x.rouge_2_f1").alias("rouge_2"))
    units = cells.groupBy("conv_id").agg(*[r6(F.avg(c)).alias(c) for c in ("rouge_1", "rouge_2")])
    outcomes = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("chars")).join(table(spark, d, "labels"), "doc_id", "left")
    rows = outcomes.join(units, F.col("doc_id") == F.col("conv_id"))
    return _told(analysis.analyzed(rows, "doc_id", "lang", "n_chars", ["rouge_1", "rouge_2"], ["quality", "toxic"], *_PRIMARY, ("rouge_1", "quality"), most=None))


def resampled_size_association(spark, d):
    """Customers' prices and balances against their number of orders, with resampled interval and permutation test."""
    rows = analysis.size_association(_units(spark, d), "c_custkey", "c_mktsegment", "orders", ["price", "balance"], _REPLICATES, _PERMUTATIONS)
    return rows.select("metric", "n", *[r6(c).alias(c) for c in ("rho", "fisher_low", "fisher_high", "boot_low", "boot_high", "one_p", "two_p")])


#: Seven figures of a customer and eight of their orders, as SQL for either engine.
_METADATA = {"balance": "c_acctbal", "nation": "c_nationkey", "region": "c_nationkey % 5", "segment": "length(c_mktsegment)", "shelf": "c_custkey % 7", "row": "c_custkey % 11", "side": "(c_custkey + c_nationkey) % 4"}
_FEATURES = {
    "orders": "count(*)", "mean_price": "round(avg(o_totalprice), 4)", "least_price": "min(o_totalprice)", "most_price": "max(o_totalprice)", "range": "round(max(o_totalprice) - min(o_totalprice), 4)",
    "finished": "round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6)", "urgent": "round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6)", "priorities": "count(DISTINCT o_orderpriority)",
}


def feature_grid(spark, d):
    """Seven figures of customers against eight of their orders: 56 rank correlations in one plan, with the strongest feature of each marked."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.expr(e).cast("double").alias(n) for n, e in _FEATURES.items()])
    u = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    long = lambda named, k, v: F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values()))).alias(k, v)
    rows = u.select("*", long({n: F.expr(e).cast("double") for n, e in _METADATA.items()}, "metadata", "x")).select("metadata", "x", *_FEATURES)
    rows = rows.select("metadata", "x", long({n: F.col(n) for n in _FEATURES}, "feature", "y"))
    grid = stored(ranks.spearman(rows, "x", "y", ["metadata", "feature"]), "grid").withColumn("rho", r6("rho"))
    top = ranks.strongest(grid, "feature", "rho", ["metadata"]).select(F.col("metadata").alias("m"), F.col("feature").alias("f"))
    told = grid.join(F.broadcast(top), (F.col("metadata") == F.col("m")) & (F.col("feature") == F.col("f")), "left")  # seven rows
    return told.select("metadata", "feature", "n", "rho", F.col("f").isNotNull().alias("strongest"))


QUERIES = {f.__name__: f for f in (resampled_analysis, score_and_analyze, resampled_size_association, feature_grid)}


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({chr(32).join(parts).replace(chr(32), ' || chr(124) || ')}), 1, 8) AS BIGINT)"


def _parts_sql(records: str, metrics: list[str], outcomes: list[str], replicates: int = _REPLICATES, permutations: int = _PERMUTATIONS) -> str:
    """Common tables of an analysis over ``records`` (unit, stratum, z, metrics..., outcomes...)."""
    pairs = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{o}' AS outcome, unit, stratum, CAST({m} AS DOUBLE) AS x, CAST({o} AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM rec WHERE {m} IS NOT NULL AND {o} IS NOT NULL AND z IS NOT NULL" for m in metrics for o in outcomes)
    rank = lambda by: ", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS r{c}" for c in "xyz")
    cors = f"count(*) AS n, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rz')} AS xz, {_corr('ry', 'rz')} AS yz"
    part = "CASE WHEN n >= 4 AND (1 - xz * xz) * (1 - yz * yz) > 0 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END"
    point = lambda rows, by: f"SELECT {by}, n, xy AS raw, {part} AS partial FROM (SELECT {by}, {cors} FROM (SELECT *, {rank(by)} FROM {rows}) GROUP BY {by})"
    pair, group = "metric, outcome", "metric, outcome, stratum"
    slope = lambda c: f"coalesce({c} / nullif(vz, 0), 0)"
    p_of = lambda s, o, kind: f"CASE WHEN first({o}) IS NOT NULL THEN (1 + count(*) FILTER ({s} >= {o} - {analysis.SLACK})) / {permutations + 1.0} END AS {kind}_one_p, CASE WHEN first({o}) IS NOT NULL THEN (1 + count(*) FILTER (abs({s}) >= abs({o}) - {analysis.SLACK})) / {permutations + 1.0} END AS {kind}_two_p"
    safe = lambda a, b: f"CASE WHEN sqrt({b}) > {analysis._TINY} THEN ({a}) / sqrt({b}) END"
    return f"""
WITH rec AS ({records}),
l AS ({pairs}),
i AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM l),
bd AS (SELECT {group}, r.range + 1 AS r, {_draw("'boot'", str(BOOTSTRAP_SEED), "stratum", "(r.range+1)", "i")} % n AS i FROM i, range({replicates}) r),
br AS (SELECT bd.metric, bd.outcome, bd.r, i.x, i.y, i.z FROM bd JOIN i USING ({group}, i)),
bp AS ({point("br", "metric, outcome, r")}),
b AS (SELECT {pair}, quantile_cont(raw, 0.025) AS raw_low, quantile_cont(raw, 0.975) AS raw_high, count(raw) AS raw_valid, quantile_cont(partial, 0.025) AS partial_low, quantile_cont(partial, 0.975) AS partial_high, count(partial) AS partial_valid FROM bp GROUP BY {pair}),
st AS (SELECT *, row_number() OVER (PARTITION BY {pair} ORDER BY stratum) - 1 AS j, count(*) OVER (PARTITION BY {pair}) AS n FROM (SELECT DISTINCT {group} FROM l)),
wd AS (SELECT {pair}, r.range + 1 AS r, {_draw("'whole'", str(BOOTSTRAP_SEED), "(r.range+1)", "j")} % n AS j FROM st, range({replicates}) r),
wr AS (SELECT wd.metric, wd.outcome, wd.r, l.x, l.y, l.z FROM wd JOIN st USING ({pair}, j) JOIN l ON l.metric = wd.metric AND l.outcome = wd.outcome AND l.stratum = st.stratum),
wp AS ({point("wr", "metric, outcome, r")}),
w AS (SELECT {pair}, quantile_cont(partial, 0.025) AS whole_low, quantile_cont(partial, 0.975) AS whole_high, count(partial) AS whole_valid FROM wp GROUP BY {pair}),
p0 AS ({point("l", pair)}),
rk AS (SELECT *, {rank(pair)} FROM l),
mo AS (SELECT {pair}, avg(rx) AS mx, avg(ry) AS my, avg(rz) AS mz, covar_pop(rx, rz) AS cxz, covar_pop(ry, rz) AS cyz, var_pop(rz) AS vz FROM rk GROUP BY {pair}),
re AS (SELECT {group}, unit, rx - mx AS px, ry - my AS py, rz - mz AS pz, rx - mx - {slope('cxz')} * (rz - mz) AS qx, ry - my - {slope('cyz')} * (rz - mz) AS qy, row_number() OVER (PARTITION BY {group} ORDER BY unit) AS i FROM rk JOIN mo USING ({pair})),
ob AS (SELECT *, {safe('pxy', 'spx * spy')} AS o_raw, CASE WHEN spz > {analysis._TINY} THEN {safe('qxy', 'sqx * sqy')} END AS o_partial FROM (SELECT {pair}, {", ".join(f"sum({c} * {c}) AS s{c}" for c in ("px", "py", "pz", "qx", "qy"))}, sum(px * py) AS pxy, sum(qx * qy) AS qxy FROM re GROUP BY {pair})),
sh AS (SELECT {group}, r, py, qy, row_number() OVER (PARTITION BY {group}, r ORDER BY k, unit) AS i FROM (SELECT *, r.range + 1 AS r, {_draw("'perm'", str(PRIMARY_SEED), "(r.range+1)", "unit")} AS k FROM re, range({permutations}) r)),
sm AS (SELECT {pair}, r, sum(re.px * sh.py) AS a, sum(re.qx * sh.qy) AS b, sum(re.pz * sh.qy) AS c FROM sh JOIN re USING ({group}, i) GROUP BY {pair}, r),
ss AS (SELECT {pair}, o_raw, o_partial, {safe('a', 'spx * spy')} AS s_raw, {safe('b', 'sqx * greatest(sqy - coalesce(c * c / nullif(spz, 0), 0), 0)')} AS s_partial FROM sm JOIN ob USING ({pair})),
pe AS (SELECT {pair}, {p_of('s_raw', 'o_raw', 'raw')}, {p_of('s_partial', 'o_partial', 'partial')} FROM ss GROUP BY {pair})"""


def _fisher(rho: str, sign: str, room: int) -> str:
    return f"CASE WHEN n > {room} AND abs({rho}) < 1 THEN tanh(atanh({rho}) {sign} {Z975} / sqrt(n - {room})) END"


def _analysis_sql(records: str, metrics: list[str], outcomes: list[str], primary: tuple[str, str], least: int = 45) -> str:
    plan = ", ".join(f"('{m}', '{o}')" for m in metrics for o in outcomes)
    out = ", ".join(f"round({c}, 6) AS {c}" for c in _RESULT)
    counts = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS)
    return f"""{_parts_sql(records, metrics, outcomes, *_PRIMARY)},
al AS (SELECT metric, outcome, (SELECT count(*) FROM rec) AS n_total, coalesce(n, 0) AS n_complete, (SELECT count(*) FROM rec) - coalesce(n, 0) AS n_missing, raw AS raw_rho, partial AS partial_rho, raw_low, raw_high, raw_valid, partial_low, partial_high, partial_valid, whole_low, whole_high, whole_valid,
       {_fisher('raw', '-', 3)} AS raw_fisher_low, {_fisher('raw', '+', 3)} AS raw_fisher_high, {_fisher('partial', '-', 4)} AS partial_fisher_low, {_fisher('partial', '+', 4)} AS partial_fisher_high, raw_one_p, raw_two_p, partial_one_p, partial_two_p
       FROM (VALUES {plan}) v(metric, outcome) LEFT JOIN p0 USING (metric, outcome) LEFT JOIN b USING (metric, outcome) LEFT JOIN w USING (metric, outcome) LEFT JOIN pe USING (metric, outcome)),
ho AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY outcome) - row_number() OVER (PARTITION BY outcome ORDER BY partial_two_p NULLS LAST, metric) + 1) * partial_two_p) AS h FROM al),
aj AS (SELECT *, CASE WHEN partial_two_p IS NOT NULL THEN max(h) OVER (PARTITION BY outcome ORDER BY partial_two_p NULLS LAST, metric ROWS UNBOUNDED PRECEDING) END AS adjusted FROM ho)
SELECT metric, outcome, {counts}, {out}, coalesce(adjusted <= 0.05, false) AS rejected,
       CASE WHEN metric = '{primary[0]}' AND outcome = '{primary[1]}' THEN CASE WHEN n_complete >= {least} AND coalesce(partial_rho >= 0.30 AND partial_low > 0 AND partial_one_p <= 0.05, false) THEN 'GO' ELSE 'NO-GO' END END AS decision,
       CASE WHEN metric = '{primary[0]}' AND outcome = '{primary[1]}' THEN CASE WHEN n_complete < {least} THEN 'technical_no_go_inconclusive_association' WHEN coalesce(partial_rho >= 0.30 AND partial_low > 0 AND partial_one_p <= 0.05, false) THEN 'empirical_gate_pass' ELSE 'empirical_fail_fast' END END AS category FROM aj"""


_CUSTOMERS = "SELECT c_custkey AS unit, c_mktsegment AS stratum, balance AS z, {} FROM " + _UNITS_SQL

ORACLE_SQL = {
    "resampled_analysis": _analysis_sql(_CUSTOMERS.format("CASE WHEN c_custkey % 11 <> 0 THEN price END AS price, done, orders, c_nationkey"), ["price", "done"], ["orders", "c_nationkey"], ("price", "orders")),
    "score_and_analyze": _analysis_sql(
        f"SELECT doc_id AS unit, lang AS stratum, n_chars AS z, rouge_1, rouge_2, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) JOIN (SELECT conv_id AS doc_id, round(avg(rouge_1), 6) AS rouge_1, round(avg(rouge_2), 6) AS rouge_2 FROM ({_ROUGE_SQL}) GROUP BY conv_id) USING (doc_id)",
        ["rouge_1", "rouge_2"], ["quality", "toxic"], ("rouge_1", "quality"),
    ),
    "resampled_size_association": f"""{_parts_sql(_CUSTOMERS.format("price, balance, orders").replace("balance AS z", "orders AS z"), ["price", "balance"], ["orders"])}
SELECT metric, n, round(raw, 6) AS rho, round({_fisher('raw', '-', 3)}, 6) AS fisher_low, round({_fisher('raw', '+', 3)}, 6) AS fisher_high, round(raw_low, 6) AS boot_low, round(raw_high, 6) AS boot_high, round(raw_one_p, 6) AS one_p, round(raw_two_p, 6) AS two_p
FROM p0 LEFT JOIN b USING (metric, outcome) LEFT JOIN pe USING (metric, outcome)""",
    "feature_grid": f"""
WITH u AS (SELECT {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _METADATA.items())}, o.* FROM customer JOIN (SELECT o_custkey, {", ".join(f"CAST({e} AS DOUBLE) AS f_{n}" for n, e in _FEATURES.items())} FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey),
l AS ({" UNION ALL ".join(f"SELECT '{m}' AS metadata, '{f}' AS feature, {m} AS x, f_{f} AS y FROM u" for m in _METADATA for f in _FEATURES)}),
r AS (SELECT metadata, feature, {", ".join(f"rank() OVER (PARTITION BY metadata, feature ORDER BY {c}) + (count(*) OVER (PARTITION BY metadata, feature, {c}) - 1) / 2.0 AS r{c}" for c in "xy")} FROM l),
g AS (SELECT metadata, feature, count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM r GROUP BY ALL)
SELECT metadata, feature, n, rho, coalesce(rho IS NOT NULL AND row_number() OVER (PARTITION BY metadata ORDER BY abs(rho) DESC NULLS LAST, feature) = 1, false) AS strongest FROM g""",
}
