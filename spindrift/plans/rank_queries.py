"""Rank correlations, multiplicity, resampling, paired tests and regression sensitivities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks, text
from ..operators import analysis, models, numbering, paired, resampling
from ..sources.store import stored
from .tables import labelled, r6, table


def partial_spearman_tokens_quality(spark, d):
    """Token count against quality, controlling for length in characters."""
    rows = labelled(spark, d).select(F.size(text.tokens(F.col("text"))).alias("n_tokens"), "quality", "n_chars")
    # three narrow columns, written once: ranks read them several times and texts aren't taken apart again
    return ranks.partial_spearman(stored(rows, "tokens"), "n_tokens", "quality", "n_chars").select("n", r6("rho").alias("rho"))


def average_rank(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ranks.with_ranks(rows, {"rank_in_segment": "c_acctbal"}, ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "rank_in_segment")


def _units(spark, d):
    """Customers with their orders: mean price, number of orders, segment and balance."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("orders"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("done"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("balance"), F.round("price", 4).alias("price"), "orders", r6("done").alias("done"))


_UNITS_SQL = "(SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal AS balance, round(price, 4) AS price, orders, round(done, 6) AS done FROM customer JOIN (SELECT o_custkey, avg(o_totalprice) AS price, count(*) AS orders, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS done FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"


def _ranked_sql(columns: dict[str, str], by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    ranked = ", ".join(f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}{c}) - 1) / 2.0 AS {n}" for n, c in columns.items())
    return f"SELECT {keys}{ranked} FROM "


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) * stddev_pop({y}) > 2.220446049250313e-16 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def raw_spearman(spark, d):
    rows = ranks.spearman(_units(spark, d), "price", "orders", ["c_mktsegment"])
    low, high = ranks.fisher_interval(F.col("rho"), F.col("n"))
    return rows.select("c_mktsegment", "n", r6("rho").alias("rho"), r6(low).alias("low"), r6(high).alias("high"))


def partial_spearman(spark, d):
    rows = ranks.partial_spearman(_units(spark, d), "price", "orders", "balance", ["c_mktsegment"])
    return rows.select("c_mktsegment", "n", r6("rho").alias("rho"))


def leave_one_group_out(spark, d):
    """The partial correlation without each segment in turn."""
    u = _units(spark, d)
    left = u.select(F.col("c_mktsegment").alias("omitted")).distinct()
    rows = u.join(F.broadcast(left), F.col("c_mktsegment") != F.col("omitted"))  # one row a segment
    return ranks.partial_spearman(rows, "price", "orders", "balance", ["omitted"]).select("omitted", "n", r6("rho").alias("rho"))


def _p_family(spark, d):
    """A family of p-like numbers: one an order priority and status, some missing."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("name")).agg(F.sum("o_custkey").alias("s"))
    return rows.select("family", "name", F.when(F.col("s") % 5 != 0, F.col("s") % 1000 / 20000.0).alias("p"))


def holm_family(spark, d):
    rows = ranks.holm(_p_family(spark, d), "name", "p", ["family"])
    return rows.select("family", "name", r6("p").alias("p"), r6("adjusted").alias("adjusted"), "rejected")


def boundary_sensitivity(spark, d):
    """Missing labels ranked below all or above all: correlation of length with quality either way."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    low = ranks.spearman(docs.withColumn("q", F.coalesce("quality", F.lit(-1))), "n_chars", "q").select(F.lit("minimum").alias("bound"), "n", r6("rho").alias("rho"))
    high = ranks.spearman(docs.withColumn("q", F.coalesce("quality", F.lit(2))), "n_chars", "q").select(F.lit("maximum").alias("bound"), "n", r6("rho").alias("rho"))
    return low.unionByName(high)


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("run")).agg(r6(F.avg("l_quantity")).alias("v"))


def run_stability(spark, d):
    rows = paired.run_pairs(_cells(spark, d), "l_orderkey", "run", "v")
    return rows.select("run_a", "run_b", "n", r6("rho").alias("rho"))


def icc_3_1(spark, d):
    return paired.icc_3_1(_cells(spark, d), "l_orderkey", "run", "v", list(range(1, 8))).select("n", F.col("k").cast("long").alias("k"), r6("icc").alias("icc"))


def outcome_agreement(spark, d):
    """Quality and toxicity by source: correlation of means and their differences."""
    m = labelled(spark, d).groupBy("source").agg(F.avg("quality").alias("au"), F.avg("toxic").alias("pbu"))
    m = m.select("source", r6("au").alias("au"), r6("pbu").alias("pbu"))
    rho = ranks.spearman(m, "au", "pbu").select("n", r6("rho").alias("rho"))
    diff = m.agg(r6(F.avg(F.col("pbu") - F.col("au"))).alias("mean_difference"), r6(F.median(F.col("pbu") - F.col("au"))).alias("median_difference"))
    return rho.crossJoin(F.broadcast(diff))  # one row each


def gate_decision(spark, d):
    """GO if enough units are valid and the estimate and its lower bound pass (the whole rule is ``selection.gate``)."""
    rows = ranks.spearman(_units(spark, d), "price", "orders", ["c_mktsegment"])
    low, _ = ranks.fisher_interval(F.col("rho"), F.col("n"))
    go = (F.col("n") >= 45) & (F.col("rho") >= 0.30) & (low > 0)
    return rows.select("c_mktsegment", "n", F.when(go, "GO").otherwise("NO_GO").alias("decision"))


def correlation_grid(spark, d):
    """Every customer figure against every order figure, as rows."""
    u = _units(spark, d)
    long = lambda names, k, v: F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias(k, v)
    rows = u.select("*", long(["balance", "c_nationkey"], "metadata", "x")).select("metadata", "x", "price", "orders", "done")
    rows = rows.select("metadata", "x", long(["price", "orders", "done"], "feature", "y"))
    return ranks.spearman(rows, "x", "y", ["metadata", "feature"]).select("metadata", "feature", "n", r6("rho").alias("rho"))


def hash_bootstrap_within_group(spark, d):
    """Percentile interval of the mean balance per segment, from 50 hashed resamples."""
    means = resampling.hash_bootstrap_means(table(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_acctbal", 50)
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("replicates"), F.round(q[0], 4).alias("low"), F.round(q[1], 4).alias("high"))


def hash_permutation_within_group(spark, d):
    """How many of 20 hashed permutations within segments reach the observed rank correlation."""
    u = _units(spark, d).select("c_custkey", "c_mktsegment", F.col("price").alias("x"), F.col("orders").cast("double").alias("y"))
    u = ranks.with_ranks(u, {"rx": "x", "ry": "y"}).select(F.col("c_custkey").alias("unit"), "c_mktsegment", "rx", "ry")
    fixed = numbering.counted(u, ["c_mktsegment"], ["unit"], "i")
    moved = analysis.permuted(fixed.select("c_mktsegment", "unit", F.col("ry").alias("drawn")), ["c_mktsegment"], 20, resampling.hashed_draw(F.col("r"), F.col("unit")))
    pairs = fixed.select("c_mktsegment", F.col("i").alias("place"), "rx").join(moved, ["c_mktsegment", "place"]).select("r", "rx", "drawn")
    pairs = pairs.unionByName(fixed.select(F.lit(0).alias("r"), "rx", F.col("ry").alias("drawn")))
    return pairs.groupBy(F.col("r").cast("long").alias("r")).agg(r6(ranks.correlation("rx", "drawn")).alias("rho"))


def auc_length_by_quality(spark, d):
    rows = ranks.auc(labelled(spark, d), "quality", "n_chars")
    return rows.select("n1", "n0", r6("auc").alias("auc"))


def point_biserial(spark, d):
    return labelled(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(ranks.correlation(F.col("toxic").cast("double"), F.col("n_chars").cast("double"))).alias("r"))


def wilcoxon_runs(spark, d):
    """First against second attempt's quantity, per line status."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), r6(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")))).alias("a"), r6(F.avg(F.when(F.col("l_linenumber") == 2, F.col("l_quantity")))).alias("b"))
    w = paired.wilcoxon(rows, "a", "b", ["status"])
    return w.select("status", "n", "zeros", r6("w_plus").alias("w_plus"), r6("tie_term").alias("tie_term"))


def wilcoxon_p(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_linenumber") == 2, F.col("l_quantity"))).alias("b"))
    return paired.wilcoxon(rows, "a", "b").select("n", r6("p").alias("p"))


def paired_summary(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), r6(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")))).alias("a"), r6(F.avg(F.when(F.col("l_linenumber") == 2, F.col("l_quantity")))).alias("b"))
    s = paired.paired_summary(rows, "a", "b", ["status"])
    return s.select("status", "n", *[r6(c).alias(c) for c in ("left_mean", "right_mean", "difference_mean", "difference_median", "difference_sd")], "positive", "zero", "negative")


def arm_separation(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), r6(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")))).alias("a"), r6(F.avg(F.when(F.col("l_linenumber") == 2, F.col("l_quantity")))).alias("b"))
    s = paired.arm_auc(rows, "a", "b", ["status"])
    return s.select("status", "n1", "n0", r6("auc").alias("auc"), r6("separation").alias("separation"), "higher")


def paired_contrast(spark, d):
    """Urgent against other orders' price, over all and within customers."""
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), "o_totalprice")
    s = paired.contrasts(rows, "o_custkey", "urgent", "o_totalprice")
    return s.select(*[F.round(c, 4).alias(c) for c in ("yes_mean", "no_mean", "difference", "pair_difference")], "pairs", "positive", "zero", "negative")


def quantiles(spark, d):
    q = ranks.quantiles(table(spark, d, "events"), "value", ["event_type"], [0.025, 0.5, 0.975])
    return q.select("event_type", r6("q0").alias("q025"), r6("q1").alias("q500"), r6("q2").alias("q975"))


def hc3_sensitivity(spark, d):
    u = _units(spark, d).withColumn("size", F.col("orders") + 1)
    return models.hc3_by(u, "c_mktsegment", "price", "done", "size").select("c_mktsegment", "n", *[r6(c).alias(c) for c in ("coefficient", "error", "low", "high")])


def _gee_inputs(spark, d):
    rows = labelled(spark, d).select(F.concat("lang", F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("participant"), F.when(F.col("lang") == "en", "professional").when(F.col("lang") == "de", "student").otherwise("other").alias("grp"), F.col("source").alias("unit"), F.col("quality").cast("int").alias("hits"))
    units = table(spark, d, "documents").groupBy(F.col("source").alias("unit")).agg(F.avg("n_chars").alias("predictor"), F.count(F.lit(1)).cast("double").alias("size"))
    return rows, units.withColumn("size", F.col("size") + F.length("unit") + F.ascii(F.substring("unit", -1, 1)) % 3)


def gee_sensitivity(spark, d):
    """Quality hits by language group as participants' groups; sources are units, languages by forty are participants."""
    rows, units = _gee_inputs(spark, d)
    r = models.gee_sensitivity(rows, units, 1)
    return r.select("model", "term", r6("estimate").alias("estimate"), r6("error").alias("error"), "n_rows", "n_clusters", "failure")


def gee_base_model(spark, d):
    """The base model alone, with its interval and p-value: SQL can follow three coefficients."""
    rows, units = _gee_inputs(spark, d)
    r = models.gee_sensitivity(rows.withColumn("grp", F.lit("other")), units, 1, 1e-10).filter("model = 'base'")
    return r.select("term", *[r6(c).alias(c) for c in ("estimate", "error", "low", "high", "p")], "n_rows", "n_clusters")


def seeded_associations(spark, d):
    """Raw and adjusted correlations with bootstrap intervals and permutation p-values, from fixed seeds."""
    m = labelled(spark, d).groupBy("source").agg(F.first("lang").alias("_l"), F.avg("n_chars").alias("length"), F.count(F.lit(1)).alias("rows_in_source"), F.avg("toxic").alias("toxic"), F.avg("quality").alias("quality"))
    m = m.withColumn("stratum", (F.length("source") % 2).cast("string"))
    r = resampling.associations(m, "source", "stratum", "rows_in_source", "quality", ["length", "toxic"], 200, 500)
    return r.select("metric", F.col("n").cast("long").alias("n"), *[r6(c).alias(c) for c in ("raw_rho", "partial_rho", "raw_low", "raw_high", "raw_p", "partial_p")])


QUERIES = {f.__name__: f for f in (partial_spearman_tokens_quality, average_rank, raw_spearman, partial_spearman, leave_one_group_out, holm_family, boundary_sensitivity, run_stability, icc_3_1, outcome_agreement, gate_decision, correlation_grid, hash_bootstrap_within_group, hash_permutation_within_group, auc_length_by_quality, point_biserial, wilcoxon_runs, wilcoxon_p, paired_summary, arm_separation, paired_contrast, quantiles, hc3_sensitivity, gee_sensitivity, gee_base_model, seeded_associations)}

_Q = text.TOKEN_PATTERN.replace("'", "''")
_AB = "(SELECT l_orderkey, max(l_linestatus) AS status, round(avg(CASE WHEN l_linenumber = 1 THEN l_quantity END), 6) AS a, round(avg(CASE WHEN l_linenumber = 2 THEN l_quantity END), 6) AS b FROM lineitem GROUP BY 1)"
_CELLS = "(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS run, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)"
_PARTIAL = "CASE WHEN n >= 4 THEN round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) END"
_XYZ = f"count(*) AS n, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rz')} AS xz, {_corr('ry', 'rz')} AS yz"


def _boundary(bound: str, fill: int) -> str:
    return f"(SELECT '{bound}' AS bound, count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM ({_ranked_sql({'rx': 'n_chars', 'ry': 'q'})} (SELECT n_chars, coalesce(quality, {fill}) AS q FROM documents LEFT JOIN labels USING (doc_id))))"


def _fisher(sign: str) -> str:
    return f"CASE WHEN n > 3 AND abs(rho) < 1 THEN round(tanh(atanh(rho) {sign} 1.959963984540054 / sqrt(n - 3)), 6) END"


_GRID = " UNION ALL ".join(f"SELECT '{a}' AS metadata, '{b}' AS feature, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM u" for a in ("balance", "c_nationkey") for b in ("price", "orders", "done"))
_RAW = f"WITH r AS ({_ranked_sql({'rx': 'price', 'ry': 'orders'}, 'c_mktsegment')} {_UNITS_SQL}), c AS (SELECT c_mktsegment, count(*) AS n, {_corr('rx', 'ry')} AS rho FROM r GROUP BY 1) "

_HC3 = f"""WITH u AS (SELECT c_mktsegment AS k, price AS x, done AS y, log2(orders + 1) AS w FROM {_UNITS_SQL}),
m AS (SELECT k, count(*) AS n, avg(x) AS mx, stddev_samp(x) AS sx, avg(w) AS mw, stddev_samp(w) AS sw, avg(y) AS my, corr(x, w) AS r, covar_samp(x, y) / stddev_samp(x) AS cx, covar_samp(w, y) / stddev_samp(w) AS cw FROM u GROUP BY k),
b AS (SELECT *, (cx - r * cw) / (1 - r * r) AS b1, (cw - r * cx) / (1 - r * r) AS b2, (n - 1) * (1 - r * r) AS d FROM m),
z AS (SELECT b.*, y, (x - mx) / sx AS zx, (w - mw) / sw AS zw FROM u JOIN b USING (k)),
e AS (SELECT k, n, b1, sqrt(sum(pow((zx - r * zw) / d * (y - my - b1 * zx - b2 * zw) / (1 - (1.0 / n + (zx * zx - 2 * r * zx * zw + zw * zw) / d)), 2))) AS error FROM z GROUP BY k, n, b1)
SELECT k AS c_mktsegment, CAST(n AS INTEGER) AS n, round(b1, 6) AS coefficient, round(error, 6) AS error, round(b1 - 1.959963984540054 * error, 6) AS low, round(b1 + 1.959963984540054 * error, 6) AS high FROM e"""


def _gee_sql(first: int = 12, rounds: int = 25) -> str:
    """Scoring steps as recursion over (step, coefficients, correlation): ``first`` ones of independent rows, then ``rounds`` with the correlation of the coefficients before."""
    g = ("x0", "x1", "x2")
    pairs = [(a, b) for i, a in enumerate(g) for b in g[i:]]
    name = lambda a, b: f"q{min(a, b)[1]}{max(a, b)[1]}"
    eta = "(k.b0 + k.b1 * r.x1 + k.b2 * r.x2)"

    def clusters(k: str) -> str:
        mu = f"(1 / (1 + exp(-{eta})))"
        e, s = f"((r.y - {mu}) / sqrt({mu} * (1 - {mu})))", f"sqrt({mu} * (1 - {mu}))"
        each = f"SELECT k.i, k.b0, k.b1, k.b2, r.c, r.x0 * {s} AS x0, r.x1 * {s} AS x1, r.x2 * {s} AS x2, {e} AS e FROM r, {k} k"
        return f"SELECT i, b0, b1, b2, c, count(*) AS m, sum(e) AS es, sum(e * e) AS ee, " + ", ".join(f"sum({a}) AS s{a[1]}, sum({a} * e) AS e{a[1]}" for a in g) + ", " + ", ".join(f"sum({a} * {b}) AS {name(a, b)}" for a, b in pairs) + f" FROM ({each}) GROUP BY ALL"

    alpha = f"CASE WHEN i < {first} THEN 0.0 ELSE sum((es * es - ee) / 2) OVER (PARTITION BY i) / (sum(ee) OVER (PARTITION BY i) / (sum(m) OVER (PARTITION BY i) - 3)) / (sum(m * (m - 1) / 2) OVER (PARTITION BY i) - 3) END"
    shrink = "a / (1 + (m - 1) * a)"
    parts = lambda: ", ".join(f"(e{a[1]} - {shrink} * s{a[1]} * es) / (1 - a) AS u{a[1]}" for a in g) + ", " + ", ".join(f"({name(a, b)} - {shrink} * s{a[1]} * s{b[1]}) / (1 - a) AS {name(a, b)}" for a, b in pairs)
    det = "(q00 * (q11 * q22 - q12 * q12) - q01 * (q01 * q22 - q12 * q02) + q02 * (q01 * q12 - q11 * q02))"
    inverse = {"00": "q11 * q22 - q12 * q12", "01": "q02 * q12 - q01 * q22", "02": "q01 * q12 - q02 * q11", "11": "q00 * q22 - q02 * q02", "12": "q01 * q02 - q00 * q12", "22": "q00 * q11 - q01 * q01"}
    inv = lambda j, k: f"(({inverse[min(j, k) + max(j, k)]}) / {det})"
    total = ", ".join(f"sum(u{j}) AS u{j}" for j in "012") + ", " + ", ".join(f"sum({name(a, b)}) AS {name(a, b)}" for a, b in pairs)
    move = lambda j: " + ".join(f"{inv(j, k)} * u{k}" for k in "012")
    step = f"SELECT i + 1, b0 + {move('0')}, b1 + {move('1')}, b2 + {move('2')} FROM (SELECT i, b0, b1, b2, {total} FROM (SELECT *, {parts()} FROM (SELECT *, {alpha} AS a FROM ({clusters('k')}))) GROUP BY ALL) WHERE i < {first + rounds}"
    step = step.replace("SELECT *, (e0", "SELECT i, b0, b1, b2, (e0")
    meat = ", ".join(f"sum(u{a[1]} * u{b[1]}) AS v{a[1]}{b[1]}" for a, b in pairs)
    v = lambda j, k: f"v{min(j, k)}{max(j, k)}"
    error = lambda j: "sqrt(" + " + ".join(f"{inv(j, k)} * {v(k, l)} * {inv(l, j)}" for k in "012" for l in "012") + ")"  # noqa: E731, E741
    last = f"SELECT *, {parts()} FROM (SELECT *, {alpha} AS a FROM ({clusters('(SELECT * FROM k ORDER BY i DESC LIMIT 1)')}))".replace("SELECT *, (e0", "SELECT i, b0, b1, b2, m, (e0")
    return f"""
WITH RECURSIVE u AS (SELECT source AS unit, avg(n_chars) AS x, log2(count(*) + length(source) + ascii(right(source, 1)) % 3) AS w FROM documents GROUP BY source),
h AS (SELECT lang || '-' || (doc_id % 40) AS c, source AS unit, quality AS y, x, w FROM documents JOIN labels USING (doc_id) JOIN u ON u.unit = source WHERE quality IS NOT NULL),
z AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(w) AS mw, stddev_samp(w) AS sw FROM (SELECT DISTINCT unit, x, w FROM h)),
r AS (SELECT c, y, 1.0::DOUBLE AS x0, (x - mx) / sx AS x1, (w - mw) / sw AS x2 FROM h, z),
k(i, b0, b1, b2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL {step}),
f AS (SELECT b0, b1, b2, sum(m) AS n_rows, count(*) AS n_clusters, {total}, {meat} FROM ({last}) GROUP BY ALL),
t AS (SELECT unnest([{{'t': 'intercept', 'b': b0, 'e': {error('0')}}}, {{'t': 'z_predictor', 'b': b1, 'e': {error('1')}}}, {{'t': 'z_log2_size', 'b': b2, 'e': {error('2')}}}]) AS o, n_rows, n_clusters FROM f)
SELECT o.t AS term, round(o.b, 6) AS estimate, round(o.e, 6) AS error, round(o.b - {models.Z975} * o.e, 6) AS low, round(o.b + {models.Z975} * o.e, 6) AS high, round({_normal_sql("abs(o.b / o.e)")}, 6) AS p, CAST(n_rows AS BIGINT) AS n_rows, n_clusters FROM t"""


def _normal_sql(z: str, cells: int = 4000) -> str:
    """Two-sided normal tail by Simpson's rule over [0, z]."""
    n = 2 * cells
    return f"(1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({z} * i / {n}) * ({z} * i / {n})))) * {z} / {n} / 3)"


ORACLE_SQL = {
    "gee_base_model": _gee_sql(),
    "hc3_sensitivity": _HC3,
    "partial_spearman_tokens_quality": f"WITH b AS (SELECT len(regexp_extract_all(text, '{_Q}')) AS x, quality AS y, n_chars AS z FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), r AS ({_ranked_sql({'rx': 'x', 'ry': 'y', 'rz': 'z'})} b), c AS (SELECT {_XYZ} FROM r) SELECT n, {_PARTIAL} AS rho FROM c",
    "average_rank": "SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS rank_in_segment FROM customer",
    "raw_spearman": _RAW + f"SELECT c_mktsegment, n, round(rho, 6) AS rho, {_fisher('-')} AS low, {_fisher('+')} AS high FROM c",
    "partial_spearman": f"WITH r AS ({_ranked_sql({'rx': 'price', 'ry': 'orders', 'rz': 'balance'}, 'c_mktsegment')} {_UNITS_SQL}), c AS (SELECT c_mktsegment, {_XYZ} FROM r GROUP BY 1) SELECT c_mktsegment, n, {_PARTIAL} AS rho FROM c",
    "leave_one_group_out": f"WITH u AS {_UNITS_SQL}, o AS (SELECT s.c_mktsegment AS omitted, price, orders, balance FROM u JOIN (SELECT DISTINCT c_mktsegment FROM u) s ON u.c_mktsegment <> s.c_mktsegment), r AS ({_ranked_sql({'rx': 'price', 'ry': 'orders', 'rz': 'balance'}, 'omitted')} o), c AS (SELECT omitted, {_XYZ} FROM r GROUP BY 1) SELECT omitted, n, {_PARTIAL} AS rho FROM c",
    "holm_family": "WITH f AS (SELECT o_orderstatus AS family, o_orderpriority AS name, sum(o_custkey) AS s FROM orders GROUP BY ALL), p AS (SELECT family, name, CASE WHEN s % 5 <> 0 THEN s % 1000 / 20000.0 END AS p FROM f), h AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, name) + 1) * p) END AS raw FROM p), a AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(raw) OVER (PARTITION BY family ORDER BY p NULLS LAST, name ROWS UNBOUNDED PRECEDING) END AS adj FROM h) SELECT family, name, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(adj AS DOUBLE), 6) AS adjusted, coalesce(adj <= 0.05, false) AS rejected FROM a",
    "boundary_sensitivity": _boundary("minimum", -1) + " UNION ALL " + _boundary("maximum", 2),
    "run_stability": f"WITH c AS {_CELLS}, p AS (SELECT a.run AS run_a, b.run AS run_b, a.v AS x, b.v AS y FROM c a JOIN c b USING (l_orderkey) WHERE a.run < b.run), r AS (SELECT run_a, run_b, rank() OVER (PARTITION BY run_a, run_b ORDER BY x) + (count(*) OVER (PARTITION BY run_a, run_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY run_a, run_b ORDER BY y) + (count(*) OVER (PARTITION BY run_a, run_b, y) - 1) / 2.0 AS ry FROM p) SELECT run_a, run_b, count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM r GROUP BY ALL",
    "icc_3_1": f"WITH c AS (SELECT * FROM {_CELLS} ), w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM c), v AS (SELECT *, avg(v) OVER (PARTITION BY l_orderkey) AS rm, avg(v) OVER (PARTITION BY run) AS cm, avg(v) OVER () AS g FROM w WHERE k = 7), s AS (SELECT count(*) / 7 AS n, sum((rm - g) * (rm - g)) AS ssr, sum((v - rm - cm + g) * (v - rm - cm + g)) AS sse FROM v), m AS (SELECT n, ssr / (n - 1) AS msr, sse / ((n - 1) * 6) AS mse FROM s) SELECT CAST(n AS BIGINT) AS n, CAST(7 AS BIGINT) AS k, round((msr - mse) / (msr + 6 * mse), 6) AS icc FROM m",
    "outcome_agreement": f"WITH m AS (SELECT source, round(avg(quality), 6) AS au, round(avg(toxic), 6) AS pbu FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS ({_ranked_sql({'rx': 'au', 'ry': 'pbu'})} m), c AS (SELECT count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM r), e AS (SELECT round(avg(pbu - au), 6) AS mean_difference, round(median(pbu - au), 6) AS median_difference FROM m) SELECT * FROM c, e",
    "gate_decision": _RAW + "SELECT c_mktsegment, n, CASE WHEN n >= 45 AND rho >= 0.30 AND tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)) > 0 THEN 'GO' ELSE 'NO_GO' END AS decision FROM c",
    "correlation_grid": f"WITH u AS {_UNITS_SQL}, l AS ({_GRID}), r AS (SELECT metadata, feature, rank() OVER (PARTITION BY metadata, feature ORDER BY x) + (count(*) OVER (PARTITION BY metadata, feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY metadata, feature ORDER BY y) + (count(*) OVER (PARTITION BY metadata, feature, y) - 1) / 2.0 AS ry FROM l) SELECT metadata, feature, count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM r GROUP BY ALL",
    "hash_bootstrap_within_group": "WITH n AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), d AS (SELECT g, r.range AS r, CAST('0x' || substr(md5(g || '|' || r.range || '|' || i), 1, 8) AS BIGINT) % n AS i FROM n, range(50) r), m AS (SELECT d.g, d.r, avg(n.v) AS m FROM d JOIN n ON n.g = d.g AND n.i = d.i GROUP BY ALL) SELECT g AS c_mktsegment, count(*) AS replicates, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m GROUP BY 1",
    "hash_permutation_within_group": f"WITH u AS (SELECT c_custkey, c_mktsegment, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rx, rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 AS ry FROM {_UNITS_SQL}), p AS (SELECT *, r.range AS r, CASE WHEN r.range = 0 THEN c_custkey ELSE CAST('0x' || substr(md5(r.range || '|' || c_custkey), 1, 8) AS BIGINT) END AS k FROM u, range(21) r), s AS (SELECT c_mktsegment, r, ry, row_number() OVER (PARTITION BY c_mktsegment, r ORDER BY k, c_custkey) AS i FROM p), f AS (SELECT c_mktsegment, r, rx, row_number() OVER (PARTITION BY c_mktsegment, r ORDER BY c_custkey) AS i FROM p) SELECT r, round({_corr('rx', 'ry')}, 6) AS rho FROM f JOIN s USING (c_mktsegment, r, i) GROUP BY r",
    "auc_length_by_quality": "WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT CAST(sum(quality) AS BIGINT) AS n1, CAST(sum(1 - quality) AS BIGINT) AS n0, sum(quality * r) AS s FROM r) SELECT n1, n0, round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM s",
    "point_biserial": f"SELECT lang, count(*) AS n, round({_corr('toxic', 'n_chars')}, 6) AS r FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "wilcoxon_p": f"""WITH d AS (SELECT a - b AS d FROM (SELECT l_orderkey, avg(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, avg(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0), w AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r),
t AS (SELECT sum(t * t * t - t) AS t FROM (SELECT count(*)::DOUBLE AS t FROM d WHERE d <> 0 GROUP BY abs(d))), z AS (SELECT n, abs(w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24) AS z FROM w, t)
SELECT CAST(n AS BIGINT) AS n, round({_normal_sql("z")}, 6) AS p FROM z""",
    "wilcoxon_runs": f"WITH d AS (SELECT status, a - b AS d FROM {_AB} WHERE a IS NOT NULL AND b IS NOT NULL), z AS (SELECT status, count(*) FILTER (d = 0) AS zeros FROM d GROUP BY 1), r AS (SELECT status, d, rank() OVER (PARTITION BY status ORDER BY abs(d)) + (count(*) OVER (PARTITION BY status, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0), w AS (SELECT status, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus FROM r GROUP BY 1), t AS (SELECT status, sum(t * t * t - t) AS tie_term FROM (SELECT status, abs(d) AS a, count(*)::DOUBLE AS t FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY 1) SELECT status, n, zeros, round(w_plus, 6) AS w_plus, round(tie_term, 6) AS tie_term FROM z JOIN w USING (status) JOIN t USING (status)",
    "paired_summary": f"SELECT status, count(*) AS n, round(avg(a), 6) AS left_mean, round(avg(b), 6) AS right_mean, round(avg(a - b), 6) AS difference_mean, round(median(a - b), 6) AS difference_median, round(coalesce(stddev_samp(a - b), 0), 6) AS difference_sd, count(*) FILTER (a - b > 0) AS positive, count(*) FILTER (a - b = 0) AS zero, count(*) FILTER (a - b < 0) AS negative FROM {_AB} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY status",
    "arm_separation": f"WITH x AS (SELECT status, 1 AS l, a AS v FROM {_AB} WHERE a IS NOT NULL UNION ALL SELECT status, 0, b FROM {_AB} WHERE b IS NOT NULL), r AS (SELECT status, l, rank() OVER (PARTITION BY status ORDER BY v) + (count(*) OVER (PARTITION BY status, v) - 1) / 2.0 AS r FROM x), s AS (SELECT status, CAST(sum(l) AS BIGINT) AS n1, CAST(sum(1 - l) AS BIGINT) AS n0, sum(l * r) AS s FROM r GROUP BY 1), a AS (SELECT *, (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM s) SELECT status, n1, n0, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS separation, CASE WHEN auc > 0.5 THEN 'left' WHEN auc < 0.5 THEN 'right' ELSE 'tie' END AS higher FROM a",
    "paired_contrast": "WITH o AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS u, o_totalprice AS p FROM orders), a AS (SELECT avg(p) FILTER (u) AS y, avg(p) FILTER (NOT u) AS n FROM o), w AS (SELECT o_custkey, avg(p) FILTER (u) - avg(p) FILTER (NOT u) AS d FROM o GROUP BY 1), i AS (SELECT count(d) AS pairs, avg(d) AS pd, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d = 0) AS zero, count(*) FILTER (d < 0) AS negative FROM w) SELECT round(y, 4) AS yes_mean, round(n, 4) AS no_mean, round(y - n, 4) AS difference, round(pd, 4) AS pair_difference, pairs, positive, zero, negative FROM a, i",
    "quantiles": "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.5), 6) AS q500, round(quantile_cont(value, 0.975), 6) AS q975 FROM events GROUP BY event_type",
}
