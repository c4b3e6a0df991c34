"""Regression sensitivities: HC3 least squares and binomial GEE from aggregates, with small exact NumPy versions of both."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import Z975, normal_two_sided
from ..sources.store import stored


def _z(x: np.ndarray) -> np.ndarray:
    spread = np.std(x, ddof=1)
    if not spread > np.finfo(float).eps:
        raise ValueError("undefined_zscore")
    return (x - x.mean()) / spread


def hc3(x, y, size) -> dict:
    """Coefficient of z(x) in y ~ z(x) + z(log2 size) with its HC3 error."""
    x, y, size = (np.asarray(v, float) for v in (x, y, size))
    d = np.column_stack([np.ones(len(x)), _z(x), _z(np.log2(size))])
    q, r = np.linalg.qr(d)
    inverse = np.linalg.inv(r)
    beta = inverse @ (q.T @ y)
    u = (y - d @ beta) / (1 - (q * q).sum(axis=1))
    half = inverse @ q.T
    error = math.sqrt(float(((half[1] * u) ** 2).sum()))
    return {"coefficient": float(beta[1]), "error": error, "low": float(beta[1]) - Z975 * error, "high": float(beta[1]) + Z975 * error, "n": len(x)}


def hc3_by(df: DataFrame, by: str, x: str, y: str, size: str) -> DataFrame:
    """(by, coefficient, error, low, high, n): the HC3 sensitivity of each group; nulls where it is undefined.

    Sums only: one aggregate gives the moments, from which the coefficients follow, and a second one the
    residuals' sum with their leverages.  So a group of any size is spread over tasks.
    """
    rows = df.select(F.col(by).cast("string").alias("k"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (size, "s"))])
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("s").isNotNull()
    rows = rows.withColumn("whole", whole).withColumn("w", F.when(F.col("s") > 0, F.log2("s")))
    on = lambda c: F.when(F.col("whole"), F.col(c))
    moments = rows.groupBy("k").agg(
        F.count(on("x")).alias("n"), F.min(on("s")).alias("least"), F.avg(on("y")).alias("my"), *[f(on(c)).alias(f"{name}{c}") for c in ("x", "w") for name, f in (("m", F.avg), ("s", F.stddev_samp))],
        F.covar_samp(on("x"), on("w")).alias("xw"), F.covar_samp(on("x"), on("y")).alias("xy"), F.covar_samp(on("w"), on("y")).alias("wy"),
    )
    tiny = float(np.finfo(float).eps)
    moments = moments.withColumn("r", F.try_divide("xw", F.col("sx") * F.col("sw"))).withColumn("room", 1 - F.col("r") * F.col("r"))
    defined = (F.col("n") >= 4) & (F.col("least") > 0) & (F.col("sx") > tiny) & (F.col("sw") > tiny) & (F.col("room") > tiny)
    cx, cw = F.try_divide("xy", "sx"), F.try_divide("wy", "sw")
    moments = moments.withColumn("b1", F.when(defined, F.try_divide(cx - F.col("r") * cw, F.col("room")))).withColumn("b2", F.when(defined, F.try_divide(cw - F.col("r") * cx, F.col("room"))))
    moments = moments.withColumnRenamed("k", "_k")
    each = rows.filter("whole").join(moments, F.col("k").eqNullSafe(F.col("_k"))).filter("b1 IS NOT NULL")
    zx, zw, scale = (F.col("x") - F.col("mx")) / F.col("sx"), (F.col("w") - F.col("mw")) / F.col("sw"), (F.col("n") - 1) * F.col("room")
    leverage = 1 / F.col("n") + (zx * zx - 2 * F.col("r") * zx * zw + zw * zw) / scale
    part = (zx - F.col("r") * zw) / scale * F.try_divide(F.col("y") - F.col("my") - F.col("b1") * zx - F.col("b2") * zw, 1 - leverage)
    errors = each.groupBy("_k").agg(F.sqrt(F.sum(part * part)).alias("error")).withColumnRenamed("_k", "_e")
    told = moments.join(errors, F.col("_k").eqNullSafe(F.col("_e")), "left")
    half = F.lit(Z975) * F.col("error")
    return told.select(F.col("_k").alias(by), F.col("b1").alias("coefficient"), "error", (F.col("b1") - half).alias("low"), (F.col("b1") + half).alias("high"), F.col("n").cast("int").alias("n"))


def gee(design: np.ndarray, hits: np.ndarray, trials: np.ndarray, cluster: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> dict:
    """Binomial GEE with logit link, exchangeable working correlation and robust covariance.

    Coefficients start at those of independent rows; each round estimates the common correlation
    from standardised residuals and takes one scoring step.
    """
    y = hits / trials
    n, p = design.shape
    codes = np.unique(cluster, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    design, y, codes = design[order], y[order], codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    pairs = (sizes * (sizes - 1) / 2).sum()

    def parts(beta: np.ndarray):
        mu = 1 / (1 + np.exp(-design @ beta))
        s = np.sqrt(np.maximum(mu * (1 - mu), 1e-300))
        return design * s[:, None], (y - mu) / s  # rows of A^-1/2 D, standardised residuals

    def summed(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts, axis=0)

    def equations(beta: np.ndarray, alpha: float):
        """Score of each cluster and the information; the inverse of an exchangeable matrix is in closed form."""
        d, e = parts(beta)
        c = alpha / (1 + (sizes - 1) * alpha)
        ds, es = summed(d), summed(e)
        scores = (summed(d * e[:, None]) - c[:, None] * ds * es[:, None]) / (1 - alpha)
        info = (d.T @ d - (ds * c[:, None]).T @ ds) / (1 - alpha)
        return scores, info, e, es

    beta, alpha, settled = np.zeros(p), 0.0, False
    for _ in range(25):
        scores, info, *_ = equations(beta, 0.0)
        beta = beta + np.linalg.solve(info, scores.sum(axis=0))
    for _ in range(rounds):
        _, _, e, es = equations(beta, alpha)
        scale = (e @ e) / (n - p)
        alpha = float(((es * es - summed(e * e)) / 2).sum() / scale / (pairs - p)) if pairs > p else 0.0
        scores, info, *_ = equations(beta, alpha)
        beta = beta + np.linalg.solve(info, scores.sum(axis=0))
        if np.abs(equations(beta, alpha)[0].sum(axis=0)).max() < tolerance:
            settled = True
            break
    scores, info, *_ = equations(beta, alpha)
    bread = np.linalg.inv(info)
    error = np.sqrt(np.diag(bread @ (scores.T @ scores) @ bread))
    return {"converged": settled, "correlation": alpha, "estimate": beta, "error": error, "p": [normal_two_sided(b / s) if s else float(b == 0) for b, s in zip(beta, error, strict=True)]}


GEE_RESULT = "model string, term string, estimate double, error double, low double, high double, p double, n_rows long, n_clusters long, failure string"
_TERMS = ("intercept", "z_predictor", "z_log2_size", "professional_vs_student", "z_predictor_x_professional")


def participant_group(label):
    """student, professional or other, from free position labels."""
    norm = F.trim(F.regexp_replace(F.translate(F.lower(label), "-.’", " '"), r"\s+", " "))
    norm = F.regexp_replace(norm, r"\.", "")
    compact = F.regexp_replace(norm, r"[' ]", "")
    student = F.array_contains(F.split(norm, " "), "student") & (F.contains(norm, F.lit("bachelor")) | F.contains(norm, F.lit("master")) | F.contains(compact, F.lit("phd")))
    return F.when(norm == "professional developer", "professional").when(student, "student").otherwise("other")


class _Clustered:
    """Sums that a binomial GEE needs, by one aggregate over rows and one over clusters.

    ``rows``: (cluster, y, x0, x1, ...), y between 0 and 1.  A pass takes coefficients as one broadcast row (not as
    literals, so that all passes share their compiled code) and gives each cluster's sums, partly before the shuffle.
    The inverse of an exchangeable matrix is in closed form and depends on a cluster's size alone, so clusters are summed
    by size: any working correlation's score and information follow from these few rows (n rows have at most
    sqrt(2 n) sizes).  The sandwich's middle is a pass of its own, as one row.
    """

    def __init__(self, rows: DataFrame, p: int) -> None:
        self.rows, self.p, self.names = rows, p, [(j, k) for j in range(p) for k in range(j, p)]

    def _clusters(self, beta: np.ndarray, alpha: float) -> tuple[str, dict]:
        now = self.rows.sparkSession.createDataFrame(pa.table({**{f"b{j}": [float(b)] for j, b in enumerate(beta)}, "alpha": [float(alpha)]}))
        eta = " + ".join(f"b{j} * x{j}" for j in range(self.p))
        each = f"SELECT *, sqrt(greatest(mu * (1 - mu), 1e-300D)) AS s FROM (SELECT /*+ BROADCAST(b) */ r.*, b.*, 1 / (1 + exp(-({eta}))) AS mu FROM {{r}} r CROSS JOIN {{now}} b)"
        each = f"SELECT cluster, alpha, (y - mu) / s AS e, {', '.join(f'x{j} * s AS d{j}' for j in range(self.p))} FROM ({each})"
        sums = ", ".join([*(f"sum(d{j}) AS s{j}, sum(d{j} * e) AS e{j}" for j in range(self.p)), *(f"sum(d{j} * d{k}) AS q{j}_{k}" for j, k in self.names)])
        return f"SELECT cluster, first(alpha) AS alpha, count(*) AS m, sum(e) AS es, sum(e * e) AS ee, {sums} FROM ({each}) GROUP BY cluster", {"r": self.rows, "now": now}

    def _square(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((self.p, self.p))
        for x, (j, k) in zip(flat, self.names, strict=True):
            out[j, k] = out[k, j] = x
        return out

    def sums(self, beta: np.ndarray) -> _Sums:
        clusters, tables = self._clusters(beta, 0.0)
        parts = [*(f"sum(e{j})" for j in range(self.p)), *(f"sum(s{j} * es)" for j in range(self.p)), *(f"sum(q{j}_{k})" for j, k in self.names), *(f"sum(s{j} * s{k})" for j, k in self.names)]
        rows = self.rows.sparkSession.sql(f"SELECT m, count(*), sum(ee), sum((es * es - ee) / 2), {', '.join(parts)} FROM ({clusters}) GROUP BY m", **tables).collect()  # one row a cluster size
        return _Sums(np.array(rows, dtype=float), self)

    def meat(self, beta: np.ndarray, alpha: float) -> np.ndarray:
        clusters, tables = self._clusters(beta, alpha)
        scores = ", ".join(f"(e{j} - alpha / (1 + (m - 1) * alpha) * s{j} * es) / (1 - alpha) AS u{j}" for j in range(self.p))
        row = self.rows.sparkSession.sql(f"SELECT {', '.join(f'sum(u{j} * u{k})' for j, k in self.names)} FROM (SELECT {scores} FROM ({clusters}))", **tables).first()
        return self._square(np.array(row, dtype=float))


class _Sums:
    """Clusters' sums by size, at one set of coefficients."""

    def __init__(self, rows: np.ndarray, model: _Clustered) -> None:
        p, q = model.p, len(model.names)
        self.model, self.m, self.count = model, rows[:, 0], rows[:, 1]
        self.n, self.pairs = float(self.m @ self.count), float((self.m * (self.m - 1) / 2) @ self.count)
        self.ee, self.cross = float(rows[:, 2].sum()), float(rows[:, 3].sum())
        self.e, self.s, self.dd, self.ss = np.split(rows[:, 4:], [p, 2 * p, 2 * p + q], axis=1)

    def equations(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(score, information) with this working correlation."""
        shrink = (alpha / (1 + (self.m - 1) * alpha))[:, None]
        return (self.e - shrink * self.s).sum(axis=0) / (1 - alpha), self.model._square((self.dd - shrink * self.ss).sum(axis=0) / (1 - alpha))


def gee_by_sums(rows: DataFrame, p: int, rounds: int = 60, tolerance: float = 1e-6) -> dict:
    """What :func:`gee` gives, from aggregates: ``rows`` (cluster, y, x0 ... x{p-1}) may be of any number, and so may a cluster's."""
    model, beta, alpha, settled = _Clustered(rows, p), np.zeros(p), 0.0, False
    at = model.sums(beta)
    for _ in range(25):
        score, info = at.equations(0.0)
        step = np.linalg.solve(info, score)
        beta = beta + step
        at = model.sums(beta)
        if np.abs(step).max() < 1e-10 * max(1.0, np.abs(beta).max()):
            break
    for _ in range(rounds):
        alpha = at.cross / (at.ee / (at.n - p)) / (at.pairs - p) if at.pairs > p else 0.0
        score, info = at.equations(alpha)
        beta = beta + np.linalg.solve(info, score)
        at = model.sums(beta)
        score, info = at.equations(alpha)
        if np.abs(score).max() < tolerance:
            settled = True
            break
    bread = np.linalg.inv(info)
    error = np.sqrt(np.diag(bread @ model.meat(beta, alpha) @ bread))
    return {"converged": settled, "correlation": alpha, "estimate": beta, "error": error, "p": [normal_two_sided(b / s) if s else float(b == 0) for b, s in zip(beta, error, strict=True)]}


def gee_sensitivity(evaluations: DataFrame, units: DataFrame, trials: int, tolerance: float = 1e-6) -> DataFrame:
    """Participant-level models of hits out of ``trials``, with and without a group interaction.

    ``evaluations``: (participant, grp, unit, hits); ``units``: (unit, predictor, size).  Predictor
    and log2 size are standardised once over units that have both and any response, then joined.
    All passes are aggregates; one row of sums a pass reaches the driver.
    """
    spark = evaluations.sparkSession
    rows = evaluations.filter(F.col("hits").isNotNull()).join(units.filter(F.col("predictor").isNotNull()), "unit")
    rows = stored(rows.select("participant", "grp", "unit", F.col("hits").cast("double").alias("hits"), F.col("predictor").cast("double").alias("x"), F.log2(F.col("size").cast("double")).alias("w")), "gee")
    once = rows.groupBy("unit").agg(F.min("x").alias("x"), F.min("w").alias("w"))
    z = once.agg(*[f(c).alias(f"{n}{c}") for c in "xw" for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    tiny = float(np.finfo(float).eps)
    told = lambda out: spark.createDataFrame(out, GEE_RESULT)
    if not all(z[f"s{c}"] is not None and z[f"s{c}"] > tiny for c in "xw"):
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("participant").alias("c")).first()
        return told([("base", None, None, None, None, None, None, n["n"], n["c"], "undefined_zscore")])
    pro = (F.col("grp") == "professional").cast("double")
    zx, zw = (F.col("x") - z["mx"]) / z["sx"], (F.col("w") - z["mw"]) / z["sw"]
    design = stored(rows.select(F.col("participant").alias("cluster"), "grp", (F.col("hits") / trials).alias("y"), F.lit(1.0).alias("x0"), zx.alias("x1"), zw.alias("x2"), F.coalesce(pro, F.lit(0.0)).alias("x3"), (zx * F.coalesce(pro, F.lit(0.0))).alias("x4")), "gee")
    out = []
    for model, p in (("base", 3), ("interaction", 5)):
        part = design if model == "base" else design.filter("grp <> 'other' OR grp IS NULL")
        pairs = [(j, k) for j in range(p) for k in range(j, p)]
        n = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("c"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[F.sum(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"g{j}_{k}") for j, k in pairs]).first()
        failure, r = None, None
        if n["c"] < 2:
            failure = "insufficient_participant_clusters"
        elif n["n"] < p or _singular(np.array([[n[f"g{min(j, k)}_{max(j, k)}"] for k in range(p)] for j in range(p)])):
            failure = "singular_gee_design"
        elif n["lo"] == n["hi"]:
            failure = "constant_gee_outcome"
        else:
            r = gee_by_sums(part, p, tolerance=tolerance)
            failure = None if r["converged"] else "gee_not_converged"
        if failure:
            out.append((model, None, None, None, None, None, None, n["n"], n["c"], failure))
        else:
            out += [(model, t, float(b), float(e), float(b - Z975 * e), float(b + Z975 * e), float(q), n["n"], n["c"], None) for t, b, e, q in zip(_TERMS, r["estimate"], r["error"], r["p"], strict=False)]
    return told(out)


def _singular(gram: np.ndarray) -> bool:
    """Whether columns with these sums of products depend on each other; they are scaled to length 1 first."""
    length = np.sqrt(np.diag(gram))
    return bool((length == 0).any() or np.linalg.eigvalsh(gram / np.outer(length, length)).min() < 1e-12)
