"""Seeded permutation tests and bootstrap intervals, one group of rows (a metric and outcome) a task: the small exact versions.

A sequential generator's stream can't be split without changing its draws, so parallelism is over groups, and a group is
bounded by ``MOST_ROWS``.  Draws are made one replicate after the other; statistics are computed for many replicates at
once.  For groups of any size, ``analysis`` has the same tests with draws that any task can make.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import counted

BOOTSTRAP_SEED, PRIMARY_SEED, SECONDARY_SEED = 20_260_811, 20_260_812, 20_260_813
_BATCH = 2048
#: Rows of a seeded group; one with more is an error.
MOST_ROWS = 20_000


def metric_seed(name: str, base: int = SECONDARY_SEED) -> int:
    """A seed of its own for every named test."""
    return base + int(hashlib.sha256(name.encode()).hexdigest(), 16)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis."""
    x = np.atleast_2d(x)
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    n = x.shape[1]
    new = np.concatenate([np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    at = np.arange(n)[None, :]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    end = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1)
    last = np.minimum.accumulate(np.where(end, at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def _correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise Pearson correlations; NaN where a side is constant."""
    x, y = x - x.mean(axis=-1, keepdims=True), y - y.mean(axis=-1, keepdims=True)
    below = np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(below > np.finfo(float).eps, (x * y).sum(axis=-1) / below, np.nan)


def _projection(controls: list[np.ndarray], n: int) -> np.ndarray:
    """Matrix that removes an intercept and ranked controls."""
    design = np.column_stack([np.ones(n), *[ranks(c)[0] for c in controls]])
    if np.linalg.matrix_rank(design) < design.shape[1]:
        raise ValueError("rank_control_design_singular")
    return np.eye(n) - design @ np.linalg.pinv(design)


def partial_statistic(x: np.ndarray, y: np.ndarray, controls: list[np.ndarray]) -> float:
    """Pearson correlation of rank residuals; NaN where undefined."""
    if len(x) < len(controls) + 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return float("nan")
    try:
        m = _projection(controls, len(x))
    except ValueError:
        return float("nan")
    return float(_correlations(m @ ranks(x)[0], m @ ranks(y)[0]))


def _groups(strata: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(strata == s) for s in sorted(set(strata.tolist()))]


def freedman_lane(x, y, controls, strata, replicates: int, seed: int) -> dict:
    """Permutes outcome-rank residuals within strata and fits again; p-values count the observed value in."""
    x, y, strata = np.asarray(x, float), np.asarray(y, float), np.asarray(strata, object)
    m = _projection([np.asarray(c, float) for c in controls], len(x))
    ry = ranks(y)[0]
    residual = m @ ry
    fitted, predictor = ry - residual, m @ ranks(x)[0]
    observed = float(_correlations(predictor, residual))
    rng, parts = np.random.Generator(np.random.PCG64(seed)), _groups(strata)
    above = beyond = undefined = done = 0
    while done < replicates:
        k = min(_BATCH, replicates - done)
        drawn = np.empty((k, len(x)))
        for row in drawn:
            for part in parts:
                row[part] = residual[rng.permutation(part)]
        stat = _correlations(predictor[None, :], (fitted + drawn) @ m.T)
        undefined += int(np.isnan(stat).sum())
        above += int((stat >= observed).sum())
        beyond += int((np.abs(stat) >= abs(observed)).sum())
        done += k
    return {"observed": observed, "one_sided_p": (1 + above) / (1 + replicates), "two_sided_p": (1 + beyond) / (1 + replicates), "undefined": undefined}


def bootstrap(x, y, controls, strata, replicates: int, seed: int, whole: bool = False) -> dict:
    """Percentile interval of the (partial) rank correlation; resamples rows within strata, or whole strata."""
    x, y, strata = np.asarray(x, float), np.asarray(y, float), np.asarray(strata, object)
    controls = [np.asarray(c, float) for c in controls]
    parts = _groups(strata)
    rng = np.random.Generator(np.random.PCG64(seed))
    samples = []
    for _ in range(replicates):
        if whole:
            samples.append(np.concatenate([parts[i] for i in rng.integers(0, len(parts), len(parts))]))
        else:
            samples.append(np.concatenate([p[rng.integers(0, len(p), len(p))] for p in parts]))
    if controls or whole:
        stats = np.array([partial_statistic(x[s], y[s], [c[s] for c in controls]) for s in samples])
    else:
        at = np.array(samples)
        stats = _correlations(ranks(x[at]), ranks(y[at]))
    good = stats[np.isfinite(stats)]
    low, high = np.quantile(good, (0.025, 0.975)) if len(good) else (None, None)
    return {"lower": low, "upper": high, "valid": len(good), "undefined": replicates - len(good)}


RESULT = "metric string, n int, raw_rho double, partial_rho double, raw_low double, raw_high double, partial_low double, partial_high double, raw_p double, partial_p double"


def associations(df: DataFrame, unit: str, stratum: str, control: str, outcome: str, metrics: list[str], replicates: int, permutations: int) -> DataFrame:
    """One row a metric: raw and control-adjusted rank correlation with intervals and permutation p-values.

    Rows are sorted by (stratum, unit) inside a group, so results don't depend on input order.
    """
    long = df.select(unit, stratum, F.col(control).cast("double").alias("z"), F.col(outcome).cast("double").alias("y"), F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "x"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["x", "y", "z"]).sort_values([stratum, unit])
        name = rows["metric"].iloc[0] if len(rows) else ""
        if len(rows) > MOST_ROWS:
            raise ValueError(f"seeded_group_too_large:{len(rows)}")
        x, y, z = (rows[c].to_numpy() for c in "xyz")
        if len(rows) < 4 or np.ptp(x) == 0 or np.ptp(y) == 0:
            return pd.DataFrame([[name, len(rows), *[None] * 8]], columns=[c.split()[0] for c in RESULT.split(", ")])
        s = rows[stratum].to_numpy()
        raw, part = bootstrap(x, y, [], s, replicates, BOOTSTRAP_SEED), bootstrap(x, y, [z], s, replicates, BOOTSTRAP_SEED)
        raw_p = freedman_lane(x, y, [], s, permutations, metric_seed(f"{name}:{outcome}:raw"))
        part_p = freedman_lane(x, y, [z], s, permutations, metric_seed(f"{name}:{outcome}:partial"))
        return pd.DataFrame([[name, len(rows), raw_p["observed"], part_p["observed"], raw["lower"], raw["upper"], part["lower"], part["upper"], raw_p["two_sided_p"], part_p["two_sided_p"]]], columns=[c.split()[0] for c in RESULT.split(", ")])

    return long.groupBy("metric").applyInPandas(one, RESULT)


def hashed_draw(*parts):
    """A number in [0, 2**32) from a hash of the parts, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def hash_bootstrap_means(df: DataFrame, unit: str, group: str, value: str, replicates: int) -> DataFrame:
    """Bootstrap means within groups whose draws are hashes, so that any engine gets the same ones.

    Rows of a group are numbered by ranges; replicate r's i-th draw is the row of number hash(group, r, i) mod n.
    """
    numbered = counted(df.select(group, unit, F.col(value).cast("double").alias("v")), [group], [unit], "i")
    sizes = numbered.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    draws = numbered.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select(group, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    draws = draws.select(F.col(group).alias("_g"), "r", F.pmod(hashed_draw(F.col(group), F.col("r"), F.col("i")), F.col("n")).alias("_i"))
    found = draws.join(numbered.select(group, "i", "v"), F.col("_g").eqNullSafe(F.col(group)) & (F.col("_i") == F.col("i")))
    return found.groupBy(group, "r").agg(F.avg("v").alias("m"))
