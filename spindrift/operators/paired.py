"""Paired comparisons of two arms, and stability over runs."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranks
from ..functions.probability import normal_two_sided
from .aggregates import sd


def signed_rank_p(n: int, w_plus: float, tie_term: float, zeros: int) -> float:
    """Two-sided Wilcoxon p-value: exact for up to 50 untied differences, else normal with tie correction."""
    if not n:
        return 1.0
    if n <= 50 and not tie_term and not zeros:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        w = round(min(w_plus, n * (n + 1) / 2 - w_plus))
        return min(1.0, 2 * sum(ways[: w + 1]) / 2**n)
    error = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
    return normal_two_sided((w_plus - n * (n + 1) / 4) / error) if error else 1.0


@F.pandas_udf(T.DoubleType())
def _p(n: pd.Series, w: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b or 0), float(c or 0), int(d)) for a, b, c, d in zip(n, w.fillna(0), ties.fillna(0), zeros, strict=True)])


def wilcoxon(df: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, zeros, w_plus, tie_term, p) of the differences; zero differences are left out of the ranks."""
    by = by or []
    d = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*by, (F.col(left).cast("double") - F.col(right)).alias("d"))
    zeros = d.groupBy(*by).agg(F.count(F.when(F.col("d") == 0, 1)).alias("zeros"))
    moved = d.filter("d <> 0").withColumn("a", F.abs("d"))
    ranked = ranks.with_ranks(moved, {"r": "a"}, by)
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"))
    ties = moved.groupBy(*by, "a").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"))
    if by:
        rows = zeros.join(sums, by, "left").join(ties, by, "left")
    else:
        rows = zeros.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(ties))  # one row each
    rows = rows.fillna(0, ["n"]).fillna(0.0, ["w_plus", "tie_term"])
    return rows.withColumn("p", _p("n", "w_plus", "tie_term", "zeros"))


def paired_summary(df: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """Means of both arms and of the difference, its SD and median, signs, and exact matches."""
    d = F.col(left).cast("double") - F.col(right)
    rows = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    told = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(left).alias("left_mean"), F.avg(right).alias("right_mean"), F.avg(d).alias("difference_mean"),
        sd(d).alias("difference_sd"), F.count(F.when(d > 0, 1)).alias("positive"), F.count(F.when(d == 0, 1)).alias("zero"), F.count(F.when(d < 0, 1)).alias("negative"),
    )
    return ranks.with_median(told, rows.select(*by, d.alias("_d")), "_d", by, "difference_median")


def long_metrics(df: DataFrame, keys: list[str], extractors: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(keys..., metric, left, right): a row for each named pair of expressions over both arms."""
    each = F.array(*[F.struct(F.lit(name).alias("metric"), left.cast("double").alias("left"), right.cast("double").alias("right")) for name, (left, right) in extractors.items()])
    return df.select(*keys, F.explode(each).alias("_m")).select(*keys, "_m.*")


def arm_auc(df: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """AUC of left against right values, its separation max(a, 1 - a) and the arm with higher values."""
    both = df.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("l"), F.col(left).cast("double").alias("v")), F.struct(F.lit(0).alias("l"), F.col(right).cast("double").alias("v")))).alias("x"))
    rows = ranks.auc(both.select(*by, F.col("x.l").alias("l"), F.col("x.v").alias("v")).filter("v IS NOT NULL"), "l", "v", by)
    return rows.withColumn("separation", F.greatest("auc", 1 - F.col("auc"))).withColumn("higher", F.when(F.col("auc") > 0.5, "left").when(F.col("auc") < 0.5, "right").otherwise("tie"))


def contrasts(df: DataFrame, pair: str, label: str, value: str) -> DataFrame:
    """Mean of both labels over all rows, their difference, and mean and signs of within-pair differences."""
    wide = df.groupBy(pair).agg(F.avg(F.when(F.col(label) == 1, F.col(value))).alias("yes"), F.avg(F.when(F.col(label) == 0, F.col(value))).alias("no"))
    d = F.col("yes") - F.col("no")
    inside = wide.agg(F.count(d).alias("pairs"), F.avg(d).alias("pair_difference"), F.count(F.when(d > 0, 1)).alias("positive"), F.count(F.when(d == 0, 1)).alias("zero"), F.count(F.when(d < 0, 1)).alias("negative"))
    plain = df.agg(F.avg(F.when(F.col(label) == 1, F.col(value))).alias("yes_mean"), F.avg(F.when(F.col(label) == 0, F.col(value))).alias("no_mean"))
    return plain.withColumn("difference", F.col("yes_mean") - F.col("no_mean")).crossJoin(F.broadcast(inside))  # one row each


def run_pairs(df: DataFrame, unit: str, run: str, value: str) -> DataFrame:
    """Spearman correlation of every two runs over the units that have both: (run_a, run_b, n, rho)."""
    a = df.select(unit, F.col(run).alias("run_a"), F.col(value).alias("x"))
    b = df.select(unit, F.col(run).alias("run_b"), F.col(value).alias("y"))
    pairs = a.join(b, unit).filter((F.col("run_a") < F.col("run_b")) & F.col("x").isNotNull() & F.col("y").isNotNull())  # a unit has as many rows as runs
    return ranks.spearman(pairs, "x", "y", ["run_a", "run_b"])


def icc_3_1(df: DataFrame, unit: str, run: str, value: str, runs: list) -> DataFrame:
    """(n, k, icc): two-way mixed, consistency, single measure, over units with a value in every run.

    A unit is one row of its runs' means, made by one aggregate; everything else is sums over these rows.
    """
    k = len(runs)
    means = [F.avg(F.when(F.col(run) == F.lit(r), F.col(value).cast("double"))).alias(f"_v{i}") for i, r in enumerate(runs)]
    v = [F.col(f"_v{i}") for i in range(k)]
    whole = df.filter(F.col(run).isin(*runs) & F.col(value).isNotNull()).groupBy(unit).agg(*means).filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in v]))
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    sums = whole.select(*v, add(v).alias("s"), add([c * c for c in v]).alias("q"))
    total = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("t"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("r"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(v)])
    x = total.withColumn("c", add([F.col(f"c{i}") * F.col(f"c{i}") for i in range(k)]))
    n = F.col("n")
    correction = F.col("t") * F.col("t") / (n * k)
    ss_rows, ss_cols = F.col("r") / k - correction, F.col("c") / n - correction
    ss_error = F.col("q") - correction - ss_rows - ss_cols
    msr, mse = F.try_divide(ss_rows, n - 1), F.try_divide(ss_error, (n - 1) * (k - 1))
    return x.select("n", F.lit(k).alias("k"), F.try_divide(msr - mse, msr + (k - 1) * mse).alias("icc"))
