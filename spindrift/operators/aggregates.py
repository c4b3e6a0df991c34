"""Aggregations from evaluations to units: outcomes, descriptives, missingness, histograms, status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks


def sd(value: str | Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def unit_outcomes(df: DataFrame, unit: str, score: str, passed: str, constants: tuple[str, ...] = ()) -> DataFrame:
    """Per unit: rows, mean and SD of a score, and how many passed; columns that must not vary within a unit come along."""
    agg = [F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), sd(score).alias("score_sd"), F.avg(passed).alias("pass_mean"), F.sum(passed).cast("long").alias("pass_numerator"), F.count(passed).alias("pass_denominator")]
    checks = [F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit(f"{c}_varies_within_unit")).cast(df.schema[c].dataType)).alias(c) for c in constants]
    return df.groupBy(unit).agg(*checks, *agg)


def descriptive(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, SD, min, max and a normal 95 % interval of the mean, per group."""
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    rows = ranks.with_median(rows, df, value, by)
    margin = F.lit(1.96) * F.col("sd") / F.sqrt("n")
    return rows.withColumn("ci_low", F.col("mean") - margin).withColumn("ci_high", F.col("mean") + margin)


def missingness(df: DataFrame, predictor: str, group: str) -> DataFrame:
    """Total, observed, missing and missing fraction by group and, with a null group and is_total, overall."""
    rows = df.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count(predictor).alias("observed"))
    return rows.withColumn("missing", F.col("total") - F.col("observed")).withColumn("missing_fraction", F.col("missing") / F.col("total"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of a categorical column's values; null values are left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def count_distribution(df: DataFrame, unit: str) -> DataFrame:
    """How many units have how many rows."""
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias("rows_per_unit")).groupBy("rows_per_unit").agg(F.count(F.lit(1)).alias("units"))


def mean_over_runs(df: DataFrame, unit: str, run: str, values: list[str]) -> DataFrame:
    """Equal-weight means over a unit's runs, with the sorted run numbers."""
    means = [F.avg(v).alias(f"{v}_mean") for v in values]
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias("valid_run_count"), F.array_sort(F.collect_set(run)).alias("valid_runs"), *means)


def zero_filled_histogram(df: DataFrame, value: str, bins: range, by: str | None = None) -> DataFrame:
    """Counts of each bin value, 0 where there are none, by group."""
    spark = df.sparkSession
    grid = spark.range(bins.start, bins.stop).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = df.select(by).distinct().crossJoin(F.broadcast(grid))  # a fixed, small number of bins
    keys = [by] if by else []
    counts = df.groupBy(*keys, F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("c", F.lit(0)).alias("n"))


def status_pivot(df: DataFrame, unit: str, status: str, categories: list[str]) -> DataFrame:
    """One column a category with its count, 0 where there are none, in one pass; the null unit is the total."""
    counts = [F.count(F.when(F.col(status) == c, 1)).alias(c.lower().replace(" ", "_").replace("-", "_")) for c in categories]
    return df.groupingSets([[F.col(unit)], []], F.col(unit)).agg(F.grouping(unit).cast("int").alias("is_total"), *counts)


def ranges_within_unit(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Max - min of each unit with two values or more."""
    rows = df.groupBy(unit).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"))
    return rows.filter("n >= 2")


def weighted_mean_vector(df: DataFrame, by: list[str], vector: str, weight: str) -> DataFrame:
    """Mean of vectors weighted by ``weight``, place by place; parts are summed before they are shuffled."""
    places = df.select(*by, F.col(weight).cast("double").alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("place", "_v"))
    sums = places.groupBy(*by, "place").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("value"))
    return sums


def long_summary(df: DataFrame, values: list[str]) -> DataFrame:
    """Mean, median, SD, min and max of several columns as rows."""
    one = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.col(v).cast("double") for v in values]))).alias("metric", "value"))
    rows = one.groupBy("metric").agg(F.avg("value").alias("mean"), sd("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return ranks.with_median(rows, one, "value", ["metric"])
