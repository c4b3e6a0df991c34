"""Driver tables in the roles that the study's queries need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded for comparison with another engine; -0.0 becomes 0.0."""
    return F.round(x, 6) + F.lit(0.0)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their quality and toxicity labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reference, candidate): each turn with the next one of its conversation."""
    following = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("reference"), F.lead("text").over(following).alias("candidate"))
    return rows.filter("candidate IS NOT NULL")


TURN_PAIRS_SQL = "(SELECT * FROM (SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS candidate FROM conversations) WHERE candidate IS NOT NULL)"
