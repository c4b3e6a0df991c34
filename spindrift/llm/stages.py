"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents that go on.

Stages decide by row, whatever ids there are: a row with a null or repeated id stays or goes by its own
text.  Rows of one id and text are the same document and stay or go together.  Columns of any name stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontamination, mixing, near_duplicates, suffix_dedup, toxicity
from .store import unused


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose hash of id and text is in the one column of ``gone``."""
    row, other = unused(docs, "_row"), unused(docs, "_gone")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    return rows.join(gone.toDF(other), F.col(row) == F.col(other), "left_anti").drop(row)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is learned from ``labels``."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; so do documents without words or without an id."""
    return _without(docs, near_duplicates.near_duplicate_rows(docs).filter("NOT kept").select("row"))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand in an earlier place are cut from the texts; rows stay."""
    return suffix_dedup.deduplicated(docs)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a ``benchmark`` item go, each by its own text, whatever its id."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = decontamination.search(decontamination.build_index(rows, "row"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter(F.size("hits") > 0).select("doc_id"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources meet their target weights."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
]
