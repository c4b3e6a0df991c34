"""Row numbers within groups of any size, by ranges: no task sees a group in order as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def counted(df: DataFrame, by: list[str], order: list[str | Column], name: str, flag: Column | None = None) -> DataFrame:
    """Adds ``name``: how many rows (with ``flag``) of the row's group stand before it in ``order``; stored, or a stored table with few counts to add.

    Rows are dealt out to ranges of (group, order) and sorted there; a row's number is that within its own
    range, plus the counts of the group's earlier ranges, of which there is one row a range.  ``order`` must
    be total up to rows that may change places, or rows of equal order share a range.
    """
    keys = [F.col(c) for c in by]
    marked = df if flag is None else df.withColumn("_f", F.coalesce(flag.cast("int"), F.lit(0)))
    ranged = marked.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "ranges")
    if flag is None:
        total, within, first = F.count(F.lit(1)), F.col("_i") - F.col("_first"), [F.min("_i").alias("_first")]
    else:
        own = Window.partitionBy(*by, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("_within", F.coalesce(F.sum("_f").over(own), F.lit(0)))
        total, within, first = F.sum("_f"), F.col("_within"), []
    counts = ranged.groupBy(*by, "_p").agg(total.cast("long").alias("_n"), *first)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *(["_first"] if first else []))
    if not by:
        counts = F.broadcast(stored(counts, "counts"))  # one row a range
    on = [ranged[c].eqNullSafe(counts[f"_k{i}"]) for i, c in enumerate(by)]
    found = ranged.join(counts, [ranged["_p"] == counts["_q"], *on])
    found = found.select(*df.columns, (within + F.col("_before")).cast("long").alias(name))
    return found if flag is None and not by else stored(found, "numbered")
