"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that can be reached.

    Each round takes the least label among neighbours (a partial aggregation, so hubs are combined
    before they are shuffled) and then the label of that label.  Labels are written after each round;
    nothing is collected but the number of changes.  Loops and repeated edges do no harm; edges with
    a null end are ignored.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("c")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("c").alias("m"))
        moved = labels.join(near, labels.id == near.u).select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        above = labels.select(F.col("id").alias("p"), F.col("c").alias("pc"))
        jumped = moved.join(above, moved.c == above.p, "left").select("id", "was", F.least("c", F.coalesce("pc", "c")).alias("c"))
        now = stored(jumped, "labels")
        changed = now.filter("c <> was").limit(1).count()
        labels = now.select("id", "c")
        if not changed:
            return labels.select("id", F.col("c").alias("component"))
    raise RuntimeError("labels did not settle")
