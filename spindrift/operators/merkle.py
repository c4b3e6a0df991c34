"""One digest of any number of rows, as a tree whose nodes cover bounded groups, with inclusion checks.

Rows are numbered by ranges and every ``WIDTH`` consecutive digests have a node above them, the digest of theirs joined by
line feeds, until one is left.  A task holds a node's children only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .numbering import counted

WIDTH = 1024


def canonical_row(columns: list[str]) -> Column:
    """A row as JSON with its keys in order; nulls are written out."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def tree(rows: DataFrame, order: list[str], digest: str, width: int = WIDTH) -> list[DataFrame]:
    """Levels (at, digest) from the rows' own digests in ``order`` up to the one row of the root; stored.  No rows: one empty level."""
    levels = [counted(rows.select(*dict.fromkeys([*order, digest])), [], order, "at").select("at", F.col(digest).alias("digest"))]
    while levels[-1].limit(2).count() > 1:
        nodes = levels[-1].groupBy(F.floor(F.col("at") / width).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c"))  # at most `width` a node
        levels.append(stored(nodes.select(F.col("up").alias("at"), F.sha2(F.array_join(F.col("c.digest"), "\n"), 256).alias("digest")), "nodes"))
    return levels


def root(levels: list[DataFrame]) -> str:
    """The root's digest; that of nothing for no rows."""
    found = levels[-1].select("digest").first()
    return found["digest"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def content_digest(df: DataFrame, width: int = WIDTH) -> str:
    """The digest of a table's rows, whatever their order and partitions; repeated rows count each."""
    rows = df.select(F.sha2(canonical_row(df.columns), 256).alias("digest")).withColumn("tie", F.monotonically_increasing_id())
    return root(tree(stored(rows, "digests"), ["digest", "tie"], "digest", width))


def inclusion(levels: list[DataFrame], claimed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(at, digest, included) for each claim (at, digest): whether the leaf stands there in the tree with this root.

    A claim is folded upwards: in its node's children its digest takes the leaf's place, and the node's digest must be
    that of the level above, up to the root.
    """
    state = claimed.select("at", "digest", F.col("at").alias("_at"), F.col("digest").alias("_now"))
    for level in levels[:-1]:
        nodes = level.groupBy(F.floor(F.col("at") / width).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_c"))
        joined = state.withColumn("_node", F.floor(F.col("_at") / width)).join(nodes, F.col("_node") == F.col("_up"), "left")
        folded = F.sha2(F.array_join(F.transform("_c", lambda c: F.when(c["at"] == F.col("_at"), F.col("_now")).otherwise(c["digest"])), "\n"), 256)
        inside = F.exists("_c", lambda c: c["at"] == F.col("_at"))
        state = joined.withColumn("_up_now", F.when(F.coalesce(inside, F.lit(False)), folded)).select("at", "digest", F.col("_node").alias("_at"), F.col("_up_now").alias("_now"))
    top = levels[-1].select(F.col("at").alias("_rat"), F.col("digest").alias("_root"))
    found = state.join(F.broadcast(top), F.col("_at") == F.col("_rat"), "left")  # one row
    return found.select("at", "digest", F.coalesce(F.col("_now") == F.col("_root"), F.lit(False)).alias("included"))
