"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times, at most three.  The whole
part is taken outright; the fractional part is a copy probability.  Probabilities are paired, and in
each pair random mass moves from one document to the other, weighted by document size, until one of
the two is 0 or 1.  A move keeps both expectations and the pair's words, so the words of a source
stay on target; what a group of documents can't settle is one residual a source, and a source's residuals
meet in a reduction tree (groups of groups) until one is left, which is rounded alone.  Every level's
groups are bounded, however many documents, sources or equal rows there are.

Null and empty texts have size 0 and are taken 0 times; null sources form a source of their own,
which sorts last; rows of one id, source and size are alike: they are counted, numbered and count each
time, so null and repeated ids are spread over groups too, whatever their sizes; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that are paired in one group, and residuals of a source that meet in one group of the next level.
GROUP, FAN = 1024, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Sources are taken by code point, null last, with ``weights`` in turn.  A target stops at ``most``
    times the source's size; what is above goes to the others by weight until none is above.  That end
    state is min(most * size, level * weight) for one level, found with running sums over the sources
    sorted by most * size / weight.  Windows without a partition see one row per source only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", share)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", ratio)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("here", F.when(F.col("left") <= F.col("ratio") * F.col("open"), F.col("left") / F.col("open")))
    )
    # "here" is the level if this source is the first that isn't at its cap: that of the first such row holds.
    rows = rows.withColumn("level", F.min(F.when(F.col("here").isNotNull(), F.struct("ratio", -F.col("open"), "here"))).over(everything)["here"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def settle(frac: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounds over one source's probabilities until at most one is fractional."""
    frac = frac.copy()
    active = np.flatnonzero((frac > 0) & (frac < 1))
    while len(active) > 1:
        odd = active[len(active) // 2 * 2 :]
        a, b = active[0 : len(active) // 2 * 2 : 2], active[1::2]
        up = np.minimum((1 - frac[a]) * size[a], frac[b] * size[b])
        down = np.minimum(frac[a] * size[a], (1 - frac[b]) * size[b])
        rise = rng.random(len(a)) * (up + down) < down
        a_first = np.where(rise, (1 - frac[a]) * size[a] <= frac[b] * size[b], frac[a] * size[a] <= (1 - frac[b]) * size[b])
        move = np.where(rise, up, -down)
        new_a, new_b = frac[a] + move / size[a], frac[b] - move / size[b]
        # the one that bounded the move becomes integral, whatever rounding did
        frac[a] = np.where(a_first, np.where(rise, 1.0, 0.0), np.clip(new_a, 0, 1))
        frac[b] = np.where(a_first, np.clip(new_b, 0, 1), np.where(rise, 0.0, 1.0))
        frac[np.abs(frac) < 1e-12] = 0.0
        frac[np.abs(frac - 1) < 1e-12] = 1.0
        both = np.column_stack([a, b]).ravel()
        active = np.concatenate([both[(frac[both] > 0) & (frac[both] < 1)], odd])
    return frac


def _settled(level: int, last: bool):
    """Settles each (shard, source) of a bucket's rows by itself."""

    def of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "size", "k"], kind="stable", na_position="last").reset_index(drop=True)
        frac, size = rows["frac"].to_numpy(), rows["size"].to_numpy().astype(float)
        names = rows["shard"].astype(str) + rows["source"].map(lambda x: "-" if x is None else "=" + x)
        for name, at in names.groupby(names).indices.items():
            rng = np.random.default_rng(zlib.crc32(f"{level}/{name}".encode(errors="replace")))
            frac[at] = settle(frac[at], size[at], rng)
            if last:
                left = at[(frac[at] > 0) & (frac[at] < 1)]
                frac[left] = rng.random(len(left)) < frac[left]
        return rows.assign(frac=frac)

    return of_bucket


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, size: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of all documents; reruns agree.

    ``size`` is a SQL expression for a document's size, by default its number of words.  Only ids,
    sources and sizes are shuffled, never texts.
    """
    words = F.expr(size) if size else F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    counted = docs.select("doc_id", "source", words.cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = stored(counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")), "sizes")
    targets = source_targets(sized, weights, most)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rate = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = (
        sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate").cast("long"))
        .withColumn("frac", F.when(F.col("size") > 0, F.col("rate") - F.col("copies")).otherwise(0.0))
        .withColumn("order", F.xxhash64("doc_id", "source", "size", "k"))
        .drop("rate")
    )
    shards = max(1, math.ceil(sized.count() / GROUP))
    done: list[DataFrame] = []
    buckets, level = shards, 0
    while True:
        last = shards == 1
        # at first a shard's sources are settled in one bucket; then buckets take whole (shard, source) groups
        sharded = rows.withColumn("shard", F.pmod(F.shiftright("order", 5), F.lit(shards)))
        grouped = sharded.withColumn("bucket", F.pmod(F.xxhash64("shard", "source"), F.lit(buckets)) if level else F.col("shard"))
        rows = stored(grouped.groupBy("bucket").applyInPandas(_settled(level, last), grouped.schema).drop("bucket", "shard"), f"mix{level}")
        is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
        done.append(rows.filter(~is_open))
        if last:
            break
        rows, shards, level = rows.filter(is_open), math.ceil(shards / FAN), level + 1
        buckets = max(1, math.ceil(rows.count() / FAN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("copies") + F.col("frac").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
