"""A Merkle manifest of a data set: digests of rows, of groups and of the whole, with a proof for every row.

Rows are leaves; a group's leaves stand in order and every ``FANOUT`` consecutive nodes have a node above them, until
one remains, the group's root; the groups' roots, in order, have a tree of the same kind above them.

Leaves are numbered by a range sort with offsets from counts of (partition, group), so no task sees a whole group.
A tree is cut into aligned blocks of ``SPAN`` leaves, a power of the fanout.  A task walks a block in postorder: the
recursion returns a subtree's digest and, while it unwinds, appends the siblings of each child to the leaves below it.
Blocks' roots are the leaves of the next traversal, until every tree has one node: n / SPAN rows the next time, so a
group of any size takes few rounds.  From the top down, a block gets the path of its root as one more row that is
sorted before its leaves, and each leaf's path is its own part of the block followed by that of the block.

A null in a field counts as ``-``, so a null isn't an empty text; null groups come first, null keys first in their group.
Repeated keys stand in order of their digests, and equal rows have equal leaves at places of their own.  Texts of any
length are digested where they are read and never shuffled.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

FANOUT = 16
#: Levels and leaves of a block.
LEVELS = 2
SPAN = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
#: Rows of a task's output batch: paths take a few kilobytes a row.
_ROWS = 1024


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place within ``tree`` by ``order`` from 0, and ``n``, the tree's size; stored.

    ``order`` must be total up to rows that may change places.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "ranged")
    counts = ranged.groupBy("tree", "p").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("first"))
    tree = Window.partitionBy("tree")  # at most one row a partition
    before = F.coalesce(F.sum("c").over(tree.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("tree").alias("t"), F.col("p").alias("q"), (before - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n"))
    found = ranged.join(counts, (F.col("tree") == F.col("t")) & (F.col("p") == F.col("q")))
    return stored(found.withColumn("at", F.col("i") + F.col("shift")).drop("p", "q", "i", "t", "shift"), "numbered")


def height(n: int) -> int:
    """Levels of a block in a tree of ``n`` nodes: a whole block's, or as many as bring fewer nodes to one."""
    h = 0
    while FANOUT**h < min(n, SPAN):
        h += 1
    return h


def walk(nodes: list[str], lo: int, hi: int, levels: int, paths: list[list[tuple[str, str]]]) -> str:
    """The digest ``levels`` above ``nodes[lo:hi]``; the siblings of every subtree are appended to its leaves' paths."""
    if not levels:
        return nodes[lo]
    step = FANOUT ** (levels - 1)
    below = [walk(nodes, a, min(a + step, hi), levels - 1, paths) for a in range(lo, hi, step)]
    for i, a in enumerate(range(lo, hi, step)):
        siblings = ("".join(below[:i]), "".join(below[i + 1 :]))
        for path in paths[a : min(a + step, hi)]:
            path.append(siblings)
    return hashlib.sha256("".join(below).encode()).hexdigest()


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """((tree, block), rows) of sorted batches whose first columns are tree and block; a block at a time."""
    rows = chain.from_iterable(zip(*b.to_pydict().values(), strict=True) for b in batches)
    return ((key, list(own)) for key, own in groupby(rows, key=itemgetter(0, 1)))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "at", "n", "digest"])

    for (tree, block), rows in _blocks(batches):
        nodes, n = [r[4] for r in rows], rows[0][3]
        out.append((tree, block, -(-n // SPAN), walk(nodes, 0, len(nodes), height(n), [[] for _ in nodes])))
        if len(out) == _ROWS:
            yield told()
            out.clear()
    yield told()


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, at, n, digest), their blocks' roots, those roots' blocks' roots and so on, until every tree has one; stored."""
    levels = [nodes]
    while levels[-1].filter("n > 1").limit(1).count():
        rows = levels[-1].select("tree", F.floor(F.col("at") / SPAN).alias("block"), "at", "n", "digest")
        levels.append(stored(_by_block(rows).mapInArrow(_roots, "tree string, at bigint, n bigint, digest string"), "roots"))
    return levels


def _pathed(kinds: list[pa.DataType], names: list[str]):
    """Leaves with their paths; a block's first row has the block's own path and what is known of its tree."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for (tree, _), rows in _blocks(batches):
            head, leaves = rows[0], rows[1:]
            above = [(s["left"], s["right"]) for s in head[5]]
            nodes, n = [r[4] for r in leaves], leaves[0][3]
            paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
            walk(nodes, 0, len(nodes), height(n), paths)
            for r, path in zip(leaves, paths, strict=True):
                out.append((tree, r[2], [{"left": a, "right": b} for a, b in path + above], head[6], head[7], r[4], *r[8:]))
                if len(out) == _ROWS:
                    yield told()
                    out.clear()
        yield told()

    return of_batches


def _paths(nodes: DataFrame, above: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, at, path, subroot, root, digest, payload...) of ``nodes``, given (tree, at, path, subroot, root) of their blocks."""
    empty = lambda names: [F.lit(None).cast(k).alias(c) for c, k in names]
    fields = [nodes.schema[c] for c in payload]
    own = nodes.select("tree", F.floor(F.col("at") / SPAN).alias("block"), "at", "n", "digest", *empty([("path", PATH), ("subroot", "string"), ("root", "string")]), *payload)
    heads = above.select("tree", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), *empty([("n", "bigint"), ("digest", "string")]), "path", "subroot", "root", *empty([(f.name, f.dataType) for f in fields]))
    schema = T.StructType([*T._parse_datatype_string(f"tree string, at bigint, path {PATH}, subroot string, root string, digest string").fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.string(), pa.int64(), pa.list_(_STEP), pa.string(), pa.string(), pa.string(), *[to_arrow_type(f.dataType) for f in fields]]
    return _by_block(own.unionByName(heads)).mapInArrow(_pathed(kinds, [f.name for f in schema.fields]), schema)


def descended(levels: list[DataFrame], tops: DataFrame, payload: list[str]) -> DataFrame:
    """Paths of the lowest level's nodes, with ``payload``, given (tree, path, subroot, root) of each tree's one top node."""
    above = tops.withColumn("at", F.lit(0).cast("bigint"))
    if len(levels) == 1:
        return levels[0].join(above.drop("at"), "tree").select("tree", "at", "path", "subroot", "root", "digest", *payload)
    for nodes in reversed(levels[1:-1]):
        above = stored(_paths(nodes, above, []), "paths")
    return _paths(levels[0], above, payload)


def manifest(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, key, digest, path, subroot, root, payload...) of every leaf of ``leaves`` (grp, key, digest, payload...).

    A path holds the digests to the left and to the right of the leaf's own node, level by level up to the root.
    """
    rows = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("")))  # null first, then bytewise
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # so that equal rows are dealt out too
    low = climbed(numbered(rows, ["key", "digest", "tie"]))
    groups = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("grp_key"), "digest")
    high = climbed(numbered(groups, ["grp_key"]))
    none = F.lit(None).cast("string")
    top = high[-1].select("tree", F.array().cast(PATH).alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
    tops = descended(high, top, ["grp_key"])
    tops = stored(tops.select(F.col("grp_key").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    return descended(low, tops, ["grp", "key", *payload]).select("grp", "key", "digest", "path", "subroot", "root", *payload)


def siblings_digest(path: Column) -> Column:
    """Of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, by source and doc_id, held against rows of which a fifth is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *others, text = [F.col(c) for c in FIELDS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf([*others, lowered(text)]))
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), leaf([*others, text]).alias("digest"), altered.alias("altered"))
    proofs = manifest(rows, ["altered"])
    found = proofs.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
