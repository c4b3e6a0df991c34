"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  They are rotated by a fixed random
orthogonal matrix and split into blocks of eight coordinates; the squared distance is the sum over
the blocks, so some block of a linked pair has at most its proportional share.  Each block is
range-joined under that share.  The union of the blocks' candidates is verified with exact cosines in
double precision, each pair in the first block that has it within budget, so nothing is counted twice
and no pairs are emitted: a task gives every vector's number of links and a label for its connected part.

The range join of a block uses a k-d tree over its eight coordinates.  The tree is fitted on a bounded
sample (``SAMPLE`` vectors, those with the least hash), its leaves are as many as the vectors ask for
(``MOST_LEAVES`` at most); every vector has a home leaf and visits the leaves whose boxes are within
the share of it, of each two leaves in one direction only.  In a task the leaf's own vectors are halved
along their widest coordinate again and again, and what is compared with them is thinned out by the
halves' boxes, until few are left on the one side; those are compared by squared distance.  The
sample decides how evenly leaves are filled, never what is compared.

Equal vectors collapse into one class before the join.  Leaves with more vectors than a tile are split
into tiles on both sides: a task compares one tile of a leaf's own vectors with one tile of all that
are there, so that its rows (bounded by bytes) don't grow, however many vectors lie near one point.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and
vectors of different lengths do not link; a repeated row is the same vector, not another one; rows
with a null vec_id take no part and count as kept.  Other columns (as ``label``) are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import stored

COSINE = 0.95
BLOCK_WIDTH = 8
#: Vectors on either side of a task at most, about (a tile of a leaf's own, of those compared with them as many, and as many visitors), and their components.
TILE, TILE_COMPONENTS = 16_384, 1 << 20
#: Vectors that trees are fitted on at most, leaves of a tree at most, and vector lengths that get trees (the most frequent ones; others have one leaf).
SAMPLE, MOST_LEAVES, LENGTHS = 65_536, 4096, 16
#: Vectors that are compared with all that their box leaves, and candidates that are verified together.
_FEW, _PAIRS = 128, 1 << 16


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240607 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    n = max(1, dim // BLOCK_WIDTH)
    edges = [round(i * dim / n) for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance, in proportion to its width."""
    total = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    return np.array([(b.stop - b.start) / dim * total for b in blocks_of(dim)])


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Tree:
    """A k-d tree over a block's coordinates; leaves are numbered from 0, nodes from 1 as in a heap."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.leaves = leaves
        self.axis, self.value = np.zeros(leaves, dtype=np.int64), np.zeros(leaves)
        rows = {1: np.arange(len(sample))}
        for node in range(1, leaves):
            own = rows.pop(node)
            if len(own):
                self.axis[node] = c = int(sample[own].std(axis=0).argmax())
                self.value[node] = np.median(sample[own, c])
            right = sample[own, self.axis[node]] > self.value[node]
            rows[2 * node], rows[2 * node + 1] = own[~right], own[right]

    def homes(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            at = 2 * at + (x[np.arange(len(x)), self.axis[at]] > self.value[at])
        return at - self.leaves

    def near(self, x: np.ndarray, budget: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) of all rows of ``x`` whose squared distance from the leaf's box is within the budget."""
        todo = [(1, np.arange(len(x)), np.zeros_like(x))]
        while todo:
            node, rows, off = todo.pop()
            if node >= self.leaves:
                yield node - self.leaves, rows
                continue
            c, beyond = self.axis[node], x[rows, self.axis[node]] - self.value[node]
            for child, over in ((2 * node, beyond), (2 * node + 1, -beyond)):
                out = off.copy()
                out[:, c] = np.maximum(out[:, c], over)
                on = (out * out).sum(axis=1) <= budget
                if on.any():
                    todo.append((child, rows[on], out[on]))


def tile_of(dim: int) -> int:
    return max(64, min(TILE, TILE_COMPONENTS // max(1, dim)))


def _fitted(classes: DataFrame) -> dict[int, list[Tree]]:
    """The trees of each block by vector length, from a bounded sample of (id, e) classes."""
    counts = classes.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    wanted = {r["dim"]: 1 << max(0, (r["n"] // tile_of(r["dim"])).bit_length()) for r in counts if r["n"] > tile_of(r["dim"])}
    if not wanted:
        return {}
    share = {dim: max(1, min(SAMPLE, (1 << 23) // dim) // len(wanted)) for dim in wanted}
    trees = {}
    for dim, leaves in wanted.items():
        rows = classes.filter(F.size("e") == dim).orderBy(F.xxhash64("id"), "id").limit(share[dim]).select("e").toArrow()
        x = np.array(rows.column(0).combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None] @ rotation(dim)
        trees[dim] = [Tree(x[:, at], min(leaves, MOST_LEAVES)) for at in blocks_of(dim)]
    return trees


def _places(trees, cosine: float, kind: str) -> Callable:
    """Of a batch of classes (id, weight, vec): (rows, dim, block, leaf, home), an array of rows at a time."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int, int, bool]]:
        raw = batch.column(2).to_pylist()
        sizes = np.array([len(v) for v in raw])
        for size in np.unique(sizes):
            part = np.flatnonzero(sizes == size)
            unit = _unit([raw[i] for i in part], kind)
            dim = unit.shape[1]
            turned = unit @ rotation(dim)
            for b, (at, budget) in enumerate(zip(blocks_of(dim), budgets(dim, cosine), strict=True)):
                if dim not in trees.value:
                    yield part, dim, b, 0, True
                    continue
                tree, x = trees.value[dim][b], turned[:, at]
                home = tree.homes(x)
                for leaf, rows in tree.near(x, budget * (1 + 1e-6)):
                    own = home[rows] == leaf
                    towards = (home[rows] < leaf) == ((home[rows] + leaf) % 2 == 1)  # of two leaves, one side visits the other
                    yield part[rows[own]], dim, b, leaf, True
                    yield part[rows[~own & towards]], dim, b, leaf, False

    return of_batch


def _cells(places):
    """Rows (dim, block, leaf, home, id, weight, vec) of classes (id, weight, vec) in their home leaves and those they visit."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, *at, home in places(batch):
                if n := len(rows):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k)) for k in at), pa.array(np.full(n, home)), *batch.take(pa.array(rows)).columns], ["dim", "block", "leaf", "home", "id", "weight", "vec"])

    return of_batches


def _sizes(places):
    """(dim, block, leaf, own, visitors): how many rows a batch has in each leaf."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*at, len(rows) * home, len(rows) * (not home)) for rows, *at, home in places(batch) if len(rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["dim", "block", "leaf", "own", "visitors"])

    return of_batches


def _least_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Gives each connected part of the links (u, v) its least label."""
    while True:
        was = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        if (was == label).all():
            return


def within_budget(x: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, compared) with all pairs of ``left`` and ``right`` rows of ``x`` within a squared distance, and how many pairs were compared for them."""
    norm, todo = (x * x).sum(axis=1), [(left, right)]
    while todo:
        a, b = todo.pop()
        low, high = x[a].min(axis=0), x[a].max(axis=0)
        off = np.maximum(np.maximum(low - x[b], x[b] - high), 0)
        b = b[np.einsum("ij,ij->i", off, off) <= budget]
        if not len(b):
            continue
        if len(a) <= _FEW:
            i, j = np.nonzero(norm[a][:, None] + norm[b][None, :] - 2 * (x[a] @ x[b].T) <= budget)
            yield a[i], b[j], len(a) * len(b)
        else:
            half = np.argpartition(x[a, (high - low).argmax()], len(a) // 2)
            todo += [(a[half[: len(a) // 2]], b), (a[half[len(a) // 2 :]], b)]


def _together(pairs: Iterator[tuple], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same (i, j) pairs, about ``size`` at a time."""
    held: list[tuple] = []
    for i, j, _ in pairs:
        for k in range(0, len(i), size):
            held.append((i[k : k + size], j[k : k + size]))
            if sum(len(x) for x, _ in held) >= size:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _linked(cosine: float, kind: str):
    def of_tiles(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, block, _, one, other = key
        unit = _unit(list(rows["vec"]), kind)
        turned = unit @ rotation(dim)
        ids, weight, home, tiles = (rows[k].to_numpy() for k in ("id", "weight", "home", "tile_of"))
        at, share = blocks_of(dim), budgets(dim, cosine)
        own = np.ascontiguousarray(turned[:, at[block]], dtype=np.float32)
        left, right = np.flatnonzero(home & (tiles == one)), np.flatnonzero(~home | (tiles == other))
        links, label = np.zeros(len(ids), dtype=np.int64), ids.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        near = within_budget(own, left, right, share[block] + 1e-5) if len(left) and len(right) else ()
        for u, v in _together(near, _PAIRS):
            once = ~home[v] | (tiles[v] != one) | (ids[u] < ids[v])
            u, v = u[once], v[once]
            ok = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            u, v = u[ok], v[ok]
            apart = (turned[u] - turned[v]) ** 2
            within = np.column_stack([apart[:, s].sum(axis=1) <= most for s, most in zip(at, share, strict=True)])
            first = within[:, block] & (within.argmax(axis=1) == block)
            u, v = u[first], v[first]
            if not len(u):
                continue
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            # links of these rows, as many as there are rows at most: each with the first of its part
            part = np.arange(len(ids))
            _least_labels(part, u, v)
            u = np.flatnonzero(part != np.arange(len(ids)))
            found.append((u, part[u]))
        if found:
            _least_labels(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
        on = links > 0
        return pd.DataFrame({"id": ids[on], "links": links[on], "label": label[on]})

    return of_tiles


def _tiled(cells: DataFrame) -> DataFrame:
    """Rows of ``cells`` for each pair of tiles (``one`` of a leaf's own vectors, ``other``) that they are compared in.

    ``own`` and ``visitors`` count a leaf's rows.  Own rows are dealt over the first tiles, visitors over all; an
    own row meets other own rows in pairs of tiles in order, so no pair comes twice.
    """
    tile = F.greatest(F.lit(64), F.least(F.lit(TILE), F.floor(F.lit(TILE_COMPONENTS) / F.col("dim"))))
    left = F.ceil(F.col("own") / tile).cast("int")
    right = F.ceil((F.col("own") + F.col("visitors")) / tile).cast("int")  # at least as many as on the left
    at = F.col("tile_of")
    pair = lambda one, other: F.struct(one.alias("one"), other.alias("other"))
    as_other = F.when(at > 0, F.transform(F.sequence(F.lit(0), at - 1), lambda k: pair(k, at))).otherwise(F.array().cast("array<struct<one:int,other:int>>"))
    of_own = F.concat(F.transform(F.sequence(F.lit(0), right - 1), lambda k: pair(at, k)), as_other)
    of_visitor = F.transform(F.sequence(F.lit(0), left - 1), lambda k: pair(k, at))
    rows = cells.withColumn("tile_of", F.pmod(F.xxhash64("id"), F.when(F.col("home"), left).otherwise(right)).cast("int"))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("home"), of_own).otherwise(of_visitor)))
    return rows.select("*", "pair.one", "pair.other").drop("pair", "own", "visitors")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    exact = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{exact}>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    once = rows.filter("sound").select("vec_id", "e").distinct()
    grouped = once.groupBy("e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, dtype=kind).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "weight", "vec"])

    classes = stored(grouped, "vectors")
    plain = stored(classes.select("id", "weight", "e").mapInArrow(packed, "id bigint, weight bigint, vec binary"), "packed")
    trees = rows.sparkSession.sparkContext.broadcast(_fitted(classes))  # bounded by MOST_LEAVES
    places = _places(trees, cosine, kind)
    at = ["dim", "block", "leaf"]
    # one row a leaf, of which there are MOST_LEAVES a block at most
    sizes = plain.mapInArrow(_sizes(places), "dim bigint, block bigint, leaf bigint, own bigint, visitors bigint").groupBy(*at).agg(F.sum("own").alias("own"), F.sum("visitors").alias("visitors")).filter("own > 0")
    cells = plain.mapInArrow(_cells(places), "dim bigint, block bigint, leaf bigint, home boolean, id bigint, weight bigint, vec binary")
    cells = _tiled(cells.join(F.broadcast(sizes), at))  # so that tiles, not leaves, are dealt to tasks
    found = stored(cells.groupBy(*at, "one", "other").applyInPandas(_linked(cosine, kind), "id bigint, links bigint, label bigint"), "near")
    counts = found.groupBy(F.col("id").alias("_id")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))).withColumnRenamed("id", "_part")
    told = (
        classes.join(counts, F.col("id") == F.col("_id"), "left").join(parts, F.col("id") == F.col("_part"), "left")
        .select(F.col("e").alias("_e"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    )
    joined = rows.join(told, F.col("sound") & (F.col("e") == F.col("_e")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embeddings(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
