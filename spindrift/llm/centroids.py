"""Centroid clustering in whole numbers, with nearest centroids by annulus search.

Vectors become integers, floor(256 x), once, and are stored as such; every later pass reads that table.  A round is
one pass: centroids are sorted by norm, a vector's distance to the centroids of nearest norm bounds the distance
to its nearest one, and by the triangle inequality only centroids whose norm is within that bound of the vector's
own can be as near.  Binary search gives them as a range of the sorted norms (widened by more than the rounding
error of a root, so that ties on its border are in), and they are compared by exact squared distances, the smaller
number first.  A task gives one row of sums for each centroid; ``k`` rows reach the driver, no vectors.

Sums and distances are exact: components are whole numbers of at most 2^26 in size (x within 2^18; a larger one is an
error rather than a wrong distance).  Vectors that are null, have other than 64 components, or hold null or
non-finite ones are left out.  Rows are clustered each by itself, so repeated rows and repeated ids get a result
each; of equal ids, the start takes the least vectors first, and rows with a null id come last there.  With fewer
vectors than ``k`` there are as many centroids; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

WIDTH, K, ROUNDS = 64, 40, 5
SCALE = 256
#: Components' size at most, and up to which 53-bit floats hold all products and sums.
MOST, FLOATS = 1 << 26, 1 << 20
#: Centroids of nearest norm that bound a vector's distance.
NEAR = 3


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their components) of the lists of the right length without null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    numbers = np.asarray(values.fill_null(np.nan), dtype=np.float64)
    offsets = np.asarray(column.offsets)
    rows = np.flatnonzero((np.diff(offsets) == WIDTH) & np.asarray(column.is_valid()))
    x = numbers[offsets[rows][:, None] + np.arange(WIDTH)]
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, x = _lists(batch.column(1))
        x = np.floor(SCALE * x)
        if len(x) and np.abs(x).max() > MOST:
            raise ValueError(f"a component beyond {MOST // SCALE} can't be clustered in whole numbers")
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.astype(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), v], ["vec_id", "v"])


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can be clustered, as whole numbers; stored."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("v", T.ArrayType(T.IntegerType()))])
    return stored(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_whole, schema), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, WIDTH).astype(np.int64)


class Annulus:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(float))
        self.large = len(centroids) > 0 and int(np.abs(centroids).max()) > FLOATS

    def _distances(self, x: np.ndarray, floats: np.ndarray | None, squares: np.ndarray, rows: np.ndarray, j: int) -> np.ndarray:
        if floats is None:
            d = x[rows] - self.centroids[j]
            return (d * d).sum(axis=1)
        part = floats if len(rows) == len(floats) else floats[rows]
        return squares[rows] + int(self.squares[j]) - 2 * (part @ self.centroids[j].astype(float)).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each vector, of ties the smaller number; and how many distances were taken."""
        n, k = len(x), len(self.norms)
        floats = None if self.large or int(np.abs(x).max(initial=0)) > FLOATS else x.astype(float)
        squares = (x * x).sum(axis=1)
        norms = np.sqrt(squares.astype(float))
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)

        def compare(rows: np.ndarray, j: int) -> None:
            d, c = self._distances(x, floats, squares, rows, j), self.number[j]
            closer = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[closer]], number[rows[closer]] = d[closer], c

        first = np.clip(np.searchsorted(self.norms, norms) - NEAR // 2, 0, max(0, k - NEAR))
        stop = np.minimum(first + NEAR, k)
        taken = int((stop - first).sum())
        for j in range(k):
            rows = np.flatnonzero((first <= j) & (j < stop))
            if len(rows):
                compare(rows, j)
        reach = np.sqrt(best.astype(float))
        slack = 1e-6 + 1e-9 * (norms + reach)
        lo, hi = np.searchsorted(self.norms, norms - reach - slack), np.searchsorted(self.norms, norms + reach + slack, "right")
        for j in range(int(lo.min(initial=k)), int(hi.max(initial=0))):
            rows = np.flatnonzero((lo <= j) & (j < hi) & ((j < first) | (j >= stop)))
            if len(rows):
                taken += len(rows)
                compare(rows, j)
        return number, best, taken


def _sums(centroids: np.ndarray):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annulus(centroids), len(centroids)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, WIDTH), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            number, _, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            some, at = np.unique(number[order], return_index=True)
            if len(some):
                sums[some] += np.add.reduceat(x[order], at, axis=0)
            n += np.bincount(number, minlength=k)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on]), *[pa.array(sums[on, i]) for i in range(WIDTH)]], ["c", "n", *[f"s{i}" for i in range(WIDTH)]])

    return of_batches


def start(whole: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors of smallest digest of their id, in that order."""
    rows = whole.withColumn("h", F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, WIDTH)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    columns = [f"s{i}" for i in range(WIDTH)]
    found = whole.select("v").mapInArrow(_sums(centroids), "c bigint, n bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = found.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()  # one row a centroid
    out = centroids.copy()
    for r in rows:
        out[r["c"]] = [r[c] // r["n"] for c in columns]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; stored."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            number, distance, _ = search.nearest(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    schema = T.StructType([whole.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return stored(whole.mapInArrow(of_batches, schema), "assigned")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after ``rounds`` rounds and one more assignment."""
    whole = whole_vectors(vectors)
    centroids = start(whole, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(whole, centroids)
    return assigned(whole, centroids), centroids


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings``."""
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    inertia = [sums.get(i, 0) for i in range(len(centroids))]
    return rows.select("vec_id", "cluster", "distance", of(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
