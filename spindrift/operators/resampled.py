"""Rank correlations of many resamples at once: a resample is a weight of each row, so rows are put in order once.

A row of weight w stands for w equal rows.  As in ``ranks.with_ranks``, a group's values are cut into cells, one for each
cut and one for what lies between two; a value's rank in each resample is the weights of lower cells and, between cuts,
of lower values in the cell.  Only a between-cell is put in order, and cells are as many as keep it at about ``CELL`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..sources.store import stored

#: Rows of a cell between two cuts, about, and the most ranges of a group.
CELL, MOST_RANGES = 20_000, 1024
_SUMS = ("xy", "xz", "yz", "xx", "yy", "zz")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _with(table, name: str, matrix: np.ndarray):
    """``table`` without its last two columns (the cell's weights before it and of its own) and with ``name``."""
    kept = table.column_names[:-2]
    columns = [table.column(c) for c in kept] + [_lists(matrix)]
    return type(table).from_arrays(columns, names=[*kept, name])


def _cut_ranks(name: str, width: int):
    """Twice the ranks of rows whose value is a cut: all of the cell are equal."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, own = (_matrix(batch.column(c), width) for c in ("_before", "_own"))
            yield _with(batch, name, 2 * before + own + 1)

    return of_batches


def _cell_ranks(name: str, value: str, width: int):
    """Twice the ranks of the rows of one cell between two cuts."""

    def of_cell(table: pa.Table) -> pa.Table:
        v, w, before = table.column(value).to_numpy(), _matrix(table.column("w"), width), _matrix(table.column("_before").slice(0, 1), width)
        _, at = np.unique(v, return_inverse=True)
        order = np.argsort(at, kind="stable")
        own = np.add.reduceat(w[order].astype(np.int64), np.searchsorted(at[order], np.arange(at.max() + 1)), axis=0)
        return _with(table, name, (2 * (before + np.cumsum(own, axis=0) - own) + own + 1)[at])

    return of_cell


def _sums(by: int, width: int):
    """Of rows (by..., w, all weights, rx, ry, rz): weighted sums of products of centred ranks for each batch, group and resample."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, n, *r = (_matrix(batch.column(by + k), width) for k in range(5))
            centred = {c: (x - n - 1) / 2.0 for c, x in zip("xyz", r, strict=True)}
            keys = pa.StructArray.from_arrays([batch.column(k) for k in range(by)], names=[str(k) for k in range(by)]).to_pylist()
            codes = {k: i for i, k in enumerate(dict.fromkeys(map(lambda d: tuple(d.values()), keys)))}
            code = np.array([codes[tuple(d.values())] for d in keys])
            for key, i in codes.items():
                on = code == i
                out = [np.einsum("ij,ij,ij->j", w[on].astype(float), centred[p[0]][on], centred[p[1]][on]) for p in _SUMS]
                columns = [pa.array([key[k]] * width, batch.schema.field(k).type) for k in range(by)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, out)], [*batch.schema.names[:by], "k", *_SUMS])

    return of_batches


def _elementwise(column: str, width: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(width)])


def weighted_correlations(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by..., k, n, raw, partial): rank correlation of x and y, and with z held, under the ``k``-th of the ``width`` weights (array ``w``) of each row.

    ``by`` has few groups of strings without nulls, such as (metric, outcome); ``rows`` has (by..., x, y, z, w), stored.
    """
    kind, schema = rows.select(*by).schema, "x double, y double, z double, w array<int>"
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    rows = rows.select(*by, "x", "y", "z", F.col("w").cast("array<int>").alias("w"))
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    ranges = min(MOST_RANGES, max(ranks.RANGES, -(-most // CELL)))
    quantile = lambda c: F.array_sort(F.array_distinct(F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 10 * ranges)))
    cuts = stored(rows.groupBy(*by).agg(*[quantile(c).alias(f"_b{c}") for c in "xyz"]), "cuts")
    celled = ranks._below(rows.join(F.broadcast(cuts), by), {f"_c{c}": (f"_b{c}", c) for c in "xyz"}, ranges)  # one row a group
    celled = celled.withColumns({f"_c{c}": 2 * F.col(f"_c{c}") + F.coalesce(F.get(f"_b{c}", F.col(f"_c{c}")) == F.col(c), F.lit(False)).cast("int") for c in "xyz"}).drop("_bx", "_by", "_bz")
    celled = stored(celled, "celled")
    # weights of each cell, and of those before it
    each = [F.struct(F.lit(c).alias("_i"), F.col(f"_c{c}").alias("_c")) for c in "xyz"]
    cells = celled.select(*by, "w", F.explode(F.array(*each)).alias("_e")).select(*by, "_e.*", "w").groupBy(*by, "_i", "_c").agg(*[F.sum(F.get("w", F.lit(k))).alias(f"_w{k}") for k in range(width)])
    lower = Window.partitionBy(*by, "_i").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # at most twice `ranges` rows a group
    before = F.array(*[F.coalesce(F.sum(f"_w{k}").over(lower), F.lit(0)) for k in range(width)])
    cells = stored(cells.select(*by, "_i", "_c", before.alias("_before"), F.array(*[f"_w{k}" for k in range(width)]).alias("_own")), "cells")
    out = celled
    for c in "xyz":
        placed = out.join(F.broadcast(cells.filter(F.col("_i") == c).drop("_i").withColumnRenamed("_c", f"_c{c}")), [*by, f"_c{c}"]).select(*out.columns, "_before", "_own")
        kept = f"{head}, {schema}, " + ", ".join(f"_c{x} int" for x in "xyz") + "".join(f", r{x} array<bigint>" for x in "xyz"[: "xyz".index(c) + 1])
        is_cut = F.col(f"_c{c}") % 2 == 1
        equal = placed.filter(is_cut).mapInArrow(_cut_ranks(f"r{c}", width), kept)
        between = placed.filter(~is_cut).groupBy(*by, f"_c{c}").applyInArrow(_cell_ranks(f"r{c}", c, width), kept)
        out = stored(equal.unionByName(between), "placed")
    total = stored(celled.groupBy(*by).agg(_elementwise("w", width).alias("n")), "total")
    found = out.join(F.broadcast(total), by).select(*by, "w", "n", "rx", "ry", "rz")
    found = found.mapInArrow(_sums(len(by), width), f"{head}, k int, " + ", ".join(f"{s} double" for s in _SUMS)).groupBy(*by, "k").agg(*[F.sum(s).alias(s) for s in _SUMS])
    return defined(found.join(F.broadcast(total), by).withColumn("n", F.get("n", F.col("k"))), by)


def defined(found: DataFrame, by: list[str]) -> DataFrame:
    """(by..., k, n, raw, partial) from the sums of products of centred ranks; null where undefined."""
    some = F.nullif(F.col("n"), F.lit(0))  # a resample may leave a group without rows
    spread = lambda a, b: F.sqrt(F.col(a) / some) * F.sqrt(F.col(b) / some)
    rho = lambda ab, a, b: F.when((F.col("n") >= 3) & (spread(a, b) > 2.220446049250313e-16), F.try_divide(F.col(ab) / some, spread(a, b)))
    found = found.select(*by, "k", "n", rho("xy", "xx", "yy").alias("raw"), rho("xz", "xx", "zz").alias("_xz"), rho("yz", "yy", "zz").alias("_yz"))
    return found.select(*by, "k", "n", "raw", F.when(F.col("n") >= 4, ranks.partial(F.col("raw"), F.col("_xz"), F.col("_yz"))).alias("partial"))
