"""Many replicates of groups that a task can hold: a task makes the draws of a block of replicates itself, so no drawn row is shuffled.

The draws are those of ``resampling.hashed_draw``: the first 32 bits of the MD5 of "purpose|seed|...", here of whole arrays
of messages at once.  A task gets the rows of a group once for each block of replicates; groups over ``MOST`` rows are left
to the ways that deal a group's rows to many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampled import _SUMS

#: Rows of a group that one task holds at most, rows of small groups that share a task, blocks of replicates and a block's least.
MOST, SHARED, BLOCKS, LEAST = 2_000_000, 500_000, 32, 25
#: Numbers that are worked on at once: messages in the processor's cache, and draws of some replicates.
TILE, CHUNK = 32_768, 1 << 17
_ROUNDS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fit into MD5's one block.
_ROOM = 55


def _md5_head(words: list, shape: tuple[int, int]) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block; ``words`` are its sixteen, numbers or arrays that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps don't change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            k = 7 * i % 16
        turn = _ROUNDS[i // 16][i % 4]
        f += a
        f += np.uint32((words[k] + _SINES[i]) & 0xFFFFFFFF) if isinstance(words[k], int) else words[k] + np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


class Draws:
    """Draws of messages ``before`` + replicate + one of ``after``."""

    def __init__(self, before: bytes, after: list[bytes]):
        self.before, self.after = before, after
        self.lengths = np.array([len(x) for x in after], np.int64)
        self._words: dict[int, np.ndarray] = {}

    def _columns(self, digits: int) -> np.ndarray:
        """The words' parts after the replicate, for replicates of so many digits; messages that are too long have none."""
        if digits not in self._words:
            self._words.clear()
            start = len(self.before) + digits
            fits = np.flatnonzero(start + self.lengths <= _ROOM)
            block = np.zeros((len(self.after), 64), np.uint8)
            if len(fits):
                width = max(1, int(self.lengths[fits].max()))
                text = np.array([self.after[i] for i in fits], f"S{width}").view(np.uint8).reshape(len(fits), width)
                block[fits, start : start + width] = text
                block[fits, start + self.lengths[fits]] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14, fits] = 8 * (start + self.lengths[fits])
            self._words[digits] = words
        return self._words[digits]

    def of(self, replicates: range) -> np.ndarray:
        """uint32 draws, a row for each replicate."""
        out = np.empty((len(replicates), len(self.after)), np.uint32)
        done = 0
        while done < len(replicates):
            digits = len(str(replicates[done]))
            some = [r for r in replicates[done:] if len(str(r)) == digits]
            self._fill(out[done : done + len(some)], some, digits)
            done += len(some)
        return out

    def _fill(self, out: np.ndarray, replicates: list[int], digits: int) -> None:
        start = len(self.before) + digits
        if start <= _ROOM:
            heads = b"".join((self.before + str(r).encode()).ljust(64, b"\0") for r in replicates)
            heads = np.frombuffer(heads, "<u4").reshape(-1, 16)
            columns = self._columns(digits)
            high = max(1, min(len(replicates), TILE // max(1, len(self.after))))
            wide = max(1, TILE // high)
            for x in range(0, len(self.after), wide):
                part = columns[:, x : x + wide]
                same = [int(w[0]) if (w == w[0]).all() else None for w in part]
                for y in range(0, len(replicates), high):
                    words = []
                    for k in range(16):
                        head = heads[y : y + high, k : k + 1]
                        head = int(head[0, 0]) if (head == head[0, 0]).all() else head
                        tail = part[k : k + 1] if same[k] is None else same[k]
                        if isinstance(head, int) and isinstance(tail, int):
                            words.append(head | tail)
                        else:
                            words.append((np.uint32(head) if isinstance(head, int) else head) | (np.uint32(tail) if isinstance(tail, int) else tail))
                    out[y : y + high, x : x + wide] = _md5_head(words, out[y : y + high, x : x + wide].shape)
        for i in np.flatnonzero(start + self.lengths > _ROOM):
            out[:, i] = [int(hashlib.md5(self.before + str(r).encode() + self.after[i]).hexdigest()[:8], 16) for r in replicates]


def _blocks(rows: DataFrame, keys: list[str], groups: int, replicates: int) -> tuple[DataFrame, int]:
    """``rows`` once for each block ``_block`` of so many replicates, dealt out by key and block."""
    width = max(LEAST, -(-replicates // BLOCKS))
    blocks = -(-replicates // width)
    each = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.repartition(min(2 * groups * blocks, 2_000), *keys, "_block"), width


def _order(column: pa.ChunkedArray) -> np.ndarray:
    """Each value's place among the distinct ones in Spark's order, nulls first."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    return place[coded.indices.to_numpy(zero_copy_only=False)]


def _codes(table: pa.Table, names: list[str]) -> tuple[list[dict], np.ndarray]:
    """The distinct values of ``names``, and each row's."""
    parts = [table.column(n).combine_chunks().dictionary_encode(null_encoding="encode") for n in names]
    code = np.zeros(table.num_rows, np.int64)
    for p in parts:
        code = code * len(p.dictionary) + p.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return table.select(names).take(pa.array(first)).to_pylist(), code


def _messages(column: pa.ChunkedArray) -> list[bytes]:
    return [b"" if x is None else b"|" + x.encode() for x in column.to_pylist()]


def _ranges(replicates: int, width: int, block: int, rows: int) -> Iterator[range]:
    """The block's replicates from 1, as many at once as make ``CHUNK`` draws."""
    last = min(replicates, (block + 1) * width)
    step = max(1, CHUNK // max(1, rows))
    for first in range(block * width + 1, last + 1, step):
        yield range(first, min(first + step, last + 1))


def _permuted_sums(pair: list[str], replicates: int, width: int, seed: int):
    """Of rows of some strata: (pair..., r, a, b, c), products' sums of each replicate."""
    before = f"perm|{seed}|".encode()

    def of_stratum(rows: pa.Table, pairs: np.ndarray, n_pairs: int, block: int) -> np.ndarray:
        units = _order(rows.column("unit"))
        by = np.lexsort((units, pairs))
        again = np.zeros(len(by), np.int64)  # which of its unit's rows in the pair a row is
        starts = np.flatnonzero(np.r_[True, (np.diff(units[by]) != 0) | (np.diff(pairs[by]) != 0)])
        again[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        _, first, at = np.unique(units * (again.max() + 1) + again, return_index=True, return_inverse=True)
        draws, n = Draws(before, _messages(rows.column("_text").take(pa.array(first)))), len(first)
        held = []
        for p in np.unique(pairs):
            on = np.flatnonzero(pairs == p)
            on = on[np.argsort(at[on])]
            place = None
            if len(on) < n:
                place = np.full(n, -1, np.int64)
                place[at[on]] = np.arange(len(on))
            px, py, pz, qx, qy = (rows.column(c).to_numpy()[on] for c in ("px", "py", "pz", "qx", "qy"))
            held.append((p, place, px, py, np.stack([qx, pz], axis=1), qy))
        out, done = [], np.arange(n, dtype=np.uint64)
        for some in _ranges(replicates, width, block, n):
            keys = draws.of(some).astype(np.uint64)
            keys <<= np.uint64(32)
            keys |= done
            keys.sort(axis=1)
            keys &= np.uint64(0xFFFFFFFF)
            order, sums = keys.view(np.int64), np.zeros((len(some), n_pairs, 3))
            for p, place, px, py, qxz, qy in held:
                own = order
                if place is not None:
                    own = place[order]
                    own = own[own >= 0].reshape(len(some), -1)
                sums[:, p, 0] = py[own] @ px
                sums[:, p, 1:] = qy[own] @ qxz
            out.append(sums)
        return np.concatenate(out)

    def of_group(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        names, pairs = _codes(table, pair)
        strata = _order(table.column("stratum"))
        by, sums = np.argsort(strata, kind="stable"), 0.0
        for on in np.split(by, np.flatnonzero(np.diff(strata[by])) + 1):
            sums = sums + of_stratum(table.take(pa.array(on)), pairs[on], len(names), block)
        r = np.arange(block * width + 1, block * width + 1 + len(sums))
        out = {c: pa.array([name[c] for name in names for _ in r], table.schema.field(c).type) for c in pair}
        flat = sums.transpose(1, 0, 2).reshape(-1, 3)
        return pa.table({**out, "r": pa.array(np.tile(r, len(names)).astype(np.int32)), **{c: pa.array(np.ascontiguousarray(flat[:, k])) for k, c in enumerate("abc")}})

    return of_group


def permuted_sums(rows: DataFrame, pair: list[str], replicates: int, seed: int) -> DataFrame:
    """(pair..., r, a, b, c): sums of px * py, qx * qy and pz * qy, with py and qy of each stratum put in order of hashed draws and unit.

    ``rows`` has (pair..., stratum, unit, px, py, pz, qx, qy), strata of at most ``MOST`` rows; small ones share tasks.
    """
    bins = -(-rows.count() // SHARED) or 1
    dealt = rows.select(*pair, "stratum", "unit", F.col("unit").cast("string").alias("_text"), "px", "py", "pz", "qx", "qy", F.pmod(F.xxhash64("stratum"), F.lit(bins)).alias("_bin"))
    dealt, width = _blocks(dealt, ["_bin"], bins, replicates)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*pair).schema)
    found = dealt.groupBy("_bin", "_block").applyInArrow(_permuted_sums(pair, replicates, width, seed), f"{head}, r int, a double, b double, c double")
    return found.groupBy(*pair, "r").agg(*[F.sum(c).alias(c) for c in "abc"])


def _resampled_sums(pair: list[str], replicates: int, width: int, seed: int, whole: bool):
    """Of a pair's rows: (pair..., k, n, weighted sums of products of centred ranks)."""

    def of_group(table: pa.Table) -> pa.Table:
        block, rows = table.column("_block")[0].as_py(), table.num_rows
        strata = _order(table.column("stratum"))
        by = np.arange(rows) if whole else np.lexsort((_order(table.column("unit")), strata))
        by = by[np.argsort(strata[by], kind="stable")]
        table, strata = table.take(pa.array(by)), strata[by]
        starts = np.flatnonzero(np.r_[True, np.diff(strata) != 0])
        sizes = np.diff(np.r_[starts, rows])
        numbers = lambda n: [f"|{i}".encode() for i in range(n)]
        if whole:
            draws = [(0, len(starts), Draws(f"whole|{seed}|".encode(), numbers(len(starts))))]
        else:
            texts = [b"" if x is None else x.encode() + b"|" for x in table.column("_text").take(pa.array(starts)).to_pylist()]
            draws = [(s, n, Draws(f"boot|{seed}|".encode() + t, numbers(n))) for s, n, t in zip(starts, sizes, texts, strict=True)]
        values = [np.unique(table.column(c).to_numpy() + 0.0, return_inverse=True)[1] for c in "xyz"]
        out = []
        for some in _ranges(replicates, width, block, rows):
            picks = np.concatenate([d.of(some) % np.uint32(n) + np.uint32(s) for s, n, d in draws], axis=1).astype(np.int64)
            for r, pick in zip(some, picks, strict=True):
                w = np.bincount(pick, minlength=len(starts) if whole else rows).astype(float)
                w = np.repeat(w, sizes) if whole else w
                n, ranks = w.sum(), {}
                for c, at in zip("xyz", values, strict=True):
                    own = np.bincount(at, weights=w)
                    ranks[c] = (np.cumsum(own) - (own + n) / 2)[at]
                weighed = {c: w * x for c, x in ranks.items()}
                out.append((r - 1, int(n), *[weighed[p[0]] @ ranks[p[1]] for p in _SUMS]))
        columns = list(zip(*out, strict=True))
        names = {c: pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in pair}
        return pa.table({**names, "k": pa.array(columns[0], pa.int32()), "n": pa.array(columns[1], pa.int64()), **{s: pa.array(columns[2 + i], pa.float64()) for i, s in enumerate(_SUMS)}})

    return of_group


def resampled_sums(rows: DataFrame, pair: list[str], pairs: int, replicates: int, seed: int, whole: bool) -> DataFrame:
    """(pair..., k, n, xy, ...): for replicate ``k`` + 1 the sums of products of centred ranks under its weights.

    ``rows`` has (pair..., stratum, unit, x, y, z), about ``pairs`` pairs of at most ``MOST`` rows.  Each stratum's rows are
    drawn from itself, or, if ``whole``, strata from all strata.
    """
    text: Column = F.col("stratum").cast("string").alias("_text")
    dealt, width = _blocks(rows.select(*pair, "stratum", text, "unit", "x", "y", "z"), pair, pairs, replicates)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*pair).schema)
    return dealt.groupBy(*pair, "_block").applyInArrow(_resampled_sums(pair, replicates, width, seed, whole), f"{head}, k int, n long, " + ", ".join(f"{s} double" for s in _SUMS))
