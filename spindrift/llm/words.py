"""Vectorised word scanning over Arrow string columns.

A column is walked in chunks of a few megabytes; inside a chunk the words of all rows are found
with a byte-class table and hashed with prefix sums, so no Python loop runs per word.  Whole texts
are scanned: a text longer than a chunk is a chunk of its own.  Words never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned together, and bytes of them whose prefix sums are held at once.
CHUNK, BLOCK = 4 << 20, 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed = _mixed


def _class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased: digits, letters, all beyond ASCII.
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint64)
#: A random odd-looking value for every lower-cased byte.
_VALUE = _mixed((_FOLD + np.uint64(1)) * np.uint64(_ODD))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(m, factor, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up, self.down


_POWERS = _Powers()


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row offsets into the bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; words first[i]:first[i+1] belong to row i."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """64-bit hashes of the byte ranges with A-Z lower-cased; equal ranges have equal hashes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _POWERS.of(hi - lo + 1)
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_ODD))
        i = j
    return out


def hash_word(word: str) -> int:
    """The hash of one word, as :func:`hashes` gives it."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def word_lists(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes in order) for every row of the column."""
    for lo, hi, data, offsets in text_chunks(column):
        starts, ends, first = scan(data, offsets, kind)
        h = hashes(data, starts, ends)
        for i in range(hi - lo):
            yield lo + i, h[first[i] : first[i + 1]]


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(_ODD) + h[k : k + n]
    return _mixed(out)
