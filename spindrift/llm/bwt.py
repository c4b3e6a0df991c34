"""Burrows-Wheeler transforms of string collections, and their merging by interleave refinement.

Strings are byte strings; symbol 0 ends each one, so bytes count one more (no UTF-8 byte is 0xFF).
The i-th string's end sorts before the j-th's for i < j, so every suffix has a place of its own.
"""

from __future__ import annotations

import numpy as np


def transform(strings: list[bytes]) -> np.ndarray:
    """The transform of a collection: the symbol before each suffix, in suffix order.

    Suffixes are sorted by doubling: eight symbols at first, then ranks of twice as many.
    """
    lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    n = int(lengths.sum())
    ends = np.cumsum(lengths) - 1
    text = np.zeros(n, dtype=np.uint8)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8) + np.uint8(1)
    left = np.repeat(ends, lengths) - np.arange(n)  # symbols before the end
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    rank = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | np.where(left >= k, padded[k : k + n], 0).astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    depth, longest = 8, int(lengths.max())
    while depth < longest:
        then = np.zeros(n, dtype=np.int64)
        far = np.flatnonzero(left >= depth)
        then[far] = rank[far + depth] + 1
        rank = np.unique((rank << 32) | then, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    order = np.argsort((rank << 32) | np.repeat(np.arange(len(strings)), lengths), kind="stable")
    before = np.concatenate([[0], text[:-1]]).astype(np.uint8)
    before[np.concatenate([[0], ends[:-1] + 1])] = 0
    return before[order]


#: Symbols by which a step of :func:`merge` extends the order.
STRIDE = 8


def _steps(transform_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(back, forth, first) of a transform: the row one symbol longer and one symbol shorter (-1: none), and first symbols."""
    order = np.argsort(transform_, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    first = transform_[order]
    back[transform_ == 0] = -1
    forth = np.where(first == 0, -1, order)
    return back, forth, first


def _twice(step: np.ndarray) -> np.ndarray:
    return np.where(step >= 0, step[step], -1)


def _sorted_by(rank: np.ndarray, most: int) -> np.ndarray:
    """Stable order by ranks below ``most``, sixteen bits at a time (numpy sorts those by counting)."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    if most > 1 << 16:
        order = order[np.argsort((rank >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Merged:
    """Transforms side by side: where each begins, their rows' ranks by the first ``STRIDE`` symbols, and steps of as many symbols."""

    def __init__(self, transforms: list[np.ndarray]) -> None:
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in transforms])]).astype(np.int64)
        self.n = int(self.start[-1])
        back, forth, first = [], [], []
        for at, t in zip(self.start, transforms, strict=False):
            b, f, c = _steps(t)
            back.append(np.where(b >= 0, b + at, -1))
            forth.append(np.where(f >= 0, f + at, -1))
            first.append(c)
        self.back, jump = np.concatenate(back), np.concatenate(forth)
        self.prefix, width = np.concatenate(first).astype(np.uint64), 1
        while width < STRIDE:  # first symbols, doubled; an end stands for all that would follow it
            self.prefix = (self.prefix << np.uint64(8 * width)) | np.where(jump >= 0, self.prefix[jump], np.uint64(0))
            jump, self.back, width = _twice(jump), _twice(self.back), 2 * width
        self.short = np.flatnonzero(jump < 0)  # suffixes that end within a stride; they differ from all others by then
        by_prefix = np.argsort(self.prefix, kind="stable")
        self.rank = np.empty(self.n, dtype=np.int64)
        self.rank[by_prefix] = np.cumsum(np.concatenate([[False], self.prefix[by_prefix[1:]] != self.prefix[by_prefix[:-1]]])[: self.n])
        self.most = int(self.rank.max()) + 1 if self.n else 0

    def first_symbols(self, rows: np.ndarray, count: int) -> np.ndarray:
        return self.prefix[rows] >> np.uint64(8 * (STRIDE - count)) if count else np.zeros(len(rows), dtype=np.uint64)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, new): which transform each merged suffix is from, and whether its first ``depth``
    symbols differ from those of the suffix before it.

    Starts from the transforms' suffixes interleaved by their first symbols.  Each step carries the
    interleave of suffixes ordered by h symbols over to h + 8: the eight symbols before them, which
    the transforms hold, taken in that order, say where their extensions go.  That is a stable
    counting sort of interleaved rows; no suffix is compared again, and the order within a transform
    never changes.  It is the same as eight steps of one symbol, because a stable sort by eight symbols
    is eight stable sorts by one.  A border between two groups of equal prefixes appears in the step
    in which the common prefix ends, which is how common prefix lengths come out; groups without
    borders after ``depth`` symbols are the repeated intervals.
    """
    m = Merged(transforms)
    known = m.first_symbols(np.arange(m.n), depth % STRIDE)
    rows = np.argsort(known, kind="stable")
    new = np.concatenate([[True], known[rows[1:]] != known[rows[:-1]]])[: m.n]
    if depth % STRIDE:
        new |= known[rows] & np.uint64(0xFF) == 0  # ends all differ
    for _ in range(depth // STRIDE):
        longer = m.back[rows]
        has = longer >= 0
        group = np.concatenate([-1 - np.arange(len(m.short)), np.cumsum(new)[has]])
        rows = np.concatenate([m.short, longer[has]])
        order = _sorted_by(m.rank[rows], m.most)
        rows, group = rows[order], group[order]
        own = m.rank[rows]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])])[: m.n]
    return (np.searchsorted(m.start, rows, "right") - 1).astype(np.uint8), new


def repeated(transforms: list[np.ndarray], windows: list[np.ndarray], depth: int) -> tuple[np.ndarray, ...]:
    """(group, shard, string, offset) of all windows of ``depth`` symbols, in merged order; equal windows have equal groups.

    ``windows[s][i]`` is how many windows string i of transform s has: all places where one can start.  The
    same refinement as :func:`merge`, of the suffixes that windows start with alone: at every step, of those
    that begin as many symbols into a window as the steps to come will put before them.
    """
    m, lead = Merged(transforms), depth % STRIDE
    rows, shard, string, offset = [], [], [], []
    for s, (t, n) in enumerate(zip(transforms, windows, strict=True)):
        steps = walk(t, len(n), int(n.max()) + lead - 1)
        i = np.repeat(np.arange(len(n)), n)
        w = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(m.start[s] + steps[n[i] - 1 - w + lead, i])  # the last ``lead`` symbols of each window
        shard.append(np.full(len(i), s))
        string.append(i)
        offset.append(w)
    rows, shard, string, offset = map(np.concatenate, (rows, shard, string, offset))
    known = m.first_symbols(rows, lead)
    at = np.argsort(known, kind="stable")
    rows, new = rows[at], np.concatenate([[True], known[at[1:]] != known[at[:-1]]])[: len(at)]
    for _ in range(depth // STRIDE):
        rows, group = m.back[rows], np.cumsum(new)
        own = m.rank[rows]
        order = _sorted_by(own, m.most)
        rows, group, at, own = rows[order], group[order], at[order], own[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])])[: len(at)]
    return np.cumsum(new), shard[at], string[at], offset[at]


def walk(transform_: np.ndarray, strings: int, steps: int) -> np.ndarray:
    """rows[k, i]: the row of the suffix of string i that starts k symbols before its end (-1: no such)."""
    order = np.argsort(transform_, kind="stable")
    step = np.empty(len(order), dtype=np.int64)
    step[order] = np.arange(len(order))
    rows = np.full((steps + 1, strings), -1, dtype=np.int64)
    rows[0] = np.arange(strings)
    live = np.arange(strings)
    for k in range(1, steps + 1):
        at = rows[k - 1, live]
        more = transform_[at] != 0
        live = live[more]
        rows[k, live] = step[at[more]]
    return rows
