"""Pairwise similarity of token arrays, trees and vectors.

What is one expression of two arrays stays in the JVM.  N-gram counts and the dynamic programmes
need state per pair; they run as Arrow pandas UDFs without any shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

BLEU_ORDER = 4

BLEU_TYPE = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("precisions", T.ArrayType(T.DoubleType())), T.StructField("matched", T.ArrayType(T.LongType())),
    T.StructField("possible", T.ArrayType(T.LongType())), T.StructField("brevity_penalty", T.DoubleType()),
])
ROUGE_TYPE = T.StructType([T.StructField(f"{kind}_{part}", T.DoubleType()) for kind in ("rouge_1", "rouge_2", "rouge_l") for part in ("precision", "recall", "f1")])


def _grams(items: list[str], n: int) -> Counter:
    return Counter(zip(*(items[k:] for k in range(n)), strict=False))


def bleu_of(reference: list[str], candidate: list[str]) -> dict | None:
    """Segment BLEU-4 with exponential smoothing of orders without a match; 0 without a common token."""
    if not len(reference) or not len(candidate):
        return None
    reference, candidate = list(reference), list(candidate)
    matched, possible, precisions, zeros = [], [], [], 0
    for n in range(1, min(BLEU_ORDER, len(candidate)) + 1):
        mine, theirs = _grams(candidate, n), _grams(reference, n)
        matched.append(sum((mine & theirs).values()))
        possible.append(len(candidate) - n + 1)
    if not matched[0]:
        return {"score": 0.0, "precisions": [0.0] * len(matched), "matched": matched, "possible": possible, "brevity_penalty": math.exp(min(0.0, 1 - len(reference) / len(candidate)))}
    for hit, of in zip(matched, possible, strict=True):
        zeros += not hit
        precisions.append(hit / of if hit else 1.0 / (2**zeros * of))
    penalty = math.exp(min(0.0, 1 - len(reference) / len(candidate)))
    score = penalty * math.exp(math.fsum(map(math.log, precisions)) / len(precisions))
    return {"score": min(1.0, max(0.0, score)), "precisions": precisions, "matched": matched, "possible": possible, "brevity_penalty": penalty}


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: bits of one big integer stand for a row of the table."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _prf(hit: float, candidate: int, reference: int) -> tuple[float, float, float]:
    p, r = hit / max(candidate, 1), hit / max(reference, 1)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_of(reference: list[str], candidate: list[str]) -> tuple | None:
    if not len(reference) or not len(candidate):
        return None
    reference, candidate = list(reference), list(candidate)
    out: tuple = ()
    for n in (1, 2):
        hit = sum((_grams(candidate, n) & _grams(reference, n)).values())
        out += _prf(hit, len(candidate) - n + 1, len(reference) - n + 1)
    return out + _prf(lcs_length(reference, candidate), len(candidate), len(reference))


@F.pandas_udf(BLEU_TYPE)
def bleu(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """BLEU of (reference, candidate) token arrays; null if one is empty."""
    names = BLEU_TYPE.names
    rows = [None if r is None or c is None else bleu_of(r, c) for r, c in zip(reference, candidate, strict=True)]
    return pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names)


@F.pandas_udf(ROUGE_TYPE)
def rouge(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """ROUGE-1, -2 and -L of (reference, candidate) token arrays; null if one is empty."""
    rows = [(None if r is None or c is None else rouge_of(r, c)) or (None,) * 9 for r, c in zip(reference, candidate, strict=True)]
    return pd.DataFrame(rows, columns=ROUGE_TYPE.names, dtype=float)


#: Code points that can stand for tokens: all from 256 on but the surrogates.
LETTERS = 0x110000 - 0x800 - 256


def token_levenshtein(left: Column, right: Column) -> Column:
    """Unit-cost edit distance of token arrays.

    Each distinct token of the pair becomes one code point, so that the built-in string distance
    counts tokens.  A pair with more distinct tokens than there are code points (1.1 million, whose
    table of distances would have 10^12 cells) is an error.
    """

    def distance(x: Column) -> Column:
        def letter(t: Column) -> Column:
            place = (F.array_position(x["known"], t) + 255).cast("long")
            return F.decode(F.unhex(F.lpad(F.hex(place + F.when(place >= 0xD800, 0x800).otherwise(0)), 8, "0")), "UTF-32")

        text = lambda items: F.array_join(F.transform(items, letter), "")
        return F.when(F.size(x["known"]) > LETTERS, F.raise_error(F.lit("too_many_distinct_tokens")).cast("int")).otherwise(F.levenshtein(text(x["l"]), text(x["r"])))

    both = let(F.struct(left.alias("l"), right.alias("r")), lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), F.array_distinct(F.concat(x["l"], x["r"])).alias("known")))
    return let(both, distance)


def string_similarity(left: Column, right: Column) -> Column:
    """1 - distance / longer length; 0 if one is empty, null if both are."""

    def body(x: Column) -> Column:
        longest = F.greatest(F.size(x["l"]), F.size(x["r"]))
        return F.when(longest > 0, 1 - token_levenshtein(x["l"], x["r"]) / longest)

    return let(F.struct(left.alias("l"), right.alias("r")), body)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision, held to [-1, 1]; null for vectors of other lengths or without length."""
    l, r = left.cast("array<double>"), right.cast("array<double>")  # noqa: E741
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    dot = total(F.zip_with(l, r, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(l, lambda a: a * a))) * F.sqrt(total(F.transform(r, lambda a: a * a)))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))
    return F.when((F.size(l) == F.size(r)) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")), value)


def _postorder(tree) -> tuple[list[str], list[int]]:
    """(labels, leftmost leaf of each node) of a (label, children) tree in post-order."""
    labels: list[str] = []
    leftmost: list[int] = []

    def visit(node) -> int:
        label, children = node
        firsts = [visit(c) for c in children]
        labels.append(label)
        leftmost.append(firsts[0] if firsts else len(labels) - 1)
        return leftmost[-1]

    visit(tree)
    return labels, leftmost


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Ordered tree edit distance with unit insert, delete and relabel (Zhang and Shasha), on post-order arrays."""
    (la, ma), (lb, mb) = (tuple(map(list, x)) for x in (a, b))
    if la == lb and ma == mb:
        return 0

    def roots(left: list[int]) -> list[int]:
        last = {m: i for i, m in enumerate(left)}
        return sorted(last.values())

    done = np.zeros((len(la), len(lb)), dtype=np.int64)
    for i in roots(ma):
        for j in roots(mb):
            oi, oj = ma[i], mb[j]
            d = np.zeros((i - oi + 2, j - oj + 2), dtype=np.int64)
            d[:, 0], d[0, :] = np.arange(i - oi + 2), np.arange(j - oj + 2)
            for x in range(oi, i + 1):
                for y in range(oj, j + 1):
                    p, q = x - oi + 1, y - oj + 1
                    step = min(d[p - 1, q], d[p, q - 1]) + 1
                    if ma[x] == oi and mb[y] == oj:
                        d[p, q] = min(step, d[p - 1, q - 1] + (la[x] != lb[y]))
                        done[x, y] = d[p, q]
                    else:
                        d[p, q] = min(step, d[ma[x] - oi, mb[y] - oj] + done[x, y])
    return int(done[-1, -1])


@F.pandas_udf(T.LongType())
def tree_edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distance of trees given as structs of post-order ``labels`` and ``leftmost`` indices."""
    return pd.Series([None if a is None or b is None else tree_distance((list(a["labels"]), list(a["leftmost"])), (list(b["labels"]), list(b["leftmost"]))) for a, b in zip(_rows(left), _rows(right), strict=True)], dtype="Int64")


def _rows(x) -> list:
    return x.to_dict("records") if isinstance(x, pd.DataFrame) else list(x)


def tree_similarity(left: Column, right: Column) -> Column:
    """1 - distance / (nodes of both)."""
    return 1 - tree_edit_distance(left, right) / (F.size(left["labels"]) + F.size(right["labels"]))


def tiered(graph: Column, tree: Column, string: Column) -> Column:
    """The best available tier of a similarity, with its name and why higher tiers are missing."""
    reasons = F.array_compact(F.array(F.when(graph.isNull(), F.lit("grs_unavailable")), F.when(graph.isNull() & tree.isNull(), F.lit("trs_unavailable"))))
    tier = F.when(graph.isNotNull(), F.lit("GRS")).when(tree.isNotNull(), F.lit("TRS")).when(string.isNotNull(), F.lit("STS"))
    return F.struct(F.coalesce(graph, tree, string).alias("score"), tier.alias("selected_tier"), reasons.alias("reasons"))
