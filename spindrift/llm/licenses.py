"""License scans: an exact set-similarity join of text blocks with license templates.

A text's blocks are its lines, cut further at sentence ends.  A block meets a template if it holds at
least ``CONTAINMENT`` of the template's distinct words.  Words are ordered by how often they stand in
the whole corpus, rarest first.  A block that meets a template has one of the template's first
|T| - needed + 1 words in that order (prefix filter), enough template words at all (length filter)
and enough of them left after the first common one (positional filter); what passes is counted
exactly, so every block that meets the threshold is found.

Sentences that are wrapped over several lines are searched too, in windows of as many words as the
template has: a window meets the template as a block does.  Line breaks inside a sentence don't end
it, sentence ends and lines without words do.

Base phrases are places where a phrase's words stand consecutively; their labels are always kept.
Null and empty texts have no words; words are never matched across documents; repeated rows get the
same result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, hash_word, hashes, scan, text_chunks

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
CONTAINMENT = 0.9
#: Sentences of widespread licenses and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal"),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Templates:
    """Distinct words of all templates, and each template's words in global order once frequencies are known."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        self.lengths = [len(_words(text)) for _, text in templates]
        sets = [set(_words(text)) for _, text in templates]
        self.vocabulary = np.unique(np.array([hash_word(w) for w in set().union(*sets)], dtype=np.uint64))
        self.sets = [np.searchsorted(self.vocabulary, np.unique(np.array([hash_word(w) for w in s], dtype=np.uint64))) for s in sets]
        self.phrases = [(np.array([hash_word(w) for w in _words(p)], dtype=np.uint64), label) for p, label in phrases]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.order: list[np.ndarray] = []

    def ordered(self, frequency: np.ndarray) -> Templates:
        """Ranks vocabulary words by corpus frequency, rarest first, and templates' words by rank."""
        rank = np.empty(len(frequency), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, frequency))] = np.arange(len(frequency))
        self.rank = rank
        self.order = [np.sort(rank[s]) for s in self.sets]
        self.needed = [math.ceil(CONTAINMENT * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (words, needed) in enumerate(zip(self.order, self.needed, strict=True)):
            for place, r in enumerate(words[: len(words) - needed + 1]):
                self.prefix.setdefault(int(r), []).append((t, place))
        self.leads = np.zeros(len(frequency), dtype=bool)
        self.leads[list(self.prefix)] = True
        return self

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, vocabulary numbers) of the vocabulary words among hashes."""
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[i] == h[at]
        return at[ok], i[ok]

    def matches(self, ranks: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) of all templates that a block with these distinct ranks, sorted, meets."""
        found, seen = [], set()
        for i, r in enumerate(ranks):
            for t, place in self.prefix.get(int(r), ()):
                if t in seen:
                    continue
                seen.add(t)
                words, needed = self.order[t], self.needed[t]
                if len(ranks) >= needed and min(len(words) - place, len(ranks) - i) >= needed:
                    overlap = len(np.intersect1d(words, ranks, assume_unique=True))
                    if overlap >= needed:
                        found.append((t, overlap / len(words)))
        return found

    def in_windows(self, places: np.ndarray, ranks: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) of all templates that some window of a sentence meets, with its best window.

        ``places`` are the word places of the vocabulary words in it, ``ranks`` their ranks.
        """
        found = []
        for t, _ in self.matches(np.unique(ranks)):
            own = np.isin(ranks, self.order[t])
            at, words = places[own].tolist(), ranks[own].tolist()
            held: Counter[int] = Counter()
            most = begin = 0
            for place, word in zip(at, words, strict=True):
                held[word] += 1
                while at[begin] <= place - self.lengths[t]:
                    held[words[begin]] -= 1
                    if not held[words[begin]]:
                        del held[words[begin]]
                    begin += 1
                most = max(most, len(held))
            if most >= self.needed[t]:
                found.append((t, most / len(self.order[t])))
        return found


def _sentence_ends(data: np.ndarray) -> np.ndarray:
    """Whether a byte is a sentence mark before white space."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    end = np.isin(data, np.frombuffer(b".!?", dtype=np.uint8))
    end[:-1] &= space[1:]
    end[-1:] = False
    return end


def block_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where blocks end: after line ends, after sentence marks before white space, and at row ends."""
    return np.unique(np.concatenate([np.flatnonzero((data == 0x0A) | _sentence_ends(data)) + 1, offsets[1:]]))


def sentences(data: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, line) of every word; a sentence runs on over line breaks, but not over a line without words."""
    line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
    mark = np.searchsorted(np.flatnonzero(_sentence_ends(data)), starts)
    new = np.zeros(len(starts), dtype=bool)
    new[1:] = (np.diff(line) > 1) | (np.diff(mark) > 0)
    new[firsts[firsts < len(starts)]] = True
    return np.cumsum(new), line


def _frequencies(t: Templates):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(t.vocabulary), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                starts, ends, _ = scan(data, offsets, ALNUM)
                counts += np.bincount(t.numbers(hashes(data, starts, ends))[1], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["word", "n"])

    return of_batches


def _scanned(t: Templates):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            first, last = np.full(n, -1), np.full(n, -1)
            base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                starts, ends, firsts = scan(data, offsets, ALNUM)
                h = hashes(data, starts, ends)
                words[lo:hi] = np.diff(firsts)
                for phrase, label in t.phrases:
                    k = len(phrase)
                    at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == phrase[0])
                    for j in range(1, k):
                        at = at[h[at + j] == phrase[j]]
                    row = np.searchsorted(firsts, at, "right") - 1
                    within = at + k <= firsts[row + 1]
                    for a, r in zip(at[within].tolist(), row[within].tolist(), strict=True):
                        place = a - int(firsts[r])
                        base[lo + r] += 1
                        first[lo + r] = place if first[lo + r] < 0 else min(first[lo + r], place)
                        last[lo + r] = max(last[lo + r], place)
                        base_labels[lo + r].add(label)
                at, number = t.numbers(h)
                block = np.searchsorted(block_ends(data, offsets), starts[at], "right")
                rank = t.rank[number]
                lead = np.unique(block[t.leads[rank]])
                begin, stop = np.searchsorted(block, lead), np.searchsorted(block, lead, "right")
                for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
                    for template, share in t.matches(np.unique(rank[b:e])):
                        r = lo + int(np.searchsorted(firsts, at[b], "right")) - 1
                        labels[r].add(t.labels[template])
                        score[r] = max(score[r], share)
                sentence, line = (x[at] for x in sentences(data, starts, firsts))
                lead = np.unique(sentence[t.leads[rank]])
                begin, stop = np.searchsorted(sentence, lead), np.searchsorted(sentence, lead, "right")
                wrapped = line[begin] < line[stop - 1]  # others are blocks
                for b, e in zip(begin[wrapped].tolist(), stop[wrapped].tolist(), strict=True):
                    for template, share in t.in_windows(at[b:e], rank[b:e]):
                        r = lo + int(np.searchsorted(firsts, at[b], "right")) - 1
                        labels[r].add(t.labels[template])
                        score[r] = max(score[r], share)
            score = np.where(base > 0, 1.0, score)
            some = lambda x: pa.array(x, mask=x < 0)
            told = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(base), some(first), some(last), told(base_labels), told([a | b for a, b in zip(base_labels, labels, strict=True)]), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return of_batches


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is 1 with a base phrase, else the best containment of a template that is met, else 0.
    """
    t = Templates(templates)
    text = F.col("text").cast("string")
    rows = docs.select(text).mapInArrow(_frequencies(t), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    frequency = np.zeros(len(t.vocabulary), dtype=np.int64)
    for r in rows:
        frequency[r["word"]] = r["n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(_scanned(t.ordered(frequency)), f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of all ``documents``."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
