"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: every segment (a few megabytes of text) stores, for each of its
terms, the sorted token positions, as Spark's Parquet rows.  Test items are looked up segment by
segment: the postings of an item window's rarest term give candidate starts, the offset-adjusted
postings of its other terms, rarest first, thin them out.  Nothing is shuffled but results.

Terms are 40-bit hashes of lower-cased words; a false match needs a collision in a place where all
other words of the window stand.  Null and empty texts have no words; a null item text or an item
without words has no windows; repeated rows are indexed each time; an item id that occurs several
times is one item with all its windows; all items
with a null id count as one, which isn't listed; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import ALNUM, hashes, scan, text_chunks, word_lists

WINDOW = 10
#: Words of test items that are broadcast at once; more items are searched in several rounds.
BROADCAST_WORDS = 2_000_000

_TERM = np.uint64(0xFFFFFFFFFF000000)
_LOW = np.uint64(0xFFFFFF)
INDEX_SCHEMA = "doc_ids array<bigint>, firsts binary, terms binary, counts binary, postings binary, segment bigint"
#: (segment, place) names an indexed row, whatever its id.
HIT_SCHEMA = "segment bigint, place int, doc_id bigint, n_words bigint, hits array<int>, items array<string>"


def _postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, positions by term) of a segment's word hashes."""
    n = len(h)
    if n <= 1 << 24:
        packed = (h & _TERM) | np.arange(n, dtype=np.uint64)
        packed.sort()
        terms, positions = packed & _TERM, (packed & _LOW).astype(np.uint32)
    else:
        positions = np.argsort(h & _TERM, kind="stable").astype(np.uint32)
        terms = (h & _TERM)[positions]
    new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if n else np.zeros(0, np.int64)
    return terms[new], np.diff(np.concatenate([new, [n]])).astype(np.uint32), positions


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for lo, hi, data, offsets in text_chunks(text):
            starts, ends, first = scan(data, offsets, ALNUM)
            terms, counts, positions = _postings(hashes(data, starts, ends))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (first.astype(np.int64), terms, counts, positions)]
            yield pa.RecordBatch.from_arrays([pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), *blobs, pa.array([segment])], ["doc_ids", "firsts", "terms", "counts", "postings", "segment"])
            segment += 1


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored positional index of all rows: one row per segment of whole texts."""
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return stored(rows.mapInArrow(_index_batches, INDEX_SCHEMA), "postings")


class Phrases:
    """Windows of test items, ready for searching: term numbers (-1: none) by window, and each window's item."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        rows, owners = [], []
        texts = pa.array([t for _, t in items], pa.string())
        for i, h in word_lists(texts, ALNUM):
            h = h & _TERM
            for k in range(max(1, len(h) - window + 1) if len(h) else 0):
                row = h[k : k + window]
                rows.append((row, len(row)))
                owners.append(i)
        self.items = [i for i, _ in items]
        self.owner = np.array(owners, dtype=np.int64)
        self.length = np.array([n for _, n in rows], dtype=np.int64)
        flat = np.concatenate([r for r, _ in rows]) if rows else np.zeros(0, np.uint64)
        self.terms, numbers = np.unique(flat, return_inverse=True)
        self.table = np.full((len(rows), window), -1, dtype=np.int64)
        self.table[np.arange(window)[None, :] < self.length[:, None]] = numbers


def find(p: Phrases, firsts: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of all matches in a segment, starting from each window's rarest term.

    With ``slack`` above 0, every word may stand that many places from where the phrase has it
    (proximity); 0 finds exact phrases.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.terms) or not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, p.terms), len(terms) - 1)
    there = terms[at] == p.terms
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    held = np.where(there, counts[at], 0).astype(np.int64)
    often = np.where(p.table >= 0, held[p.table], np.iinfo(np.int64).max)
    alive = np.flatnonzero(often.min(axis=1) > 0)
    if not len(alive):
        return none
    order = np.argsort(often[alive], axis=1, kind="stable")
    lead = order[:, 0]
    lead_term = p.table[alive, lead]
    n = held[lead_term]
    w = np.repeat(np.arange(len(alive)), n)
    inner = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    start = postings[np.repeat(begin[at[lead_term]], n) + inner].astype(np.int64) - lead[w]
    # the postings of all terms in play, as sorted (term, position) keys
    used = np.zeros(len(p.terms), dtype=bool)
    used[p.table[alive][p.table[alive] >= 0]] = True
    used = np.flatnonzero(used)
    m = held[used]
    inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    keys = (np.repeat(used, m) << 32) + postings[np.repeat(begin[at[used]], m) + inner]
    keep = start >= -slack
    w, start = w[keep], start[keep]
    for j in range(1, p.table.shape[1]):
        if not len(w):
            return none
        k = order[w, j]
        term = p.table[alive[w], k]
        low = (np.maximum(term, 0) << 32) + np.maximum(start + k - slack, 0)
        high = (np.maximum(term, 0) << 32) + np.maximum(start + k + slack, 0)
        i = np.searchsorted(keys, low)
        ok = (term < 0) | (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= high)
        w, start = w[ok], start[ok]
    window = alive[w]
    doc = np.searchsorted(firsts, np.maximum(start, 0), "right") - 1
    inside = (start >= firsts[doc] - slack) & (start + p.length[window] <= firsts[doc + 1] + slack)
    return window[inside], start[inside]


def _search(phrases, slack: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = phrases.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten()
                firsts, terms, counts, postings = (np.frombuffer(batch.column(1 + k)[i].as_buffer(), dtype=d) for k, d in enumerate((np.int64, np.uint64, np.uint32, np.uint32)))
                window, start = find(p, firsts, terms, counts, postings, slack)
                total = int(firsts[-1])
                cover = np.zeros(total + 1, dtype=np.int64)
                np.add.at(cover, np.clip(start, 0, total), 1)
                np.add.at(cover, np.clip(start + p.length[window], 0, total), -1)
                hit = np.flatnonzero(np.cumsum(cover)[:total] > 0)
                doc = np.searchsorted(firsts, np.maximum(start, 0), "right") - 1
                pairs = np.unique(np.column_stack([doc, p.owner[window]]), axis=0)
                cuts = np.searchsorted(hit, firsts)
                local = (hit - firsts[np.searchsorted(firsts, hit, "right") - 1]).astype(np.int32)
                n = len(firsts) - 1
                names = pa.array([p.items[j] for j in pairs[:, 1]], pa.string())
                item_cuts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column(5)[i], n), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.diff(firsts)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(local)),
                        pa.ListArray.from_arrays(pa.array(item_cuts.astype(np.int32)), names),
                    ],
                    ["segment", "place", "doc_id", "n_words", "hits", "items"],
                )

    return of_batches


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """``items`` with texts of at most about ``most`` words: longer ones in pieces that overlap, so that each window is whole in one of them."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    cut = items.withColumn("w", words).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(most))))
    cut = cut.filter((F.col("i") == 0) | (F.size("w") - F.col("i") >= window))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, F.lit(most + window - 1)), " ").alias("text")).distinct()


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, n_words, hits: word places, items) for every indexed row.

    ``items`` has (item_id, text).  Its size is measured first; up to ``broadcast_words`` words are
    broadcast at a time, and larger item tables are searched in rounds whose hits are united per row.  Rounds are dealt by
    item and text, with long texts in overlapping pieces, so that neither rows of one id nor a long text fill one.
    """
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    rounds = max(1, -(-words // broadcast_words))
    pieces = _pieces(items, window, max(window, broadcast_words // 8)) if rounds > 1 else items
    found = None
    for k in range(rounds):
        part = items if rounds == 1 else pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window))
        hits = index.select("doc_ids", "firsts", "terms", "counts", "postings", "segment").mapInArrow(_search(phrases, slack), HIT_SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    if rounds > 1:
        union = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), union("hits"), union("items"))
    return found.select("doc_id", "n_words", "hits", "items")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found = search(build_index(docs), items)
    listed = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items, windows of ten words."""
    return decontaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
