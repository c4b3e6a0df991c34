"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes if it is covered by a 100-byte string that also starts earlier (in a smaller document,
or earlier in the same one).  The suffixes that matter are found first: every 100-byte window has an
anchor, the 32-byte gram with the least hash in it, and consecutive windows with the same anchor
form a segment.  Equal windows have equal anchors, so windows of an anchor that occurs once are
unique, and segments of one anchor hold all that can repeat.  Equal segments of an anchor collapse
to the earliest (in each task before anything is shuffled): all others are covered.

A line that stands in many texts would give them all one anchor.  Grams that are common in a bounded
sample of texts (``SAMPLE`` slices of ``SLICE`` bytes) are therefore anchors only of windows that have no
other gram.  That is a property of a window's bytes, so equal windows still have equal anchors; the
sample decides how even the work is, never what is found.  Anchors that are crowded all the same
(more than ``CROWDED`` distinct segments) have each of their windows grouped by itself.

Distinct segments of one anchor are resolved by suffix order.  They go to the bucket of their anchor;
each (bucket, shard) builds the transform of its segments, and a bucket's transforms are merged by
iterative interleave refinement, one symbol a step.  After 100 steps the groups without borders are
the intervals of suffixes with a common prefix of 100 bytes; walking the transforms back gives their
places, and all but the earliest place of a group are covered.

Null and empty texts, and those under 100 bytes, lose nothing.  A null doc_id comes before all others.
Rows of one id and text are one document: neither is earlier, and both get the same result.  Rows of one
id (or none) with different texts are documents of their own, in the order of a hash of the text.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import repeated, transform
from .store import stored, unused
from .words import _POWERS as POWERS
from .words import mixed, text_chunks

LENGTH, GRAM = 100, 32
SHARDS = 4
#: Bytes of segments that a bucket gets about, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 128
#: Runs that a task holds before it combines and hands them on.
HELD = 500_000
TILE = 1 << 20
#: Texts whose grams are counted for the common ones, bytes of each, and in how many a common gram stands at least.
SAMPLE, SLICE, COMMON = 1024, 8192, 6
#: Bits of the table of common grams; a gram that shares a place with a common one counts as common, here and everywhere.
TABLE_BITS = 20
#: Distinct segments of an anchor from which its windows are grouped one by one, and bytes of text for each task that resolves anchors.
CROWDED, RESOLVED_BYTES = 8192, 8 << 20

_VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93))
_HIGH, _LOW = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)

RUN_SCHEMA = "kind int, part bigint, anchor bigint, segment bigint, doc bigint, pos bigint, len bigint"
_RUN_NAMES = ["kind", "part", "anchor", "segment", "doc", "pos", "len"]


def _gram_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): the sum of [i, j) times the power at i is the hash of those bytes before mixing."""
    n = len(data)
    up, down = POWERS.of(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    return sums, down


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings of ``data``."""
    sums, down = _gram_sums(data)
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])


def segments(data: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, content hash) of all segments; windows stay within rows.  ``common`` says by a hash's highest bits whether a gram is."""
    n = len(data)
    if n < LENGTH:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    sums, down = _gram_sums(data)
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    rank = gram >> np.uint64(1)
    if common is not None:
        rank |= common[gram >> np.uint64(64 - TABLE_BITS)].astype(np.uint64) << np.uint64(63)
    least = (rank & _HIGH) | np.arange(len(gram), dtype=np.uint64)
    width, wanted = 1, LENGTH - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - LENGTH + 1
    least = np.minimum(least[:windows], least[wanted - width : wanted - width + windows])
    at = (least & _LOW).astype(np.int64)
    valid = np.ones(windows, dtype=bool)
    for end in offsets[1:]:
        valid[max(0, end - LENGTH + 1) : end] = False
    change = at[1:] != at[:-1]
    begins, stops = valid.copy(), valid.copy()
    begins[1:] &= change | ~valid[:-1]
    stops[:-1] &= change | ~valid[1:]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops)
    content = mixed((sums[hi + LENGTH] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return lo, hi - lo + 1, gram[at[lo]], content


def _all_segments(column: pa.Array, common: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window in the row, windows, anchor, content) of a text column."""
    for first, last, data, offsets in text_chunks(column, TILE):
        if len(data) <= 4 * TILE:
            lo, n, anchor, content = segments(data, offsets, common)
            row = np.searchsorted(offsets, lo, "right") - 1
            yield first + row, lo - offsets[row], n, anchor, content
        else:  # one very long text, in tiles that share 99 bytes
            for start in range(0, len(data), TILE):
                part = data[start : start + TILE + LENGTH - 1]
                lo, n, anchor, content = segments(part, np.array([0, len(part)]), common)
                yield np.full(len(lo), first), lo + start, n, anchor, content


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each row's distinct grams."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if raw is not None and len(raw) >= GRAM:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams(np.frombuffer(raw, dtype=np.uint8))).view(np.int64))], ["gram"])


def common_grams(docs: DataFrame) -> np.ndarray:
    """By a hash's highest bits, whether a gram is common in the sample of (doc, text) rows."""
    chosen = docs.filter(F.octet_length("text") >= LENGTH).select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).distinct().withColumnRenamed("doc", "_chosen")
    # each text gives one slice of it, at a place that its hash says
    raw = F.encode("text", "utf-8")
    lot = F.pmod(F.xxhash64("doc", "text"), F.greatest(F.lit(1), F.octet_length(raw) - SLICE + 1)).cast("int")
    slices = docs.join(F.broadcast(chosen), F.col("doc") == F.col("_chosen")).select(F.substring(raw, lot + 1, F.lit(SLICE)).alias("raw"))
    counts = slices.mapInArrow(_sampled, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    places = counts.filter(F.col("n") >= COMMON).select(F.shiftrightunsigned("gram", 64 - TABLE_BITS).alias("place")).distinct()
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[[r["place"] for r in places.collect()]] = True  # as many as the table has places, at most
    return table


def _combined(anchor, segment, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """(order, earliest): runs sorted by anchor, segment and place; whether each is at its segment's earliest place."""
    order = np.lexsort((pos, doc, segment, anchor))
    a, s, d, p = anchor[order], segment[order], doc[order], pos[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (d == d[head]) & (p == p[head])


def _covered(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered windows as united byte ranges: (doc, first byte, bytes)."""
    order = np.lexsort((pos, doc))
    d, lo, hi = doc[order], pos[order], pos[order] + n[order] + LENGTH - 1
    if not len(d):
        return d, lo, hi
    # windows of one document come in order, and all ranges are longer than the gaps between anchors
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    return d[at], lo[at], np.maximum.reduceat(hi, at) - lo[at]


def _batch(kind: int, part, anchor, segment, doc, pos, n) -> pa.RecordBatch:
    size = len(doc)
    columns = [pa.array(np.full(size, kind, dtype=np.int32)), *(pa.array(np.broadcast_to(np.asarray(x), (size,)).astype(np.int64)) for x in (part, anchor, segment, doc, pos, n))]
    return pa.RecordBatch.from_arrays(columns, _RUN_NAMES)


def _earliest_runs(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Of (doc, pos, n, anchor, segment) runs, kind 0: the earliest of each segment; kind 1: byte ranges that the others cover."""
    doc, pos, n, anchor, segment = (np.concatenate(x) for x in zip(*held, strict=True))
    order, earliest = _combined(anchor, segment, doc, pos)
    out = order[~earliest]
    d, lo, size = _covered(doc[out], pos[out], n[out])
    for i in range(0, len(d), 100_000):
        s = slice(i, i + 100_000)
        yield _batch(1, d[s], d[s], 0, d[s], lo[s], size[s])
    keep = order[earliest]
    for i in range(0, len(keep), 100_000):
        k = keep[i : i + 100_000]
        yield _batch(0, anchor[k].view(np.int64), anchor[k].view(np.int64), segment[k].view(np.int64), doc[k], pos[k], n[k])


def _runs(common):
    """Kind 0: the earliest run of each segment in this task.  Kind 1: byte ranges already known to be covered."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        many = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, pos, n, anchor, segment in _all_segments(batch.column(1), common.value):
                held.append((ids[row], pos, n, anchor, segment))
                many += len(row)
                if many >= HELD:
                    yield from _earliest_runs(held)
                    held, many = [], 0
        if held:
            yield from _earliest_runs(held)

    return of_batches


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one window each, of (doc, text, x: segments) rows; a window's anchor is its own content."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, raw = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint8)
            held = []
            for x in batch.column(2)[i].as_py():
                sums, down = _gram_sums(raw[x["pos"] : x["pos"] + x["len"] + LENGTH - 1])
                content = mixed((sums[LENGTH:] - sums[:-LENGTH]) * down[: x["len"]])
                held.append((np.full(x["len"], doc), x["pos"] + np.arange(x["len"]), np.ones(x["len"], dtype=np.int64), content, content))
            yield from _earliest_runs(held)


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches again, each ending with an anchor's last row; empty ones are left out."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        anchor = batch.column(2).to_numpy()
        last = batch.num_rows - int(np.searchsorted(anchor, anchor[-1]))
        if last == batch.num_rows and held is not None and held.column(2)[0].as_py() == anchor[-1]:
            held = rows
            continue
        yield rows.slice(0, rows.num_rows - last)
        held = rows.slice(rows.num_rows - last)
    if held is not None:
        yield held


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor, segment and place: kind 1, covered byte ranges; kind 2, segments that need suffix order."""
    for table in _whole_anchors(batches):
        kind, _, anchor, segment, doc, pos, n = (table.column(k).to_numpy() for k in range(7))
        out = np.flatnonzero(kind == 1)
        yield _batch(1, doc[out], 0, 0, doc[out], pos[out], n[out])
        on = np.flatnonzero(kind == 0)
        if not len(on):
            continue
        anchor, segment, doc, pos, n = (x[on] for x in (anchor, segment, doc, pos, n))
        new = np.ones(len(on), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(on)), 0))
        late = np.flatnonzero((doc != doc[head]) | (pos != pos[head]))
        d, lo, size = _covered(doc[late], pos[late], n[late])
        yield _batch(1, d, 0, 0, d, lo, size)
        keep = np.flatnonzero(new)
        a = anchor[keep]
        same = a[1:] == a[:-1]
        several = np.zeros(len(a), dtype=bool)
        several[1:] |= same
        several[:-1] |= same
        k = keep[several]
        yield _batch(2, anchor[k], anchor[k], 0, doc[k], pos[k], n[k])


def _by_anchor(runs: DataFrame, partitions: int, name: str) -> DataFrame:
    """Runs after :func:`_resolved`, stored; Spark sorts them, so that a task holds few anchors at once."""
    order = ["anchor", "segment", "doc", "pos"]
    return stored(runs.repartition(partitions, "part").sortWithinPartitions(*order).mapInArrow(_resolved, RUN_SCHEMA), name)


def _cut(buckets: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("bucket", "shard", "doc", "pos", "len", "bytes")}
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                raw = memoryview(batch.column(1)[i].as_buffer())
                shard = int(mixed(np.array([doc], dtype=np.int64).view(np.uint64))[0] % np.uint64(SHARDS))
                for x in batch.column(2)[i].as_py():
                    rows["bucket"].append((x["anchor"] & 0x7FFFFFFFFFFFFFFF) % buckets)
                    rows["shard"].append(shard)
                    rows["doc"].append(doc)
                    rows["pos"].append(x["pos"])
                    rows["len"].append(x["len"])
                    rows["bytes"].append(bytes(raw[x["pos"] : x["pos"] + x["len"] + LENGTH - 1]))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.binary() if k == "bytes" else pa.int64()) for k in rows]))

    return of_batches


def _shard_transform(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc", "pos"])
    places = [rows[k].to_numpy().astype(np.int64).tobytes() for k in ("doc", "pos", "len")]
    return pd.DataFrame([(key[0], key[1], transform(list(rows["bytes"])).tobytes(), *places)], columns=["bucket", "shard", "bwt", "docs", "pos", "lens"])


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Covered byte ranges that the merged transforms of one bucket show."""
    rows = rows.sort_values("shard")
    docs, places, lens = ([np.frombuffer(x, dtype=np.int64) for x in rows[k]] for k in ("docs", "pos", "lens"))
    group, shard, string, offset = repeated([np.frombuffer(b, dtype=np.uint8) for b in rows["bwt"]], lens, LENGTH)
    several = np.bincount(group)[group] > 1
    group = group[several]
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])])[shard[several]] + string[several]
    doc, pos = np.concatenate(docs)[at], np.concatenate(places)[at] + offset[several]
    order = np.lexsort((pos, doc, group))
    group, doc, pos = group[order], doc[order], pos[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)], np.arange(len(group)), 0))
    later = (doc != doc[head]) | (pos != pos[head])
    d, lo, size = _covered(doc[later], pos[later], np.ones(int(later.sum()), dtype=np.int64))
    return pd.DataFrame({"doc": d, "pos": lo, "len": size})


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(doc, pos, len): byte ranges of documents that are covered; ranges of one document may overlap.

    ``docs`` has (doc, text).  A bucket's work is linear in its bytes times the window length.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // RESOLVED_BYTES)
    common = spark.sparkContext.broadcast(common_grams(docs))  # a megabyte
    resolved = _by_anchor(docs.mapInArrow(_runs(common), RUN_SCHEMA), partitions, "runs")
    needs = resolved.filter("kind = 2")
    known = resolved.filter("kind = 1").select("doc", "pos", "len")
    placed = lambda rows: docs.select("doc", "text").join(rows.groupBy("doc").agg(F.collect_list(F.struct("anchor", "pos", "len")).alias("x")), "doc").select("doc", "text", "x")
    crowded = stored(needs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("anchor"), "crowded")
    if crowded.limit(1).count():
        windows = placed(needs.join(crowded, "anchor", "left_semi")).mapInArrow(_single_windows, RUN_SCHEMA)
        known = known.unionByName(_by_anchor(windows, partitions, "windows").filter("kind = 1").select("doc", "pos", "len"))
        needs = needs.join(crowded, "anchor", "left_anti")
    size = needs.agg(F.sum(F.col("len") + LENGTH - 1)).first()[0]
    if not size:
        return known
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    pieces = placed(needs).mapInArrow(_cut(buckets), "bucket bigint, shard bigint, doc bigint, pos bigint, len bigint, bytes binary")
    transforms = pieces.groupBy("bucket", "shard").applyInPandas(_shard_transform, "bucket bigint, shard bigint, bwt binary, docs binary, pos binary, lens binary")
    merged = transforms.groupBy("bucket").applyInPandas(_merged, "doc bigint, pos bigint, len bigint")
    return known.unionByName(stored(merged, "merged"))


def spans(ranges: list, size: int) -> list[tuple[int, int]]:
    """Maximal covered runs [lo, hi) of one document."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["pos"], min(r["pos"] + r["len"], size)) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in cuts:
        parts.append(raw[at:lo])
        at = hi
    parts.append(raw[at:])
    return b"".join(parts)


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with one column more, the last: the covered ranges of each row, null if none."""
    doc, other, ranges = (unused(docs, name) for name in ("_doc", "_range_doc", "_ranges"))
    keyed = _numbered(docs, doc)
    plain = keyed.select(F.col(doc).alias("doc"), F.col("text").cast("string").alias("text"))
    found = covered_ranges(plain).groupBy(F.col("doc").alias(other)).agg(F.collect_list(F.struct("pos", "len")).alias(ranges))
    return keyed.join(found, F.col(doc) == F.col(other), "left").select(*docs.columns, ranges)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each document, in their order: the id where ids are unique, else a place among all (id, text)."""
    key, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.select(key.alias("i"))
    if not rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR i IS NULL").limit(1).count():
        return docs.withColumn(name, key)
    order = docs.select(key.alias("_i"), text.alias("_h")).distinct().repartitionByRange("_i", "_h").sortWithinPartitions("_i", "_h")
    order = stored(order.withColumn(name, F.monotonically_increasing_id()), "numbers")  # rises within ranges and from one to the next
    i, h = unused(docs, "_i"), unused(docs, "_h")
    rows, order = docs.withColumn(i, key).withColumn(h, text), order.toDF("_oi_", "_oh_", name)
    return rows.join(order, rows[i].eqNullSafe(order["_oi_"]) & (rows[h] == order["_oh_"])).select(*(rows[c] for c in docs.columns), order[name])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts, ranges = batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            cuts = spans(ranges[i].as_py(), len(raw))
            rows.append((len(raw), sum(hi - lo for lo, hi in cuts), len(cuts), hashlib.sha256(_kept(raw, cuts)).hexdigest()))
        n, removed, count, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    rows = with_ranges(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without covered bytes; a character that loses a byte goes whole.  ``n_chars``, if there, is counted anew."""
    names, at = docs.columns, docs.columns.index("text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i, r in enumerate(ranges):
                if r and texts[i]:
                    raw = texts[i].encode()
                    texts[i] = _kept(raw, spans(r, len(raw))).decode(errors="ignore")
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = with_ranges(docs).withColumn("text", F.col("text").cast("string"))
    out = rows.mapInArrow(of_batches, T.StructType(rows.schema.fields[:-1]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
