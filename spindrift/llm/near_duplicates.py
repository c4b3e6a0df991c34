"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct five-word shingles.  Sixty-four b-bit minimum hashes form its
signature.  The signature is split into sixteen chunks of four; if two signatures differ in at most
31 places, some chunk differs in at most one (pigeonhole), so listing each chunk with every one of
its places left out (the allowed chunk errors) makes the two meet under a common key.  All pairs
under that signature distance are therefore candidates; nothing is linked before its full sets show
the similarity.  A pair at similarity 0.75 lies beyond the distance with a probability of about 1e-5.

Candidates are verified where they can still connect something, and groups are never expanded into
pairs.  Equal sets collapse into one class first.  Every class is compared with the nearest of the
least classes of its keys, then with the others of them that it isn't connected with.  Keys whose
members are still apart are compared signature by signature, in blocks, each pair under its first
common key.  A block that leaves few candidates hands on those pairs; one that leaves more than
``DENSE`` for each of its members gets their full sets, in blocks bounded by bytes, and hands on the
links that connect what is alike.  So rows stay in proportion to members, but for keys with more members
than a block that are alike by signature and yet aren't connected by their sets: those meet block by block.

Null and empty texts, and those without words, have an empty set and link with nothing; texts of
fewer than five words have one shingle, their whole word sequence; repeated rows are copies of each
other; rows with a null id take no part and count as kept; columns other than id and text are ignored.
Rows of one id with different texts are documents of their own that happen to share a name: each is linked by its own
text, and a group's component is the smallest id of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stored
from .words import SOLID, mixed, runs, word_lists

SHINGLE = 5
HASHES, CHUNK = 64, 4
#: Largest signature distance for which candidates are complete: with one error a chunk, 2 * chunks - 1.
DISTANCE = 2 * (HASHES // CHUNK) - 1
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of a key that are compared in one block, and pairs that are looked at together.
BLOCK, PAIRS = 4096, 1 << 18
#: Candidates for each member from which a block is dense, and bytes of full sets that meet in one block on either side.
DENSE, BLOCK_BYTES = 8, 64 << 20

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a word hash sequence."""
    if not len(h):
        return h
    return np.unique(runs(h, min(SHINGLE, len(h))))


def signature(x: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the least value under each of the hash functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 1 << 14):
        least = np.minimum(least, (x[None, i : i + (1 << 14)] * _FACTORS[:, None]).min(axis=1))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, sigs = [], [], [], []
        for _, h in word_lists(batch.column(1), SOLID):
            x = shingle_set(h)
            n.append(len(x))
            d1.append(int(np.sum(mixed(x)).astype(np.int64)))
            d2.append(int(np.sum(mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)))
            sigs.append(signature(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "row", "n_shingles", "d1", "d2", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row: hash of id and text, n_shingles, d1, d2: digest of the set, sig) of every row, stored."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text"))
    return stored(rows.mapInArrow(_sign, "doc_id bigint, row bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"), "signatures")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _key_columns(sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, key): the hashes of a chunk with one place left out, slot by slot."""
    sig = sig.astype(np.uint64)
    for c in range(HASHES // CHUNK):
        part = sig[:, c * CHUNK : (c + 1) * CHUNK]
        for out in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + out, dtype=np.uint64)
            for k in range(CHUNK):
                if k != out:
                    key = (key << np.uint64(16)) | part[:, k]
            yield c * CHUNK + out, mixed(key).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for _, key in _key_columns(_matrix(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "id"])


def first_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first slot in which two signatures (rows of both) have a common key; HASHES if there is none."""
    off = (a != b).reshape(-1, HASHES // CHUNK, CHUNK)
    wrong = off.sum(axis=2)
    meets = wrong <= 1
    c = meets.argmax(axis=1)
    at = np.arange(len(a))
    slot = c * CHUNK + np.where(wrong[at, c] == 0, 0, off[at, c].argmax(axis=1))
    return np.where(meets.any(axis=1), slot, HASHES)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, far) of (a, b, sa, sb) pairs within the signature distance."""
    for batch in batches:
        if batch.num_rows:
            far = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.astype(np.int32))], ["a", "b", "far"]).filter(pa.array(far <= DISTANCE))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Runs of whole groups from sorted batches: columns as arrays (binary ones as lists); the last group is carried on."""
    held: list | None = None

    def joined(a, b):
        return a + b if isinstance(a, list) else np.concatenate([a, b])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [joined(x, y) for x, y in zip(held, rows, strict=True)]
        same = np.logical_and.reduce([x == x[-1] for x in rows[:keys]])
        cut = int(np.argmax(same))
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held is not None:
        yield held


def _starts(rows: list, keys: int) -> np.ndarray:
    change = np.logical_or.reduce([x[1:] != x[:-1] for x in rows[:keys]])
    return np.flatnonzero(np.concatenate([[True], change]))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, block, id, component, sig) sorted by the first three: pairs (a, b) of different components within
    the signature distance, under their first common key; (key, null) for keys with a dense block."""
    for rows in _grouped(batches, 3):
        key, i, j, block, ids, comp, raw = rows
        sig = np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(-1, HASHES)
        slot = np.full(len(key), HASHES)
        for k, own in _key_columns(sig):
            slot[own == key] = k
        starts = _starts(rows, 3)
        n = len(key)
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [n]])))
        after = np.concatenate([starts[1:], [n]])[group] - np.arange(n) - 1
        sums = np.concatenate([[0], np.cumsum(after)])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRS, "right")) - 1)
            count = after[lo:hi]
            u = np.repeat(np.arange(lo, hi), count)
            v = u + 1 + np.arange(len(u)) - np.repeat(sums[lo:hi] - sums[lo], count)
            on = (comp[u] != comp[v]) & ((i[u] == j[u]) | (block[u] != block[v]))
            u, v = u[on], v[on]
            near = (sig[u] != sig[v]).sum(axis=1) <= DISTANCE
            u, v = u[near], v[near]
            first = first_slots(sig[u], sig[v]) == slot[u]
            u, v = u[first], v[first]
            dense = np.bincount(group[u], minlength=len(starts)) > DENSE * np.bincount(group[lo:hi], minlength=len(starts))
            few = ~dense[group[u]]
            a, b = np.minimum(ids[u[few]], ids[v[few]]), np.maximum(ids[u[few]], ids[v[few]])
            crowded = key[starts[dense]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, crowded])), pa.array(np.concatenate([b, crowded]), mask=np.arange(len(a) + len(crowded)) >= len(a))], ["a", "b"])
            lo = hi


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, set)."""
    for batch in batches:
        sets = [shingle_set(h).tobytes() for _, h in word_lists(batch.column(1), SOLID)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, sorted, meet the threshold."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the (a, b, sa, sb) pairs whose full sets are alike."""
    for batch in batches:
        sets = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
        yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def exact_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None, sig: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all of ``left`` and ``right`` that full sets connect (left with right pairs only).

    One document's shingles are marked in the group's vocabulary; its shared shingles with all others
    are then sums over their lists.  Documents of one ``label``, those that links have connected already
    and, if there are signatures, those beyond the distance aren't compared.
    """
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    label, out = np.arange(len(ids)) if label is None else label.copy(), []
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    for x in left:
        others = right[label[right] != label[x]]
        others = others[(100 * sizes[others] >= PERCENT * sizes[x]) & (100 * sizes[x] >= PERCENT * sizes[others])]
        if sig is not None:
            others = others[(sig[others] != sig[x]).sum(axis=1) <= DISTANCE]
        if not len(others):
            continue
        own = flat[cuts[x] : cuts[x + 1]]
        mark[own] = 1
        length = sizes[others]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        shared = np.add.reduceat(mark[flat[np.repeat(cuts[others], length) + inner]], np.cumsum(length) - length)
        mark[own] = 0
        for y in others[100 * shared >= PERCENT * (sizes[x] + length - shared)]:
            if label[x] != label[y]:
                out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                label[label == label[y]] = label[x]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, block, id, component, sig, set) sorted by the first three: links that connect what is alike."""
    for rows in _grouped(batches, 3):
        _, i, j, block, ids, comp, sigs, raw = rows
        starts = np.concatenate([_starts(rows, 3), [len(ids)]])
        found: list[tuple[int, int]] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in raw[lo:hi]]
            sig = np.frombuffer(b"".join(sigs[lo:hi]), dtype=np.uint16).reshape(-1, HASHES)
            mine, at = block[lo:hi], np.arange(hi - lo)
            found += exact_links(ids[lo:hi], sets, at[mine == i[lo]], at[mine == j[lo]], comp[lo:hi], sig)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _in_blocks(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows with a pair of blocks (i, j) of their group each: members fall into ``blocks`` blocks, and every two meet."""
    df = df.withColumn("blocks", F.greatest(F.lit(1), F.ceil(blocks)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _labelled(df: DataFrame, found: DataFrame | None) -> DataFrame:
    """``df`` with the component of each ``id``: the id itself where there is none."""
    if found is None:
        return df.withColumn("component", F.col("id"))
    found = found.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
    return df.join(found, F.col("id") == F.col("_id"), "left").withColumn("component", F.coalesce("_c", "id")).drop("_id", "_c")


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


class Linking:
    """Verified links and the components that they make so far, of the classes ``rows`` (id, row) with texts (row, text)."""

    def __init__(self, texts: DataFrame, rows: DataFrame) -> None:
        self.sets = stored(texts.join(rows, "row").select("id", "text").mapInArrow(_sets, "id bigint, set binary").dropDuplicates(["id"]), "sets")
        self.links: DataFrame | None = None
        self.found: DataFrame | None = None

    def add(self, links: DataFrame, name: str) -> None:
        links = stored(links, name)
        if _some(links):
            self.links = links if self.links is None else self.links.unionByName(links)
            self.found = components(self.links)

    def verify(self, pairs: DataFrame, name: str) -> None:
        """Adds the (a, b) pairs whose full sets are alike."""
        side = lambda at: self.sets.select(F.col("id").alias(at), F.col("set").alias(f"s{at}"))
        self.add(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verified, "a bigint, b bigint"), name)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose ends aren't connected yet."""
        for at in ("a", "b"):
            pairs = _labelled(pairs.withColumn("id", F.col(at)), self.found).withColumnRenamed("component", f"c{at}").drop("id")
        return pairs.filter("ca <> cb").select("a", "b")


def linked_components(texts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(id, component) of the classes (id, row, sig) that are linked with others; None if there are none.  ``texts`` has (row, text)."""
    sig = classes.select("id", "sig")
    keys = sig.mapInArrow(_keys, "key bigint, id bigint")
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keys.join(stored(shared, "keys"), "key"), "members")
    stars = members.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = stars.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    close = stored(pairs.select("a", "b", "sa", "sb").mapInArrow(_distances, "a bigint, b bigint, far int"), "close")
    state = Linking(texts, classes.select("id", "row").join(members.select("id").distinct(), "id", "left_semi"))  # texts are shuffled once, those that share a key go on as sets
    nearest = close.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a"))
    state.verify(nearest.select("a", "b"), "nearest")
    state.verify(state.apart(close.join(nearest, ["a", "b"], "left_anti").select("a", "b")), "others")
    # keys whose members are still apart
    placed = stored(_labelled(members.select("key", "id", "n"), state.found), "placed")
    split = stored(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "split")
    rows = _in_blocks(placed.join(split, "key").join(sig, "id"), "key", F.col("n") / BLOCK)
    more = stored(rows.select("key", "i", "j", "block", "id", "component", "sig").mapInArrow(_across, "a bigint, b bigint"), "across")
    left = more.filter("b IS NOT NULL").join(close.select("a", "b"), ["a", "b"], "left_anti")
    if _some(left):
        state.verify(left, "sparse")
    dense = more.filter("b IS NULL").select(F.col("a").alias("key")).distinct()
    if _some(dense):
        inside = stored(_labelled(placed.join(dense, "key").select("key", "id"), state.found), "dense")
        full = inside.join(state.sets, "id").join(sig, "id")
        size = full.groupBy("key").agg(F.sum(F.octet_length("set")).alias("bytes"), F.count(F.lit(1)).alias("n"))
        rows = _in_blocks(full.join(size, "key"), "key", F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("n") / BLOCK))
        state.add(rows.select("key", "i", "j", "block", "id", "component", "sig", "set").mapInArrow(_linked, "a bigint, b bigint"), "links")
    return state.found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return near_duplicate_rows(docs).drop("row")


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The same with ``row``, the hash of a row's id and text."""
    signed = signatures(docs)
    first = F.min(F.struct("doc_id", "row")).alias("f")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(first, F.first("sig").alias("sig"))
    classes = stored(classes.select("d1", "d2", F.col("n_shingles").alias("n"), F.col("f.doc_id").alias("least"), "f.row", "sig"), "classes")
    classes, shared = _named(classes)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    found = linked_components(texts, classes.select("id", "row", "sig"))
    ids = _labelled(classes.select("d1", "d2", "n", "id", "least"), found)
    if shared and found is not None:  # a component is called by the smallest of its documents' ids, not of its classes' names
        least = ids.groupBy(F.col("component").alias("_name")).agg(F.min("least").alias("_least"))
        ids = ids.join(least, F.col("component") == F.col("_name")).withColumn("component", F.col("_least"))
    elif shared:
        ids = ids.withColumn("component", F.col("least"))
    joined = signed.join(ids.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "n", "component"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_shingles") == F.col("n")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _named(classes: DataFrame) -> tuple[DataFrame, bool]:
    """Classes with ``id``, a name of their own, and whether some share their smallest document id.

    The name is that document id; of classes that share it, the others get numbers below all ids.
    """
    shared = stored(classes.groupBy("least").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("first")).filter("m > 1"), "shared")
    if not _some(shared):
        return classes.withColumn("id", F.col("least")), False
    below = classes.agg(F.min("least")).first()[0]
    known = classes.join(shared.select(F.col("least").alias("_least"), "first"), F.col("least") == F.col("_least"), "left")
    own = F.when(F.col("first").isNull() | (F.col("row") == F.col("first")), F.col("least")).otherwise(F.lit(below - 1) - F.monotonically_increasing_id())
    return stored(known.withColumn("id", own).drop("_least", "first"), "named"), True


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
