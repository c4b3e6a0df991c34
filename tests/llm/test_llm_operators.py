"""The ten operators against brute force on small tables, with nulls, ties, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import SOLID, WORD, lower, shingles, water
from pyspark.sql import functions as F

from spindrift.llm import bwt, components, decontamination, embeddings, licenses, mixing, near_duplicates, pages, stages, store, suffix_dedup, toxicity, urls, warc, words

DOCS = "doc_id long, text string, lang string, source string, score double, id long, kept string"


def documents(spark, texts, source=None):
    """Rows with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", source(i) if source else f"src{(i or 0) % 3}", 0.5, -(i or 0), "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(rng.choice(["Der", "the", "of", "éa", "x"]) if rng.random() < 0.2 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "a b c d"), (906, "ünï çödé 漢字 " * 30)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(25)]
    texts = list(enumerate(base)) + [(100 + i, base[i]) for i in range(6)]
    for k in range(25):  # edited copies, some near the threshold, in a chain
        w = base[k % 4].split(" ")
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
        texts.append((200 + k, " ".join(w)))
    passage = sentence(rng, 60)
    texts += [(300 + k, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)) for k in range(5)]
    return texts + EDGE


def test_words():
    texts = ["Ab-c  dÉ9", "", None, "x" * 50, "tail"]
    got = [list(h) for _, h in words.word_lists(pa.array(texts), words.ALNUM)]
    want = [[words.hash_word(w) for w in WORD.findall(lower(t))] for t in texts]
    assert got == want
    cut = pa.array(["skip", *texts]).slice(1)
    assert [list(h) for _, h in words.word_lists(cut, words.ALNUM)] == want
    data = np.frombuffer(b"aa bbb c" * 50, dtype=np.uint8)
    s, e, _ = words.scan(data, np.array([0, len(data)]), words.SOLID)
    assert (words.hashes(data, s, e, block=7) == words.hashes(data, s, e)).all()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (5, 4), (3, 5), (None, 1)], "a long, b long")
    assert {r.id: r.component for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert components.components(edges.limit(0)).count() == 0


def test_bwt_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        shards = [[bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))] for _ in range(int(rng.integers(1, 4)))]
        depth = int(rng.integers(1, 30))
        strings = [s for shard in shards for s in shard]
        where = [k for k, shard in enumerate(shards) for _ in shard]
        suffixes = sorted(((s[k:] + b"\0", i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: (x[0][:depth] if len(x[0]) > depth else x[0], x[1]))
        z, new = bwt.merge([bwt.transform(s) for s in shards], depth)
        group = np.cumsum(new)
        want = defaultdict(list)
        for tail, i, k in suffixes:
            want[tail[:depth] if len(tail) > depth else (tail, i, k)].append(where[i])
        got = [sorted(z[group == g].tolist()) for g in np.unique(group)]
        assert sorted(map(tuple, got)) == sorted(tuple(sorted(v)) for v in want.values())


def test_repeated_windows_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        depth = int(rng.integers(1, 30))
        shards = [[bytes(rng.integers(97, 99, depth + int(rng.integers(0, 25))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))] for _ in range(int(rng.integers(1, 4)))]
        windows = [np.array([len(x) - depth + 1 for x in shard]) for shard in shards]
        group, *place = bwt.repeated([bwt.transform(x) for x in shards], windows, depth)
        texts = [shards[s][i][k : k + depth] for s, i, k in zip(*place, strict=True)]
        assert len(texts) == sum(map(sum, windows)) and len(set(zip(*map(np.ndarray.tolist, place), strict=True))) == len(texts)
        assert len(set(zip(group.tolist(), texts, strict=True))) == len(set(texts)) == len(set(group.tolist()))
        assert texts == sorted(texts)


def test_suffix_dedup(spark, corpus):
    got = {r.doc_id: r for r in suffix_dedup.digests(documents(spark, corpus)).collect()}
    seen: set = set()
    for i, t in sorted(corpus):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_with_a_line_that_is_in_many_texts(spark, monkeypatch):
    rng = random.Random(41)
    line, passage = "".join(rng.choices("abcdefghij ", k=60)), "".join(rng.choices("klmnopq ", k=150))
    texts = [(i, sentence(rng, 15) + line + sentence(rng, 15) + (passage[: rng.randint(90, 150)] if i % 3 == 0 else "")) for i in range(300)]
    docs = documents(spark, texts)
    want = {i: (int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(dict(texts)[i].encode(), gone, strict=True) if not g)).hexdigest()) for i, gone in brute.covered(texts).items()}
    tell = lambda: {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    segments = lambda table: sum(len(suffix_dedup.segments(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]), table)[0]) for _, t in texts)
    assert tell() == want
    table = suffix_dedup.common_grams(docs.select(F.col("doc_id").alias("doc"), "text"))
    assert 10 < table.sum() < 2000 and segments(table) > 0
    anchors = lambda table: [a for _, t in texts for a in suffix_dedup.segments(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]), table)[2].tolist()]
    most = lambda table: max(np.unique(anchors(table), return_counts=True)[1])
    assert most(None) >= 250 and most(table) <= 120  # the line is an anchor of none, the passage of the texts that have it
    monkeypatch.setattr(suffix_dedup, "CROWDED", 4)
    assert tell() == want
    monkeypatch.setattr(suffix_dedup, "COMMON", 10**6)
    assert tell() == want


def test_suffix_dedup_of_long_texts_and_columns_of_the_same_names(spark):
    rng = random.Random(42)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=9_000_000))
    rows = [(2, long[5_000_000:5_000_300], 1, 1), (1, long, 1, 1), (None, "z" * 99, 2, 2), (None, "z" * 100, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, doc int")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.digests(docs).collect()}
    assert got == {(1, 9_000_000): 0, (2, 300): 300, (None, 99): 0, (None, 100): 0}
    one, two = "".join(rng.choices("abcdef ", k=300)), "".join(rng.choices("ghijkl ", k=300))
    texts = [(None, one), (None, two), (None, None), (4, "x" + one), (4, two + "y"), (4, two + "y"), (5, two)]
    twice = suffix_dedup.digests(documents(spark, texts)).collect()
    assert sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in twice) == [(0, 0, 0), (0, 300, 0), (0, 300, 0), (4, 301, 300), (4, 301, 300), (4, 301, 300), (5, 300, 300)]
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and sorted(len(r.text) for r in out.collect()) == [0, 99, 100, 9_000_000]


def test_suffix_dedup_inside_one_text_and_empty(spark):
    text = "ab" * 120
    r = suffix_dedup.digests(documents(spark, [(1, text), (1, text)])).collect()
    assert [x.n_removed for x in r] == [238, 238] and r[0] == r[1]
    assert suffix_dedup.digests(documents(spark, [])).count() == 0
    out = suffix_dedup.deduplicated(documents(spark, [(1, "é" * 80), (2, "é" * 80)])).collect()
    assert [x.text for x in sorted(out, key=lambda x: x.doc_id)][1] == "" and out[0].lang == "en"


def test_near_duplicates(spark, corpus):
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(documents(spark, corpus)).collect()}
    sets = {i: shingles(t) for i, t in corpus}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert near_duplicates.near_duplicates(documents(spark, [])).count() == 0
    odd = near_duplicates.near_duplicates(documents(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd) == [(-1, -1, True), (5, 5, True), (5, 5, True)]


def test_near_duplicates_among_many_that_are_close_but_not_linked(spark):
    rng = random.Random(51)
    common = sentence(rng, 75, 10**6)
    texts = [(i, common + " " + sentence(rng, rng.randint(14, 26), 10**6)) for i in range(120)]  # similarities of 0.55 to 0.75
    texts += [(200 + k, texts[3 * k][1] + " " + sentence(rng, 3, 10**6)) for k in range(30)]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute.parts(texts) and 20 < len(set(got.values())) < 130


def test_candidates_reach_the_threshold():
    """Signatures of sets at similarities of 0.75 to 0.85 lie within the distance and meet under a key."""
    rng = np.random.default_rng(52)
    lost = 0
    for k in range(2000):
        union = rng.integers(0, 2**63, 400, dtype=np.uint64)
        both, only = int(400 * rng.uniform(0.75, 0.85)), rng.random(400) < 0.5
        at = np.arange(400)
        a, b = (near_duplicates.signature(np.unique(union[(at < both) | own])) for own in (only, ~only))
        far = int((a != b).sum())
        lost += far > near_duplicates.DISTANCE
        if far <= near_duplicates.DISTANCE:
            slot = int(near_duplicates.first_slots(a[None], b[None])[0])
            keys = [dict(near_duplicates._key_columns(x[None])) for x in (a, b)]
            assert slot == min(s for s in keys[0] if keys[0][s] == keys[1][s])
    assert lost <= 1


def test_large_group_of_near_copies_gives_few_rows(spark, monkeypatch):
    rng = random.Random(53)
    base = sentence(rng, 120, 10**6).split(" ")
    texts = [(i, " ".join(base[:100] + [f"own{i}"] + base[101:])) for i in range(3000)] + [(5000 + i, sentence(rng, 50, 10**6)) for i in range(50)]
    written = {}

    def counted(df, name):
        out = store.stored(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: 0 if i < 3000 else i for i, _ in texts}
    assert all(n <= 64 * 3050 for n in written.values()) and written["nearest"] >= 2999 and written["across"] < 100, written


def test_near_duplicates_of_long_texts_and_repeated_rows(spark):
    rng = random.Random(54)
    long = sentence(rng, 60_000, 10**6)
    texts = [(7, long), (3, long + " tail of it"), (3, long + " tail of it"), (9, long[: len(long) // 2]), (None, long), (8, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates.near_duplicates(documents(spark, texts)).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True), (7, 3, False), (8, 8, True), (9, 9, True)]


def test_exact_links_connect_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1000, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.07, rng.integers(0, 10**6, 60), base)).astype(np.uint64) for _ in range(30)]
    at = np.arange(30)
    out = near_duplicates.exact_links(at, sets, at, at)

    def parts(links):
        label = list(range(30))
        for a, b in links:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        return [[i for i in range(30) if label[i] == v] for v in dict.fromkeys(label)]

    full = [(a, b) for a in range(30) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]
    assert sorted(map(sorted, parts(out))) == sorted(map(sorted, parts(full))) and len(out) < 30


def test_decontamination(spark, corpus):
    rng = random.Random(3)
    w = WORD.findall(lower(dict(corpus)[300]))
    items = [(1, " ".join(w[5:30])), (2, sentence(rng, 30)), (10, "one"), (11, ""), (12, None), (3, "A-B, c! D"), (1, " ".join(w[30:42])), (4, dict(corpus)[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminated(documents(spark, corpus), bench).collect()}
    for i, t in corpus:
        d = WORD.findall(lower(t))
        hit, found = set(), set()
        for item, text in items:
            b = WORD.findall(lower(text))
            n = min(10, len(b))
            for k in range(max(1, len(b) - 9) if b else 0):
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == b[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(d), len(hit), len(found), bool(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    nameless = spark.createDataFrame([(None, "a b c"), (None, "c d"), ("None", "b c d")], "item_id string, text string")
    r = decontamination.decontaminated(documents(spark, [(1, "a b c d"), (2, "a b c")]), nameless).orderBy("doc_id").collect()
    assert [(x.n_hit, x.n_items) for x in r] == [(4, 2), (3, 1)] and r[0].items_sha256 == hashlib.sha256(b"None").hexdigest()
    assert not any(r.contaminated for r in decontamination.decontaminated(documents(spark, corpus[:5]), bench.limit(0)).collect())
    assert decontamination.decontaminated(documents(spark, []), bench).count() == 0


def test_search_in_rounds_and_proximity(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b x c d")])
    items = spark.createDataFrame([(1, "b c d"), (2, "e f"), (3, "a b")], "item_id long, text string")
    index = decontamination.build_index(docs)
    tell = lambda df: {r.doc_id: (sorted(r.hits), sorted(r["items"])) for r in df.collect()}
    once = tell(decontamination.search(index, items))
    assert once == {1: ([0, 1, 2, 3, 4, 5], ["1", "2", "3"]), 2: ([0, 1], ["3"])}
    assert tell(decontamination.search(index, items, broadcast_words=3)) == once
    near = {r.doc_id: sorted(r["items"]) for r in decontamination.search(index, items, slack=1).collect()}
    assert "1" in near[2]


def brute_vectors(rows):
    unit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            unit[i] = x / np.sqrt((x * x).sum())
    links = {a: [b for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95] for a in unit}
    label = {i: i for i, _ in rows}
    while True:
        low = {i: min([label[i], *(label[b] for b in links.get(i, ()))]) for i in label}
        if low == label:
            return {i: (len(links.get(i, ())), label[i]) for i, _ in rows}
        label = low


def test_embeddings(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(80)]
    for k in range(60):
        v = np.array(rows[k % 5][1])
        rows.append((100 + k, (v + rng.normal(size=16) * np.linalg.norm(v) * rng.choice([0.02, 0.05, 0.08])).tolist()))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, (3 * np.array(rows[0][1])).tolist())]
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0, None] + [0.0] * 14), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (405, []), (406, [1.0] * 8), (407, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    again = embeddings.near_vectors(df.filter("vec_id IN (0, 300)").unionByName(df.filter("vec_id = 0"))).collect()
    assert [r.n_links for r in again] == [1, 1, 1]


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 7)
    rng = np.random.default_rng(12)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.15 * np.linalg.norm(base)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()} == brute_vectors(rows)



def test_decontamination_keeps_rows_apart_in_every_round(spark):
    a, b = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    clean = " ".join(f"c{k}" for k in range(12))
    docs = documents(spark, [(1, a), (1, b), (1, b), (None, a), (None, clean), (None, clean)]).repartition(2)
    items = spark.createDataFrame([("x", a), ("y", b), ("z", "not there at all")], "item_id string, text string")
    index = decontamination.build_index(docs)
    tell = lambda words: sorted(((r.doc_id or 0), r.n_words, len(r.hits), sorted(r.items)) for r in decontamination.search(index, items, broadcast_words=words).collect())
    want = sorted([(1, 12, 12, ["x"]), (1, 12, 12, ["y"]), (1, 12, 12, ["y"]), (0, 12, 12, ["x"]), (0, 12, 0, []), (0, 12, 0, [])])
    assert tell(1000) == tell(5) == tell(12) == want


def test_contaminated_stage_decides_by_row(spark, tmp_path):
    bad, clean = " ".join(f"a{k}" for k in range(12)), " ".join(f"c{k}" for k in range(12))
    spark.createDataFrame([("x", bad)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(None, bad), (None, clean), (None, None), (7, bad), (7, clean), (8, clean), (8, clean)])
    left = stages.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(0, clean), (0, ""), (7, clean), (8, clean), (8, clean)])


def test_range_join_of_a_block_is_exact_and_prunes():
    rng = np.random.default_rng(22)
    x = rng.normal(size=(12_000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[:300] = x[0] + rng.normal(size=(300, 64)) * 1e-3
    own = x[:, :8].astype(np.float32)
    at, budget = np.arange(len(x)), embeddings.budgets(64, 0.95)[0]
    got, compared = set(), 0
    for i, j, n in embeddings.within_budget(own, at, at, budget + 1e-5):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
        compared += n
    for i in range(0, 12_000, 600):
        square = ((x[i, :8] - x[:, :8]) ** 2).sum(axis=1)
        assert {(i, j) for j in np.flatnonzero(square <= budget).tolist()} <= got
    assert compared < 0.15 * len(x) ** 2 and len(got) < 0.002 * len(x) ** 2
    tree = embeddings.Tree(x[:, :8], 32)
    home, met = tree.homes(x[:, :8]), defaultdict(set)
    for leaf, rows in tree.near(x[:, :8], budget):
        for r in rows.tolist():
            met[r].add(leaf)
    assert all(home[i] in met[i] and home[j] in met[i] for i, j in list(got)[:5000])
    assert np.bincount(home).max() < 3 * len(x) / 32 + 300


def test_embeddings_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    rng = np.random.default_rng(23)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(700)]
    rows += [(1000 + k, (np.array(rows[k % 90][1]) + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])).tolist()) for k in range(500)]
    rows += [(2000 + k, [1.0, 0.5 * k, 2.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()} == brute_vectors(rows)


def test_embeddings_in_small_tiles(spark, monkeypatch):
    """Many vectors near one point: all links are found, and no task has more rows than its tiles."""
    rng = np.random.default_rng(21)
    base, apart = rng.normal(size=16), rng.normal(size=(40, 16))
    rows = [(i, (base + rng.normal(size=16) * 0.2).tolist()) for i in range(260)] + [(300 + i, v.tolist()) for i, v in enumerate(apart)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = embeddings._linked

    def bounded(cosine, kind):
        inner = linked(cosine, kind)

        def of_tiles(key, part):
            assert len(part) <= 3 * 2 * 16, len(part)
            return inner(key, part)

        return of_tiles

    monkeypatch.setattr(embeddings, "_linked", bounded)
    monkeypatch.setattr(embeddings, "TILE", 16)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_licenses(spark):
    texts = [(1, "Released under the MIT License."), (2, "x\nLicensed under the Apache License, Version 2.0. More words here."), (3, "MIT-license, mit  LICENSE! general public\nlicense"), (4, "licensed by nobody"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, "mit"), (9, "license mit")]
    got = {r.doc_id: r for r in licenses.scanned(documents(spark, texts)).collect()}
    for i, t in texts:
        w = WORD.findall(lower(t))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(filter(None, r.labels.split(",")))
    assert got[7].labels == "cc-by-nc" and got[4].labels == "" and got[1].labels == "mit" and got[2].labels == "apache"
    assert licenses.scanned(documents(spark, [])).count() == 0


def test_wrapped_licenses(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General
 * Public License as published by the Free Software Foundation"""
    apart = [bsd.replace("without\n", "without\n\n"), bsd.replace("without\n", "without.\n"), " x ".join(bsd.split())]
    texts = [(1, mit), (2, f"Some code\n\n{bsd}\n\nmore"), (3, gpl), (4, bsd.replace("\n", "\r\n# ")), *((5 + k, text.replace(" x ", " x\n", 3)) for k, text in enumerate(apart))]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(documents(spark, texts)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("gpl", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0)}


def test_licenses_of_long_texts_and_columns_of_the_same_names(spark):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    long = "plain words of a text. " * 250_000 + notice + ". " + "MIT license " * 3
    rows = [(1, long, "x", 1), (None, notice, "y", 2), (None, None, "z", 3), (1, long, "x", 1)]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.n_base, r.labels, r.score) for r in got) == [(0, 0, 0, "", 0.0), (0, 21, 0, "bsd", 1.0), *[(1, 1_250_027, 3, "bsd,mit", 1.0)] * 2]


def test_license_join_against_all_pairs():
    rng = random.Random(5)
    t = licenses.Templates()
    t.ordered(np.array([rng.randrange(1000) for _ in t.vocabulary]))
    for _ in range(400):
        base = rng.choice(t.sets)
        block = {int(x) for x in base if rng.random() < 0.85} | {rng.randrange(len(t.vocabulary)) for _ in range(rng.randint(0, 8))}
        ranks = np.unique(t.rank[sorted(block)]) if block else np.zeros(0, np.int64)
        want = {k for k, s in enumerate(t.sets) if len(block & set(s.tolist())) >= t.needed[k]}
        assert {k for k, _ in t.matches(ranks)} == want


def test_urls(spark):
    rows = [(1, "https://A.example.com/en/7?x"), (2, "http://x.com/en/1"), (3, "https://www.net/de/9"), (4, "http://example.net/de/8#a"), (5, "http://a.org/es/"), (6, None), (7, "no scheme"), (8, "http://b.org?q=/es/"), (9, "://h"), (10, "http://notcom/en/1"), (11, "http://a.net/fr/1")]
    rows += [(100 + k, f"http://h{k}.net/de/{k}") for k in range(60)] + [(200 + k, f"http://spam{k}.org/es/{k}") for k in range(60)] + [(300, "http://spam9.info/es/77"), (301, "http://h3.info/de/12")]
    df = spark.createDataFrame([(i, u, "allow", 0.1) for i, u in rows], "page_id long, url string, verdict string, score double")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    tell = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert tell(1) == ("a.example.com", "/en/7", "example.com/en/7", "allow") and tell(2) == ("x.com", "/en/1", "com/en/", "block")
    assert tell(3)[2:] == ("net/de/", "allow") and tell(4) == ("example.net", "/de/8", "example.net/de/8", "block") and tell(5)[2:] == ("org/es/", "block")
    assert tell(6) == ("", "", None, "allow") and tell(7)[:3] == ("", "", None) and tell(8)[:3] == ("b.org", "", None) and tell(9)[:2] == ("h", "") and tell(10)[2] is None
    assert got[300].verdict == "block" and got[301].verdict == "allow"
    assert urls.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judged(df.filter("page_id IN (11, 6)")).collect()} == {"allow"}


def test_urls_without_rules_long_urls_and_columns_of_the_same_names(spark):
    rows = [(None, None), (None, "http://a.net/de/" + "x" * 300_000), (5, "http://b.org/es/1"), (5, "http://b.org/es/1"), (6, "http://b.org/es/" + "é%" * 50_000), (7, ""), (8, "a://b://c/d")]
    df = spark.createDataFrame([(i, u, "h", "r", 1, True, 0) for i, u in rows], "page_id long, url string, host string, rule string, chunk int, aside boolean, run int")
    got = sorted(((r.page_id or 0), len(r.path), r.rule or "", r.verdict) for r in urls.judged(df).collect())
    assert got == [(0, 0, "", "allow"), (0, 300_004, "net/de/", "allow"), (5, 5, "org/es/", "block"), (5, 5, "org/es/", "block"), (6, 100_004, "org/es/", "block"), (7, 0, "", got[5][3]), (8, 5, "", got[6][3])]


def test_url_scores_use_exact_counts_however_many(spark):
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-é"
    rows = [(k, f"http://{''.join(rng.choices(letters, k=25))}.{('net/de/', 'org/es/', 'info/')[k % 3]}{k % 7}") for k in range(6000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    aside = {r.page_id for r in df.filter("pmod(xxhash64(url), 5) = 0").collect()}
    own, contexts = defaultdict(int), defaultdict(int)
    padded = {i: [0] * urls.ORDER + [b + 1 for b in u.split("://")[1].encode()] for i, u in rows}
    for i, s in padded.items():
        if i % 3 < 2 and i not in aside:
            for at in range(urls.ORDER, len(s)):
                for k in range(urls.ORDER + 1):
                    own[i % 3, tuple(s[at - k : at + 1])] += 1
                    contexts[i % 3, tuple(s[at - k : at])] += 1
    assert sum(len(k[1]) == urls.ORDER + 1 for k in own) > 1 << 16
    got = {r.page_id: r.score for r in urls.judged(df).collect()}
    for i, s in list(padded.items())[:300]:
        total = 0.0
        for at in range(urls.ORDER, len(s)):
            p = [1 / 256] * 2
            for k in range(urls.ORDER + 1):
                p = [(own.get((kind, tuple(s[at - k : at + 1])), 0) + urls.TRUST * p[kind]) / (contexts.get((kind, tuple(s[at - k : at])), 0) + urls.TRUST) for kind in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        assert got[i] == pytest.approx(total / (len(s) - urls.ORDER), abs=1e-9)


def test_warc(spark, tmp_path):
    long, rng = "<p>" + "é" * 200 + "</p>", random.Random(1)
    rows = [(5, "http://a/", long), (3, None, long), (9, "http://b/\r\nX: y", "short"), (8, "http://c/", "short"), (10, "u", None), (11, "u", ""), (3, "again", long), (None, "n", long)]
    rows += [(100 + k, f"http://h/{k}", "".join(rng.choices("abc<>é\x1f", k=rng.randint(0, 3000)))) for k in range(40)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    made = warc.write(df.repartition(3), folder)
    whole = warc.read(spark, folder, made).collect()
    for size in (1, 37, 1000):
        few = made if size > 1 else made[:1]
        cut = warc.read(spark, folder, few, size).collect() if size > 1 else None
        if cut is not None:
            assert sorted((r.path, r.start) for r in cut) == sorted((r.path, r.start) for r in whole)
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = first[raw] if raw in first and first[raw] != i else None
        want.append((str(i).lower().replace("none", "null"), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = [(r.record_id.rsplit(":")[-1], r.payload_bytes, r.payload_digest[7:], r.record_type, int(r.refers_to.rsplit(":")[-1]) if r.refers_to else None) for r in whole]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest[7:] for r in whole)
    assert warc.write(df.limit(0), f"file://{tmp_path}/e") == [] and warc.read(spark, f"file://{tmp_path}/e", []).count() == 0


def test_warc_range_skips_false_magic(tmp_path):
    good = warc.record(1, "u", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None)
    data = warc.MAGIC + b"junk" + zlib.compress(b"not a record", wbits=31) + good
    path = tmp_path / "x"
    path.write_bytes(data)
    with pa.OSFile(str(path)) as f:
        assert [at for at, _ in warc.records_in(f, len(data), 0, len(data))] == [len(data) - len(good)]


class Counted:
    """An open file that adds up what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def test_warc_of_long_pages_and_columns_of_the_same_names(spark, tmp_path):
    rows = [(1, "u", "é" * 2_000_000), (2, "u", "é" * 2_000_000), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    files = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w", files, 1000).select("record_type", "payload_bytes", "target_uri").collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(record_type=a, payload_bytes=b, target_uri=c) for a, b, c in (("response", 4_000_000, "u"), ("revisit", 4_000_000, "u"), ("response", 0, None))]))


def test_warc_reads_each_byte_about_once():
    rng = random.Random(2)
    bodies = [bytes(rng.randbytes(12_000 + 50 * k)) for k in range(60)] + [rng.randbytes(3_000_000)]
    data = b"".join(warc.record(k, "u", b, hashlib.sha256(b).hexdigest(), None) for k, b in enumerate(bodies))
    whole = list(warc.records_in(Counted(data), len(data), 0, len(data)))
    assert [warc.parsed(x)["payload"] for _, x in whole] == bodies
    one = Counted(data)
    assert len(list(warc.records_in(one, len(data), 0, len(data)))) == 61 and one.read < 1.1 * len(data)
    cut, read = [], 0
    for lo in range(0, len(data), 1 << 20):  # the last record of 3 MB begins in one range and ends in a later one
        source = Counted(data)
        cut += warc.records_in(source, len(data), lo, min(lo + (1 << 20), len(data)))
        read += source.read
    assert cut == whole and read < 2 * len(data)
    for window in (7, 1000, 4097):
        assert list(warc.records_in(Counted(data[:100_000]), 100_000, 0, 60_000, window)) == [x for x in whole if x[0] < 60_000]


def toxic_tables(spark, n=400):
    rng = random.Random(9)
    texts = [(i, sentence(rng, 40) + (" you utter scoundrel and vile wretch" if i % 4 == 0 else "")) for i in range(n)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_tables(spark)
    docs = documents(spark, texts + [(9001, None), (9002, "")])
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    assert {i: r.held_out for i, r in got.items()} == held
    out = [i for i, _ in texts if held[i]]
    assert sum((got[i].predicted == 1) == (i % 4 == 0) for i in out) >= 0.95 * len(out)
    assert got[9001].score == got[9002].score < 0.5 and len(model[0]) < 5000
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()  # held-out labels are never read


def test_toxicity_against_a_plain_loop(spark):
    texts, labels = toxic_tables(spark, 150)
    texts = texts + [(9001, None), (9002, ""), (9003, "vile wretch " * 40_000), (5, "another text of id five"), (None, "scoundrel")]
    docs = documents(spark, texts)
    place = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64("doc_id").alias("p")).collect()}
    want = brute.toxic_scores(texts, [(r.doc_id, r.toxic) for r in labels.collect()], place, words)
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert sorted(((r.doc_id or 0), round(r.score, 9)) for r in got.collect()) == sorted(((i or 0), round(s, 9)) for (i, _), s in zip(texts, want, strict=True))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    texts, labels = toxic_tables(spark, 200)
    docs = documents(spark, texts)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 1)
    assert len(toxicity.train(docs, labels)[0]) == 0 and len(toxicity.train(docs, labels, sample=3)[0]) == 0


def test_toxicity_without_labels(spark):
    texts, labels = toxic_tables(spark, 5)
    docs = documents(spark, texts)
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0}
    assert toxicity.score(documents(spark, []), toxicity.train(documents(spark, []), labels)).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    texts = [(i, sentence(rng, rng.randint(0, 60)) if i % 50 else None) for i in range(3000)]
    names = ["b", "a", "é", None, "Z", "tiny"]
    source = lambda i: "tiny" if i < 5 else names[min(i % 11, 4)]
    docs = documents(spark, texts, source)
    got = mixing.mix(docs).collect()
    size = {i: len(SOLID.findall(t or "")) for i, t in texts}
    sums: dict = defaultdict(int)
    taken: dict = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.size
        taken[r.source] += r.taken
    assert len(got) == len(texts)
    target = water(sums)
    for r in got:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(target[r.source])
    for s in target:
        assert abs(taken[s] - target[s]) <= 60, s
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()} == {0}


def test_mixing_with_repeated_and_null_ids_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "FAN", 8)
    rng = random.Random(14)
    texts = [(None if i % 2 else i % 5, sentence(rng, 1 + i % 7)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, None if k % 9 == 0 else f"host{k % 150}", k, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, source string, k long, n long")
    written = []

    def counted(df, name):
        out = store.stored(df, name)
        if name.startswith("mix"):
            spread = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
            written.append((name, out.count(), len(spread)))
        return out

    monkeypatch.setattr(mixing, "stored", counted)
    got = mixing.mix(docs).collect()
    assert len(got) == 900 and len(written) >= 3 and written[-1][1] < written[0][1] < 901
    sums, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water(sums)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 7 for s in sums)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_settle_keeps_words_and_expectation():
    size, total = np.array([5.0, 9, 2, 7, 4, 30, 1, 8, 3]), np.zeros(9)
    for seed in range(3000):
        out = mixing.settle(np.full(9, 0.3), size, np.random.default_rng(seed))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and abs(out @ size - 0.3 * size.sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - 0.3).max() < 0.04


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Menu {0}</a></li></ul></nav>
<header><h2>Site</h2></header><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>
<article><h1>Title &amp; more {0}</h1><p><b>First  para&nbsp;graph<br>goes on.<p>Second &lt;b&gt; {1}</p><script>var t="</p>";</script><form><p>Subscribe</p></form><aside>Side</aside>
<ul><li>one<li>two</ul></article><div id="comments"><p>Reader says a lot of words here that are long enough to matter {1}</p></div><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    body = "with enough words to be the main text of this page, and then some more. " * 4
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE.format(k, body)) for k in range(6)] + [(50, "http://h0.example.com/x", None), (51, "", ""), (52, None, "plain <b>text</b>"), (53, "http://z/", "<p>unclosed <i>tag<div class='x'>in div")]
    df = spark.createDataFrame([(i, u, h, "path") for i, u, h in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in pages.extracted(df).collect()}
    clean = " ".join(body.split())
    for k in range(6):
        assert got[k].text == f"Title & more {k}\nFirst para graph goes on.\nSecond <b> {clean}\none\ntwo"
        assert got[k].n_chars == len(got[k].text)
    assert got[50].text == got[51].text == "" and got[52].text == "plain text" and got[53].text == "unclosed tag\nin div"
    assert pages.extracted(df.limit(0)).count() == 0


def test_host_votes_win(spark):
    """A page whose sidebar is longer than its article is read by the path that its host's other pages have."""
    page = lambda main, side: f"<body><div class='post7'><p>{main}</p></div><div class='box'><p>{side}</p></div></body>"
    rows = [(k, "http://h/1", page("main words " * 40, "side")) for k in range(5)] + [(9, "http://h/9", page("short main", "long box " * 30))]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short main"


def test_pages_keep_headings_leads_and_sibling_sections(spark):
    body = "words of the main text that go on. " * 40
    clean, short = body.strip(), "a second part that is a good deal shorter"
    shapes = [
        (f"<article><h1>Title</h1><p>The lead.</p><div class='body'><p>{body}</p></div></article>", f"Title\nThe lead.\n{clean}"),
        (f"<div class='post'><h1>Title</h1><div class='body'><p>{body}</p></div></div>", f"Title\n{clean}"),
        (f"<div class='post'><div class='top'><h1>Title</h1></div><p>The lead.</p><div class='body'><p>{body}</p></div></div>", f"Title\nThe lead.\n{clean}"),
        (f"<div class='content'><div class='part'><p>{body}</p></div><div class='part'><p>{short}</p></div></div>", f"{clean}\n{short}"),
        (f"<div class='content'><div class='part'><p>{body}</p></div><div class='rest'><p>{body[:400]}</p></div></div>", f"{clean}\n{body[:400].strip()}"),
    ]
    menu = "<div class='links'>" + "<p><a href='/'>a link of a list</a></p>" * 9 + "</div>"
    rows = [(10 * k + j, f"http://h{k}/{j}", f"<body>{shape}{menu}</body>") for k, (shape, _) in enumerate(shapes) for j in range(2)]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: shapes[i // 10][1] for i, _, _ in rows}


def test_pages_with_marks_among_other_words():
    body = "<p>" + "word goes here and there. " * 20 + "</p>"
    clean = ("word goes here and there. " * 20).strip()
    text = lambda html: pages.main_text(pages.containers(html), None)
    for name in ("content has-sidebar", "content-with-sidebar", "social-good-news", "post no-ads"):
        assert text(f'<body><div class="{name}">{body}<div class="sidebar">SIDE</div><div id="main-nav">x</div></div></body>') == clean
    assert text(f'<article>{body}<section class="related-work"><p>It stays.</p></section><div class="related-posts">gone</div></article>') == f"{clean}\nIt stays."
    assert text(f'<body><div class="x">{body}</div><div class="sidebar-trending-now">some trending thing</div></body>') == clean
    assert text(f'<body><div class="x"><p>Short.</p></div><div class="cookie-notice">{body}</div><div class="comment-list">{body}</div></body>') == "Short."
    assert text("<body><div class='page with-menu'><div class='inner has-ads'>" + body + "</div></div><div>short rest</div></body>").startswith(clean)


@pytest.mark.parametrize("name", ["main-content sidebar-right", "layout nav-left", "page-wrapper banner-top", "post-content widget", "entry-content related", "widget-content", "content comments-open", "sidebar", "col-md-8 has-ads"])
def test_layout_classes_do_not_empty_an_article(name):
    """A class that names something else as well is judged by the text that it holds; so is one that names nothing else."""
    body = "Words of the article that go on and on. " * 12
    html = f"<body><div class='nav'><a href='/'>Home</a></div><div class='{name}'><h1>Title</h1><p>{body}</p><div class='ad-300x250'>Buy now</div><div class='user-comments'>Reader says hi</div></div><div class='sidebar-box'>Side words.</div></body>"
    assert pages.main_text(pages.containers(html), None) == f"Title\n{body.strip()}"


def test_adverts_and_comments_inside_an_article():
    body = "Words of the article that go on and on. " * 12
    for name in ("ad-300x250", "user-comments", "recommended", "outbrain", "box recommended", "comments-area", "widget cookie-note", "sidebar"):
        assert pages.main_text(pages.containers(f"<article><p>{body}</p><div class='{name}'><p>Away with it.</p></div><p>End.</p></article>"), None) == f"{body.strip()}\nEnd."
    assert pages.main_text(pages.containers(f"<article class='has-comments'><p>{body}</p><div class='related-work'><p>It stays.</p></div></article>"), None) == f"{body.strip()}\nIt stays."


def test_extracted_by_layout_classes_in_spark(spark):
    body = "Words of the article that go on and on. " * 12
    rows = [(k, f"http://h/{k}", f"<body><div class='main-content sidebar-right'><p>{body}{k}</p></div></body>") for k in range(3)]
    assert {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {k: f"{body}{k}" for k in range(3)}


def test_markup_that_must_not_take_the_rest_of_the_page():
    text = lambda html: pages.main_text(pages.containers(html), None)
    for html, want in (
        ("<p>Before <svg viewBox='0 0 1 1'/> and after.</p><p>More.</p>", "Before and after.\nMore."), ("<p>One <math/> two.</p><p>More.</p>", "One two.\nMore."),
        ("<div><select><option>A<option>B</div><p>The rest.</p>", "The rest."), ("<p>Choose <select><option>A</p><p>The rest.</p>", "Choose\nThe rest."), ("<p>a</p><select><option>x<option>y<p>The rest.</p>", "a\nThe rest."),
        ("<p>a</p><noscript><p>The rest.</p>", "a\nThe rest."), ("<p>a</p><noscript><p>Turn scripts on.</p></noscript><p>b</p>", "a\nb"), ("<p>a</p><object data='x'><p>Instead of it.</p></object><p>b</p>", "a\nInstead of it.\nb"),
        ("<p>a</p><!--><p>Shown.</p><!-- c --><p>b</p>", "a\nShown.\nb"), ("<p>a</p><!---><p>Shown.</p>-->", "a\nShown.\n-->"), ("<p>a</p><!-- x --!><p>Shown.</p>", "a\nShown."),
        ("<p>a <svg><svg><text>in</text></svg><text>label</text></svg> b</p>", "a b"), ("<p>Hello <svg><foreignObject><div>label</div></foreignObject></svg> world</p><p>b</p>", "Hello world\nb"), ("<p>a<svg><title/><path d='1'/></svg>b</p><p>c</p>", "ab\nc"),
        ("<p>x <button><div>Press</div></button> y</p>", "x y"), ("<p>a</p><svg><text>no end</text><p>The rest.</p>", "a\nno end\nThe rest."),
    ):
        assert text(html) == want, html


def test_deep_and_long_pages_in_linear_time():
    text = lambda html: pages.main_text(pages.containers(html), None)
    for deep in (600, 100_000):
        assert text("<div>" * deep + "<nav>MENU ITEM</nav><aside>ADVERT</aside><p>text</p>" + "</div>" * deep) == "text"
    assert text("<div class='has-ads'>x" * 20_000).split("\n")[:9] == ["x"] * 9
    assert text("<i>" * 100_000 + "a" + "</b>" * 100_000 + "b") == "ab"
    assert text("<article>" + "<p>one two" * 200_000) == "\n".join(["one two"] * 200_000)
    page = pages.containers("<div class='a>b'>" * 300 + "<p>deep words")
    top = pages.lifted(page, pages.best(page))
    assert pages.main_text(page, top.path) == "deep words" and pages.path_digest(top.path) == top.digest


def test_pages_with_null_ids_and_columns_of_the_same_names(spark):
    rows = [(None, "http://h/1", "<p>a b</p>", "x", 1), (None, "http://h/1", "<p>a b</p>", "x", 1), (3, None, None, "y", 2), (4, "u", "&amp;&lt;p&gt; &eacute;&#x41; " * 1000, "z", 3)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "a b"), (0, "a b"), (3, ""), (4, " ".join(["&<p> éA"] * 1000))]


def test_mix_spreads_rows_of_one_id(spark):
    """15,000 rows with a null id and sizes of their own fall into groups of about ``GROUP``, and the source meets its target."""
    docs = spark.range(15_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") + 1).alias("words")).unionByName(spark.createDataFrame([(1, "t", 10**8)], "doc_id long, source string, words long"))
    out = store.stored(mixing.mix(docs, size="words"), "mixed")
    spread = out.filter("source = 's'").select(F.xxhash64("doc_id", "source", "size", F.lit(1)).alias("order")).groupBy(F.pmod(F.shiftright("order", 5), F.lit(15))).count().collect()
    assert len(spread) == 15 and max(r["count"] for r in spread) < 2 * mixing.GROUP
    r = out.filter("source = 's'").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).first()
    assert abs(r.taken - r.target) <= 15_000 and r.most <= 3


def test_toxicity_bounds_rows_of_one_id(spark):
    """Rows of one labelled id, alike or not, don't add to what is learned from beyond the sample, and their order doesn't matter."""
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("own text "), (F.col("id") % 900).cast("string")).alias("text"))
    labels = spark.createDataFrame([(one, 1)], "doc_id long, toxic int")
    at, weight, bias = toxicity.train(docs, labels, sample=50)
    again = toxicity.train(docs.distinct().orderBy(F.desc("text")), labels, sample=50)
    assert (at == again[0]).all() and (weight == again[1]).all() and bias == again[2]
    few = {toxicity.train(docs.limit(0), labels, sample=50)[2], bias}
    assert len(few) == 2


def test_urls_that_say_nothing_are_allowed(spark, monkeypatch):
    monkeypatch.setattr(urls, "threshold", lambda rows: -1.0)
    rows = [(k, f"http://{'net' if k % 2 else 'example.com'}/{'de' if k % 2 else 'en/7'}/{k}") for k in range(40)] + [(100, None), (101, ""), (102, "no scheme"), (103, "http://other.org/x")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k] for k in (100, 101, 102)] == ["allow"] * 3


def test_rounds_are_bounded_for_one_item(spark, monkeypatch):
    """Rows of one id and one long text are spread over the rounds, and the hits are those of one round."""
    rng = random.Random(4)
    long = sentence(rng, 3000, 5000)
    items = [("one", sentence(rng, 40, 5000)) for _ in range(200)] + [("long", long), ("short", "two words"), ("none", ""), (None, sentence(rng, 30, 5000))]
    texts = [f"{sentence(rng, 20)} {' '.join(long.split()[k * 100 : k * 100 + 30])} tail" for k in range(20)] + [items[5][1], "just two words", "", None]
    index = store.stored(decontamination.build_index(documents(spark, list(enumerate(texts)))), "index")
    table = spark.createDataFrame(items, "item_id string, text string")
    sizes = []
    plain = decontamination.Phrases.__init__

    def spied(self, rows, window):
        sizes.append(sum(len((t or "").split()) for _, t in rows))
        plain(self, rows, window)

    monkeypatch.setattr(decontamination.Phrases, "__init__", spied)
    told = lambda n: {r.doc_id: (sorted(r.hits), sorted(x or "" for x in r["items"])) for r in decontamination.search(index, table, broadcast_words=n).collect()}
    whole = told(1 << 20)
    assert len(sizes) == 1
    assert told(1500) == whole and sum(bool(h) for h, _ in whole.values()) >= 21
    assert len(sizes) > 5 and max(sizes[1:]) <= 3 * 1500


def test_suffix_runs_are_handed_on_early():
    """A task of the pipeline's suffix step holds the runs of some twenty megabytes of text, not of all it reads."""
    import types

    import numpy as np
    import pyarrow as pa

    from spindrift.llm import suffix_dedup

    read = []

    def batches():
        for i in range(80):
            read.append(i)
            text = np.random.default_rng(i).integers(97, 123, 1 << 20, dtype=np.uint8).tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text])], ["doc", "text"])

    next(suffix_dedup._runs(types.SimpleNamespace(value=None))(batches()))
    assert len(read) < 40
