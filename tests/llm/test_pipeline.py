"""The pipeline against plain versions of its stages, on the smallest tables."""

import random
from collections import defaultdict
from pathlib import Path

import brute
import pytest
from brute import shingles
from pyspark.sql import functions as F

from spindrift.llm import near_duplicates, stages, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def test_pipeline_against_plain_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "source", F.xxhash64("doc_id").alias("place")).collect()
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    scores = brute.toxic_scores([(r.doc_id, r.text) for r in rows], labels, {r.doc_id: r.place for r in rows}, words)
    left = {r.doc_id: r.text for r, s in zip(rows, scores, strict=True) if s < 0.5}
    assert 0 < len(left) < len(rows)
    label = brute.parts(list(left.items()))
    left = {i: t for i, t in left.items() if label[i] == i}
    for i, gone in brute.covered(list(left.items())).items():
        left[i] = bytes(b for b, g in zip((left[i] or "").encode(), gone, strict=True) if not g).decode(errors="ignore")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not brute.contaminated(t, items)}
    out = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(out) == set(left)
    source = {r.doc_id: r.source for r in rows}
    sums, taken = defaultdict(int), defaultdict(int)
    for i, t in left.items():
        assert out[i].size == len(brute.SOLID.findall(t or "")) and out[i].source == source[i]
        assert out[i].copies in range(4) and out[i].taken == out[i].copies * out[i].size
        sums[source[i]] += out[i].size
        taken[source[i]] += out[i].taken
    target, largest = brute.water(sums), max(r.size for r in out.values())
    for i, r in out.items():
        assert r.source_size == sums[source[i]] and r.target == pytest.approx(target[source[i]])
    assert all(abs(taken[s] - target[s]) <= largest for s in sums)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in stages.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_with_null_and_repeated_ids_and_columns_of_the_same_names(spark):
    text = "some clean words that stand here only once and nowhere else at all " * 3
    rows = [(None, text, 1, 1, "x"), (None, None, 1, 1, "x"), (7, text, 2, 2, "y"), (7, text, 2, 2, "y"), (8, "", 3, 3, "z"), (9, text + " with a tail", 3, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, _ranges int, _gone string")
    near = stages.drop_near_duplicates(spark, docs, SF)
    # rows with a null id stay; the rows of a repeated id are that document twice, and stay or go together
    assert near.columns == docs.columns and sorted((r.doc_id or 0) for r in near.collect()) == [0, 0, 7, 7, 8]
    mixed = spark.createDataFrame([(5, text), (5, "another text of the same id, which nobody else has"), (3, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:7]) for r in stages.drop_near_duplicates(spark, mixed, SF).collect()) == [(3, text[:7]), (5, "another")]
    for _, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() >= 5
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    """Rows are linked by their own texts: held against all pairs of rows."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(14)]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " tail"), (3, base[1] + " tail")]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"e{rng.randrange(5)}"
        rows.append((rng.randrange(4, 16), " ".join(words)))
    rows += [(20, ""), (20, None), (20, base[0] + " tail")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    want = sorted((rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    four = spark.createDataFrame(rows[:4], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(four).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
