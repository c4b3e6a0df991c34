"""Matching without replacement and one pair a project against the sequential rule."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import analysis, matching, numbering, resampled, resampling


def plain_greedy(rows):
    """Units in stable order, each takes the nearest partner left."""
    key = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    out = set()
    for g in {r[0] for r in rows}:
        own = [(math.log1p(s), key(k), k, p) for gg, p, s, k in rows if gg == g and s is not None]
        left = [r for r in own if not r[3]]
        for s, _, k, _ in sorted((r for r in own if r[3]), key=lambda r: r[1]):
            if left:
                best = min(left, key=lambda r: (abs(r[0] - s), r[1]))
                left.remove(best)
                out.add((g, k, best[2], round(abs(best[0] - s), 9)))
    return out


def made(rng, n, share, sizes, groups):
    return [(rng.choice(groups), rng.random() < share, sizes(), k) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("span", [2, 16, 8192])
def test_equals_the_sequential_rule(spark, span):
    rng = random.Random(span)
    groups = ["a", None, "", "b"]
    rows = made(rng, 100, 0.3, lambda: float(rng.randint(1, 50)), groups)
    rows += made(random.Random(9), 50, 0.7, lambda: rng.choice([5.0, 5.0, 8.0, 3.0, None]), ["many units"])
    rows += [("crowd", True, 1000 + rng.random(), 10_000 + k) for k in range(20)] + [("crowd", False, rng.uniform(1, 3000), 20_000 + k) for k in range(30)]
    rows = [(g, p, s, i * 100_000 + k) for i, (g, p, s, k) in enumerate(rows)] + [("units only", True, 1.0, 7), ("partners only", False, 1.0, 8)]
    df = spark.createDataFrame(rows, "g string, p boolean, s double, k long").repartition(5)
    got = matching.match_without_replacement(df, "g", "p", "s", "k", span)
    assert {(r.g, r.unit, r.match, round(r.distance, 9)) for r in got.collect()} == plain_greedy(rows)


def test_nothing_to_match(spark):
    df = spark.createDataFrame([], "g string, p boolean, s double, k long")
    assert matching.match_without_replacement(df, "g", "p", "s", "k").count() == 0


def test_one_large_group(spark):
    """A group of 40,000 rows over 32 ranges: partners are used once, and no unit envies a later one its partner."""
    rows = spark.range(40_000).select(F.lit("g").alias("g"), (F.col("id") % 5 == 0).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) + 1).cast("double").alias("s"), F.col("id").alias("k"))
    got = matching.match_without_replacement(rows, "g", "p", "s", "k", 1000).collect()
    assert len(got) == 8000 and max(Counter(r.match for r in got).values()) == 1
    plain = plain_greedy_fast([tuple(r) for r in rows.collect()])
    assert {r.unit: r.match for r in got} == plain


def plain_greedy_fast(rows):
    import bisect

    key = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    left = sorted((math.log1p(s), key(k), k) for _, p, s, k in rows if not p)
    out = {}
    for _, s, k in sorted((key(k), math.log1p(s), k) for _, p, s, k in rows if p):
        i = bisect.bisect_left(left, (s, "", 0))
        near = [j for j in (i - 1, i) if 0 <= j < len(left)]
        near += [bisect.bisect_left(left, (left[j][0], "", 0)) for j in near]
        j = min(near, key=lambda j: (abs(left[j][0] - s), left[j][1]))
        out[k] = left.pop(j)[2]
    return out


def test_numbers_within_groups(spark):
    rows = [(g, i % 7, i) for i in range(200) for g in ("a", None)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, o int, id long").repartition(7)
    got = numbering.counted(df, ["g"], ["o", "id"], "n").collect()
    for g in ("a", None, "b"):
        own = sorted((r.o, r.id, r.n) for r in got if r.g == g)
        assert [n for *_, n in own] == list(range(len(own)))
    got = numbering.counted(df, [], ["g", "o", "id"], "n", F.col("o") == 3).collect()
    own = sorted(((r.g is not None, r.g or "", r.o, r.id), r.n) for r in got)
    seen = 0
    for (_, _, o, _), n in own:
        assert n == seen
        seen += o == 3


def test_quotas_reach_few_rows(spark):
    """Of 20,000 rows only what quotas can reach goes to the choosing task, and the choice is that of the plain loop."""
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(900)}", rng.choice(["a", "b", None]), i) for i in range(20_000)] + [(f"q{i}", "rare", i) for i in range(3)]
    df = spark.createDataFrame(rows, "project string, category string, k long")
    quotas, total = {"a": 7, "rare": 5, "b": 4}, 30
    assert matching._candidates(df, "project", "category", "k", quotas, total).count() <= sum(min(n, total) + total for n in quotas.values()) + 2 * total
    key = lambda r: hashlib.sha256("\x1f".join(("quota", r[0], str(r[2]))).encode()).hexdigest()
    want, used = [], set()
    for name, most in [*quotas.items(), (None, total)]:
        for r in sorted(rows, key=key):
            if most and len(want) < total and r[0] not in used and name in (None, r[1]):
                want.append((str(r[2]), r[0], r[1], len(want) + 1))
                used.add(r[0])
                most -= 1
    got = matching.fill_quotas(df, "project", "category", "k", quotas, total).collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == want


def test_too_few_pairs_are_an_error(spark):
    df = spark.createDataFrame([("p", True, "a", 3.0, 1), ("p", False, "a", 5.0, 2), ("p", False, "a", 2.0, 3), ("alone", True, "a", 1.0, 4)], "g string, y boolean, c string, s double, k long")
    got = matching.one_pair_a_project(df, "g", "y", "c", "s", "k", {"a": 2}, 2).collect()
    assert [(r.g, r.unit, r.match) for r in got] == [("p", 1, 3)]
    with pytest.raises(matching.CohortError, match="pair_count_not_2:1"):
        matching.one_pair_a_project(df, "g", "y", "c", "s", "k", {"a": 2}, 2, exact=True)


def test_permutations_in_buckets_are_one_order(spark, monkeypatch):
    """However small the buckets, places are those of one sort by hashed key, and every group's rows change places within it."""
    rows = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(120)], "g string, unit long")
    key = resampling.hashed_draw(F.lit(5), F.col("r"), F.col("unit"))
    told = lambda: sorted(((r.g or "", r.r, r.place, r.unit) for r in analysis.permuted(rows, ["g"], 3, key).collect()))
    whole = told()
    monkeypatch.setattr(analysis, "BUCKET", 7)
    assert told() == whole
    for g in ("", "a"):
        for r in (1, 2, 3):
            own = [x for x in whole if x[:2] == (g, r)]
            draw = lambda u, r=r: int(hashlib.md5(f"5|{r}|{u}".encode()).hexdigest()[:8], 16)
            assert [x[2] for x in own] == list(range(120)) and [x[3] for x in own] == sorted(range(120), key=lambda u: (draw(u), u))


def test_analysis_without_complete_rows(spark):
    df = spark.createDataFrame([(1, "s", 2.0, None, 1.0), (2, "s", None, 3.0, 1.0)], "u long, s string, z double, x double, y double")
    r = analysis.analyzed(df, "u", "s", "z", ["x"], ["y"], 3, 3, ("x", "y"), most=None).collect()
    assert [(x.n_total, x.n_complete, x.n_missing, x.raw_rho, x.partial_two_p, x.rejected, x.category) for x in r] == [(2, 0, 2, None, None, False, "technical_no_go_inconclusive_association")]


def test_weights_of_resamples_stand_for_copies_of_rows(spark, monkeypatch):
    """Correlations under weights equal those of rows written out, over many cells; resamples add no rows to those that are ranked."""
    monkeypatch.setattr(resampled, "CELL", 4)
    rng, width = np.random.default_rng(5), 4
    rows = []
    for g, n in (("a", 400), ("b", 3), ("c", 40)):
        for i in range(n):
            w = rng.poisson(1.0, width).astype(int).tolist()
            rows.append((g, "o", float(rng.normal()), float(rng.integers(3)), 1.0 if g == "c" else float(rng.integers(30)), [1, *w[1:-1], 0 if g == "b" else w[-1]]))
    df = spark.createDataFrame(rows, "metric string, outcome string, x double, y double, z double, w array<int>")
    found = {(r.metric, r.k): r for r in resampled.weighted_correlations(df, ["metric", "outcome"], width).collect()}
    copies = df.select("metric", "x", "y", "z", F.posexplode("w").alias("k", "times")).filter("times > 0").withColumn("_", F.explode(F.expr("sequence(1, times)"))).drop("_", "times")
    want = {(r.metric, r.k): r for r in analysis.correlations(copies, ["metric", "k"]).collect()}
    assert len(found) == 3 * width and found.keys() >= want.keys()
    for key, r in found.items():
        if key not in want:
            assert (r.n, r.raw, r.partial) == (0, None, None)
            continue
        assert r.n == want[key].n
        assert all(a is None and b is None or abs(a - b) < 1e-9 for a, b in ((r.raw, want[key].raw), (r.partial, want[key].partial)))
    records = spark.range(60).select(F.lit("m").alias("metric"), F.lit("o").alias("outcome"), F.col("id").alias("unit"), (F.col("id") % 3).alias("stratum"), *[F.rand(i).alias(c) for i, c in enumerate("xyz")])
    for drawn in (analysis.bootstrap_weights(records, 7), analysis.whole_bootstrap_weights(records, 7)):
        assert drawn.count() == 60 and all(len(r.w) == 7 for r in drawn.collect())
    assert [sum(r.w[k] for r in analysis.bootstrap_weights(records, 7).collect()) for k in range(7)] == [60] * 7
