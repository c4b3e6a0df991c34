"""Replicates that tasks make themselves against those that are dealt out as rows, and how many the analyses make."""

import hashlib
from pathlib import Path

import numpy as np
import pytest

from spindrift.operators import analysis, replicates
from spindrift.plans import registry

SF = "/root/testdata/sf0.01"


def test_draws_of_a_task_are_those_of_the_hash():
    """Messages of any length, among them those of several blocks, and replicates of different numbers of digits."""
    after = [b"", *[f"|{i}".encode() for i in range(0, 2000, 7)], b"|" + b"x" * 60, "|caf\u00e9".encode()]
    for before in (b"perm|20260812|", b"boot|" + b"s" * 45, b"boot|" + b"s" * 70):
        got = replicates.Draws(before, after).of(range(8, 103))
        want = [[int(hashlib.md5(before + str(r).encode() + a).hexdigest()[:8], 16) for a in after] for r in range(8, 103)]
        assert got.tolist() == want


def test_replicates_made_in_tasks_equal_those_dealt_out(spark, monkeypatch):
    """Correlations of resamples and sums of permutations, with strata and units without a name, and pairs of a part of the units; rounds go on where the last ended."""
    rng, rows = np.random.default_rng(11), []
    for metric in ("a", "b"):
        for i in range(90):
            if metric == "a" or i % 3:
                rows.append((metric, "o", None if i == 8 else f"u{i * 37 % 101}", [None, "s", "t"][i % 3 if i < 80 else 1], float(rng.normal()), float(rng.integers(4)), float(rng.integers(30))))
    records = spark.createDataFrame(rows, "metric string, outcome string, unit string, stratum string, x double, y double, z double")

    def found():
        drawn = [analysis.resampled_correlations(records, 60, whole).orderBy("metric", "k").collect() for whole in (False, True)]
        return drawn, analysis.permutation_tests(records, 60).orderBy("metric").collect()

    near = lambda a, b: len(a) == len(b) and all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
    (inside, whole), tests = found()
    assert len(inside) == len(whole) == 120 and len({r.raw for r in inside}) == 120
    monkeypatch.setattr(replicates, "MOST", 70)  # some strata and pairs are dealt out, others not
    monkeypatch.setattr(analysis, "ROUND", 45)
    (inside_, whole_), tests_ = found()
    assert near(inside, inside_) and near(whole, whole_) and near(tests, tests_)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["resampled_analysis", "score_and_analyze"])
def test_primary_analyses_make_all_replicates(spark, name):
    """10,000 resamples and 100,000 permutations, as in the reference; with 30 no adjusted p-value of two could be under 0.05."""
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == 4 and all(9_500 < r[c] <= 10_000 for r in rows for c in ("raw_valid", "partial_valid"))  # some of 38 conversations are undefined
    p = [r[c] for r in rows for c in ("raw_one_p", "raw_two_p", "partial_one_p", "partial_two_p")]
    assert all(abs(x * 100_001 - round(x * 100_001)) < 0.06 for x in p) and any(abs(x * 31 - round(x * 31)) > 0.01 for x in p)
    assert "range(100000)" in registry.ORACLE_SQL[name] and "range(10000)" in registry.ORACLE_SQL[name]
