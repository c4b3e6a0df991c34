"""Operators on small tables: edge rules and golden values."""

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import aggregates, cohort, documents, matching, models, paired, resampling, selection
from spindrift.plans import cohort_queries
from spindrift.sources import digests, files, report
from spindrift.streaming import ledger


def test_unit_outcomes(spark):
    df = spark.createDataFrame([("m1", "p", 1 / 3, 1), ("m1", "p", 2 / 3, 0), ("m2", "p", 1.0, 1)], "m string, project string, au double, pbu int")
    got = {r.m: r for r in aggregates.unit_outcomes(df, "m", "au", "pbu", ("project",)).collect()}
    assert got["m1"].score_mean == pytest.approx(0.5) and got["m1"].score_sd == pytest.approx(math.sqrt(1 / 18)) and got["m2"].score_sd == 0
    with pytest.raises(Exception, match="project_varies_within_unit"):
        aggregates.unit_outcomes(df.withColumn("project", F.col("au").cast("string")), "m", "au", "pbu", ("project",)).collect()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert aggregates.descriptive(df, "v", ["g"]).count() == 0
    assert aggregates.missingness(df, "v", "g").count() in (0, 1)
    assert selection.first_valid(df, ["g"], "v", F.lit(True)).count() == 0


def test_selection(spark):
    rows = [("c", i, i >= 3) for i in range(1, 4)] + [("d", 1, True), ("d", 2, False), ("e", 1, False), ("e", 3, False)]
    df = spark.createDataFrame(rows, "cell string, attempt int, ok boolean")
    got = {r.cell: r.selected_attempt for r in selection.first_valid(df, ["cell"], "attempt", F.col("ok")).collect()}
    assert got == {"c": 3, "d": 1, "e": None}
    assert {r.cell: r.contiguous for r in selection.contiguous(df, ["cell"], "attempt").collect()} == {"c": True, "d": True, "e": False}
    assert [r.cell for r in selection.nothing_after_selection(df, ["cell"], "attempt", F.col("ok")).collect()] == ["d"]
    blocked = selection.blocked(df.withColumn("reason", F.lit(None).cast("string")), ["cell"], "attempt", F.col("ok"), "reason", 3, ["provenance"]).collect()
    assert [(r.cell, r.block_reason) for r in blocked] == [("e", "attempt_cap_exhausted")]


def test_eligibility(spark):
    good = dict.fromkeys(selection.CHECKS, True)
    df = spark.createDataFrame([(good,), ({**good, "extraction_contract_valid": False, "artifact_hashes_valid": False},), ({},)], "checks map<string,boolean>")
    got = selection.eligibility(df).collect()
    assert [r.eligible for r in got] == [True, False, False] and [r.terminal_success for r in got] == [True, False, False]
    assert got[1].rejection_codes == ["check_failed_extraction_contract_valid", "check_failed_terminal_success", "check_failed_artifact_hashes_valid"]
    assert (got[1].primary_check, got[1].failure_stage, got[1].failure_class) == ("artifact_hashes_valid", "artifact_hashes", "provenance")
    assert got[0].primary_check is None and got[2].primary_check == "cell_identity_valid"


def test_strict_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(cohort.CohortError) as e:
        cohort.strict_join(a, b, ["k"], "score_without_outcome")
    assert e.value.code == "score_without_outcome"


def test_matches(spark):
    df = spark.createDataFrame([("g", 1, 10.0, True), ("g", 2, 11.0, False), ("g", 3, 30.0, True), ("g", 4, 29.0, False), ("h", 5, 1.0, True)], "g string, k long, s double, p boolean")
    near = {r.unit: r.match for r in cohort.nearest_match(df.filter("p"), df.filter("NOT p"), "g", "s", "k").collect()}
    assert near == {1: 2, 3: 4}
    greedy = {r.unit: r.match for r in matching.match_without_replacement(df, "g", "p", "s", "k").collect()}
    assert greedy == {1: 2, 3: 4}


def test_revision(spark):
    schema = "path string, e struct<revised_code:struct<commit:string,changed_code:array<struct<header:string,chunk:string>>>>"
    row = ("x/A.java", (("c", [("diff a/x/A.java b/x/A.java", "@@\n-old\n+new"), ("diff b/y/B.java", "@@\n+other")]),))
    df = spark.createDataFrame([row, ("x/A.java", ((None, []),))], schema)
    got = df.select(cohort.same_file_revision(F.col("e"), F.col("path")).alias("n"), cohort.aligned_revision(F.col("e"), F.col("path")).alias("a")).collect()
    assert got[0].n == "new" and (got[0].a.before, got[0].a.after) == ("old", "new") and got[1].n is None


def test_manifest_and_trees(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("sub/b.txt", b"two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    before = spark.createDataFrame(files.snapshot_tree(spark, str(tmp_path)).collect())
    assert {r.path: r.bytes for r in before.collect()} == {"a.txt": 3, "sub/b.txt": 3}
    told = files.tree_digest(before).first()
    rows = sorted((r.path, json.dumps({"bytes": r.bytes, "path": r.path, "sha256": r.sha256}, separators=(",", ":"))) for r in before.collect())
    assert (told.files, told.bytes) == (2, 6) and told.sha256 == hashlib.sha256("\n".join(hashlib.sha256(j.encode()).hexdigest() for _, j in rows).encode()).hexdigest()
    (tmp_path / "a.txt").write_bytes(b"onE")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {(r.path, r.finding) for r in cohort.manifest_diff(before, files.snapshot_tree(spark, str(tmp_path))).collect()}
    assert got == {("a.txt", "hash_mismatch"), ("c.txt", "unexpected")}


def test_write_once(spark, tmp_path):
    df = spark.range(3)
    assert files.write_or_verify(df, str(tmp_path / "t")) == "written" and files.write_or_verify(df, str(tmp_path / "t")) == "verified"
    with pytest.raises(cohort.CohortError):
        files.write_or_verify(spark.range(4), str(tmp_path / "t"))


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("﻿participant,AU,other\np1,0.5,x\np2,,y\n", encoding="utf-8")
    rows = files.read_evaluations(spark, str(tmp_path / "e.csv"), ["participant", "AU"]).collect()
    assert [(r.participant, r.AU) for r in rows] == [("p1", "0.5"), ("p2", None)]
    with pytest.raises(cohort.CohortError):
        files.read_evaluations(spark, str(tmp_path / "e.csv"), ["PBU"])
    (tmp_path / "d.tsv").write_text("key\tv\na\t1\na\t2\nb\t3\n")
    assert {r.key: r.v for r in files.read_tsv(spark, str(tmp_path / "d.tsv"), "key").collect()} == {"a": "2", "b": "3"}


def test_secrets(spark):
    df = spark.createDataFrame([("p", "x\ny\nkey sk-abcdefghijklmnopqrstuv"), ("q", "clean")], "path string, text string")
    assert [(r.path, r.rule, r.line) for r in files.scan_secrets(df, "path", "text").collect()] == [("p", "provider_secret_literal", 3)]


def test_intents(spark):
    df = spark.createDataFrame([(["preserved", "changed", "lost"], ["a", "b"], [1]), (["lost"], [], [])], "s array<string>, c array<string>, a array<int>")
    got = [r.m for r in df.select(documents.intent_metrics(F.col("s"), F.col("c"), F.col("a")).alias("m")).collect()]
    assert got[0].strict_preservation_rate == pytest.approx(1 / 3) and got[0].weighted_preservation_rate == pytest.approx(0.5) and got[0].addition_rate == 0.5
    assert got[1].intent_fidelity_f1 == 0
    ok = df.select(documents.valid_judgment(F.col("s"), F.col("c"), F.col("a"), F.size("s")).alias("v")).collect()
    assert [r.v for r in ok] == [True, True]


def _doc(**change):
    d = [{"id": "D01", "action": "Read the input.", "conditions": ["if given"], "depends_on": []}, {"id": "D02", "action": "Write it.", "conditions": [], "depends_on": ["D01"]}]
    return json.dumps({"schema_version": documents.DIRECTIONS_VERSION, "directions": d} | change)


def test_directions(spark):
    bad = json.loads(_doc())
    bad["directions"][0]["depends_on"] = ["D02"]
    rows = spark.createDataFrame([(_doc(),), (_doc(directions=[]),), (json.dumps(bad),)], "r string")
    assert [r.e for r in rows.select(documents.direction_error(F.col("r")).alias("e")).collect()] == [None, "directions_count_out_of_range", "direction_dependency_not_prior"]
    schema = "schema_version string, directions array<struct<id:string,action:string,conditions:array<string>,depends_on:array<string>>>"
    f = spark.createDataFrame([(_doc(),)], "j string").select(documents.direction_features(F.from_json("j", schema)["directions"]).alias("f")).first().f
    assert (f.instruction_count, f.condition_density, f.dependency_edge_density, f.dependency_max_depth, f.dependency_max_fan_out) == (2, 0.5, 1.0, 1, 1)


def test_recovery():
    assert documents.recover_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert documents.recover_json('Sure: {"code": "x"}"}') == {"code": "x"}
    assert documents.recover_json("none") is None
    assert documents.canonical_json({"z": 1.25, "a": [1, None]}, newline=True) == '{"a":[1,null],"z":1.25}\n'


def test_isolated(spark):
    df = spark.createDataFrame([('{"steps": "x"}', "int f(){}"), ('{"Code_1": "y"}', "int f(){}"), ('{"s": "int f(){}"}', "int f(){}")], "p string, c string")
    assert [r.ok for r in df.select(documents.isolated(F.col("p"), F.col("c"), ["code_1"]).alias("ok")).collect()] == [True, False, False]


def test_freedman_lane_against_loop():
    rng = np.random.default_rng(1)
    x, y, z = rng.normal(size=10), rng.normal(size=10), rng.normal(size=10)
    groups = np.array(list("aaaaabbbbb"), dtype=object)
    got = resampling.freedman_lane(x, y, [z], groups, 127, 9921)
    m = resampling._projection([z], 10)
    residual = m @ resampling.ranks(y)[0]
    px, draw, hits = m @ resampling.ranks(x)[0], np.random.Generator(np.random.PCG64(9921)), 0
    observed = np.corrcoef(px, residual)[0, 1]
    for _ in range(127):
        p = residual.copy()
        for g in "ab":
            at = np.flatnonzero(groups == g)
            p[at] = residual[draw.permutation(at)]
        hits += abs(np.corrcoef(px, m @ p)[0, 1]) >= abs(observed) - 1e-12
    assert got["observed"] == pytest.approx(observed) and got["two_sided_p"] == pytest.approx((1 + hits) / 128)


def test_bootstrap_is_seeded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=20)
    y, g = x + rng.normal(size=20), np.array(["a"] * 10 + ["b"] * 10, dtype=object)
    a, b = (resampling.bootstrap(x, y, [], g, 200, 7) for _ in range(2))
    assert a == b and a["lower"] < a["upper"] and a["valid"] == 200
    assert resampling.bootstrap(x, y, [x * x], g, 50, 7, whole=True)["valid"] <= 50


def test_associations_do_not_depend_on_order(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"u": [f"m{i:02d}" for i in range(16)], "s": list("abcd") * 4, "loc": rng.integers(5, 50, 16), "y": rng.random(16), "m1": rng.random(16)})
    run = lambda df: resampling.associations(spark.createDataFrame(df), "u", "s", "loc", "y", ["m1"], 50, 50).collect()
    assert run(rows) == run(rows.sample(frac=1, random_state=1))
    assert run(rows.assign(m1=1.0))[0].raw_rho is None


def test_hc3_against_direct():
    rng = np.random.default_rng(4)
    x, s = rng.normal(size=30), rng.integers(2, 90, 30).astype(float)
    y = 0.3 * x + rng.normal(size=30)
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    d = np.column_stack([np.ones(30), z(x), z(np.log2(s))])
    inverse = np.linalg.inv(d.T @ d)
    beta = inverse @ d.T @ y
    h = np.diag(d @ inverse @ d.T)
    u = (y - d @ beta) / (1 - h)
    cov = inverse @ (d.T * u**2 @ d) @ inverse
    got = models.hc3(x, y, s)
    assert got["coefficient"] == pytest.approx(beta[1]) and got["error"] == pytest.approx(math.sqrt(cov[1, 1]))


def test_gee_by_sums_equals_the_small_version(spark):
    """Clusters of one to forty rows, and one with a third of all: coefficients, errors and correlation to 1e-9."""
    rng = np.random.default_rng(8)
    cluster = np.concatenate([np.repeat(np.arange(60), rng.integers(1, 40, 60)), np.full(500, 99)])
    n = len(cluster)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    lean = rng.normal(size=100)[cluster] * 0.4
    hits = rng.binomial(3, 1 / (1 + np.exp(-(x @ [0.2, -0.5, 0.3] + lean)))).astype(float)
    want = models.gee(x, hits, np.full(n, 3.0), cluster)
    rows = spark.createDataFrame([(f"c{c}", float(h / 3), *map(float, v)) for c, h, v in zip(cluster, hits, x, strict=True)], "cluster string, y double, x0 double, x1 double, x2 double").repartition(7)
    got = models.gee_by_sums(rows, 3)
    assert got["converged"] and want["converged"] and abs(got["correlation"] - want["correlation"]) < 1e-9
    assert np.abs(got["estimate"] - want["estimate"]).max() < 1e-9 and np.abs(got["error"] - want["error"]).max() < 1e-9
    assert np.abs(np.array(got["p"]) - want["p"]).max() < 1e-8


def test_gee_failures(spark):
    units = spark.createDataFrame([(u, float(u % 5), float(2 ** (u % 4))) for u in range(20)], "unit int, predictor double, size double")
    evaluations = lambda rows: spark.createDataFrame(rows, "participant string, grp string, unit int, hits int")
    failed = lambda rows, u=units: {r.model: r.failure for r in models.gee_sensitivity(evaluations(rows), u, 3).collect()}
    many = [(f"p{u % 6}", ["student", "professional", "other"][u % 3], u, u % 4) for u in range(20)]
    assert failed([("one", "student", u, u % 4) for u in range(20)])["base"] == "insufficient_participant_clusters"
    assert failed([(p, g, u, 2) for p, g, u, _ in many])["base"] == "constant_gee_outcome"
    assert failed([(p, "student" if u % 2 else "other", u, h) for p, g, u, h in many])["interaction"] == "singular_gee_design"
    assert failed(many, units.withColumn("predictor", F.lit(1.0))) == {"base": "undefined_zscore"}
    assert failed([(p, g, u, None) for p, g, u, _ in many]) == {"base": "undefined_zscore"}


def test_gee_solves_its_equations():
    rng = np.random.default_rng(6)
    cluster = np.repeat(np.arange(30), 4)
    x = rng.normal(size=120)
    p = 1 / (1 + np.exp(-(0.2 + 0.8 * x + np.repeat(rng.normal(size=30), 4) * 0.7)))
    r = models.gee(np.column_stack([np.ones(120), x]), rng.binomial(3, p).astype(float), np.full(120, 3.0), cluster)
    assert r["converged"] and 0 < r["correlation"] < 0.6 and abs(r["estimate"][1] - 0.8) < 3 * r["error"][1]


def test_wilcoxon(spark):
    assert paired.signed_rank_p(5, 15.0, 0.0, 0) == pytest.approx(2 / 32)
    assert paired.signed_rank_p(0, 0.0, 0.0, 4) == 1.0
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (0.0, 3.0), (5.0, 5.0)], "a double, b double")
    r = paired.wilcoxon(df, "a", "b").first()
    assert (r.n, r.zeros, r.w_plus) == (3, 1, 3.0)
    assert paired.wilcoxon(df.limit(0), "a", "b").first().p == 1.0


def test_icc_of_equal_runs(spark):
    df = spark.createDataFrame([(u, r, float(u)) for u in range(4) for r in range(3)], "u int, r int, v double")
    assert paired.icc_3_1(df, "u", "r", "v", [0, 1, 2]).first().icc == pytest.approx(1.0)


def test_participant_groups(spark):
    df = spark.createDataFrame([("Professional developer",), ("Ph.D. student",), ("Master's student",), ("Researcher",)], "l string")
    assert [r.g for r in df.select(models.participant_group(F.col("l")).alias("g")).collect()] == ["professional", "student", "student", "other"]


def test_report(spark):
    assert report.bold_max([0.1, 0.2]) == ["0.1000", "**0.2000**"] and report.bold_max([0.2, 0.2]) == ["0.2000", "0.2000"]
    assert report.p_value(0.0001) == "<0.001" and report.tex("a_b") == r"a\_b"
    assert report.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |\n"


def test_decided_cells_stream(spark, tmp_path):
    """Attempts that come late, repeated and out of order, batch by batch; each cell is told once."""
    schema = "cell string, attempt long, valid boolean, at timestamp"
    batches = [
        [("late", 2, True, 10), ("plain", 1, True, 10), ("blocked", 3, False, 10), ("blocked", 1, False, 11), ("twice", 1, True, 10), ("twice", 1, False, 11), ("open", 2, True, 10), ("unknown", 1, None, 10)],
        [("late", 1, False, 20), ("plain", 2, True, 21), ("plain", 1, False, 22), ("blocked", 2, False, 20), ("twice", 2, True, 23), ("unknown", 2, True, 20), (None, 1, True, 20)],
        [("far", 1, True, 5000)], [("farther", 1, True, 9000)],
    ]
    told: dict = {}
    for timed in (False, True):
        folder = tmp_path / f"in{timed}"
        for i, rows in enumerate(batches):
            spark.createDataFrame([(c, a, v, s) for c, a, v, s in rows], "cell string, attempt long, valid boolean, s long").select("cell", "attempt", "valid", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(str(folder / f"b{i}"))
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        extra = {"at": "at", "wait_ms": 1_000_000} if timed else {}
        rows = ledger.drained(ledger.decided_cells(s, "cell", "attempt", "valid", 3, **extra), "append").collect()
        assert len({r.cell for r in rows}) == len(rows)
        told[timed] = {r.cell: (r.status, r.selected_attempt) for r in rows}
    want = {"late": ("selected", 2), "plain": ("selected", 1), "blocked": ("blocked", None), "twice": ("selected", 2), "unknown": ("selected", 2), None: ("selected", 1), "far": ("selected", 1), "farther": ("selected", 1)}
    assert told[False] == want
    assert told[True] == want | {"open": ("expired", None)}


def test_file_snapshot_query(spark, tmp_path):
    contents = {"region.parquet": b"r" * 10, "documents.parquet/part-0.parquet": b"\0\xff" * 5000, "deep/er/empty.txt": b"", "notes.md": "é".encode()}
    for name, raw in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = cohort_queries.file_snapshot(spark, str(tmp_path)).collect()
    assert {(r.path, r.bytes, r.sha256) for r in rows} == {(name, len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in contents.items()} and len(rows) == len(contents)


def test_long_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 100)
    monkeypatch.setattr(digests, "RANGE_BYTES", 1000)
    sizes = {"whole": 100, "a b%20c.bin": 101, "é/x#?.bin": 999, "é/even": 1000, "over": 1001, "long": 64 * 41 + 5, "left/out": 3000, "none": 0}
    contents = {name: bytes((i * i + n) % 251 for i in range(n)) for name, n in sizes.items()}
    for name, raw in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    want = {(name, len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in contents.items()}
    rows = [tuple(r) for r in cohort_queries.file_snapshot(spark, str(tmp_path)).collect()]
    assert set(rows) == want and len(rows) == len(want)
    rows = [tuple(r) for r in files.snapshot_tree(spark, str(tmp_path), exclude="^(left/|none)").collect()]
    assert set(rows) == {w for w in want if w[0] not in ("left/out", "none")} and len(rows) == len(want) - 2
    spark.conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    rows = files.snapshot_tree(spark, "viewfs://store/in").collect()
    assert {(r.bytes, r.sha256) for r in rows} == {w[1:] for w in want} and len(rows) == len(want)


def test_snapshot_of_a_file_beyond_2_gib(spark, tmp_path):
    """More than Spark reads as one value."""
    with (tmp_path / "zeros").open("wb") as f:
        f.truncate(2**31 + 5)
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2048):
        digest.update(block)
    digest.update(bytes(5))
    assert [tuple(r) for r in files.snapshot_tree(spark, str(tmp_path)).collect()] == [("zeros", 2**31 + 5, digest.hexdigest())]


@pytest.mark.parametrize("native", [True, False])
def test_digest_handed_on(monkeypatch, native):
    """A task reads its own range only, in windows; without OpenSSL's functions one task reads the file."""
    if not native:
        monkeypatch.setattr(digests, "_openssl", lambda: None)
    elif digests._openssl() is None:
        pytest.skip("hashlib has no OpenSSL here")
    monkeypatch.setattr(digests, "WINDOW", 70)
    raw, reads = bytes(i % 253 for i in range(1003)), []

    class Source:
        def read_at(self, n, at):
            reads.append((at, n))
            return raw[at : at + n]

    at, state, told, tasks = 0, b"", None, 0
    while told is None:
        del reads[:]
        begin, stop = at, min(len(raw), at + 150)
        at, state, told = digests.advance(Source(), "p", len(raw), at, stop, state)
        tasks += 1
        assert max(n for _, n in reads) <= 70
        assert not native or (reads[0][0] == begin and at == stop and sum(n for _, n in reads) == stop - begin)
    assert told == hashlib.sha256(raw).hexdigest() and tasks == (7 if native else 1)
    with pytest.raises(cohort.CohortError, match="file_changed:p"):
        digests.advance(Source(), "p", 1100, 0, 1100, b"")


def test_decisions_stream(spark, tmp_path):
    """Native state decides as the processor does: the first telling of a cell counts, whatever comes after."""
    schema = "cell string, attempt long, valid boolean"
    batches = [
        [("late", 2, True), ("plain", 1, True), ("blocked", 3, False), ("blocked", 1, False), ("twice", 1, True), ("twice", 1, False), ("open", 2, True), ("unknown", 1, None), ("none", None, True), ("beyond", 4, True)],
        [("late", 1, False), ("plain", 2, True), ("plain", 1, False), ("blocked", 2, False), ("twice", 2, True), ("unknown", 2, True), (None, 1, True)],
        [("blocked", 1, True), ("plain", 1, False), ("late", 3, False)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    for plain in (False, True):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
        found = ledger.drained(ledger.decided_cells(s, "cell", "attempt", "valid", 3), "append") if plain else ledger.drained(ledger.decisions(s, "cell", "attempt", "valid", 3), "update", "cell")
        rows = found.collect()
        told = {r.cell: (r.status, r.selected_attempt) for r in rows}
        assert len(rows) == len(told)
        assert told == {"late": ("selected", 2), "plain": ("selected", 1), "blocked": ("blocked", None), "twice": ("selected", 2), "unknown": ("selected", 2), None: ("selected", 1)}


def test_icc_by_one_shuffle_of_cells(spark):
    """Units without a value in every run are left out, repeated cells are averaged; rows are read and shuffled by unit once."""
    values = {"a": [1.0, 2.0, 4.0], "b": [3.0, 3.5, 5.0], "c": [2.0, 5.0, 5.5], "d": [6.0, 7.0, 9.0]}
    cells = [(u, r + 1, v + e) for u, vs in values.items() for r, v in enumerate(vs) for e in (-0.5, 0.5)] + [("e", 1, 9.0), ("a", 4, 99.0), ("f", 1, None), ("f", 2, 1.0), ("f", 3, 1.0)]
    found = paired.icc_3_1(spark.createDataFrame(cells, "u string, r int, v double"), "u", "r", "v", [1, 2, 3])
    m = np.array(list(values.values()))
    rows, columns = m.mean(1, keepdims=True) - m.mean(), m.mean(0, keepdims=True) - m.mean()
    msr, mse = 3 * (rows**2).sum() / 3, ((m - m.mean() - rows - columns) ** 2).sum() / 6
    r = found.first()
    assert (r.n, r.k) == (4, 3) and abs(r.icc - (msr - mse) / (msr + 2 * mse)) < 1e-12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
