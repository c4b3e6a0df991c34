"""Study folders, write-once tables, the chained ledger and digest trees, with an error code for every rule."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from spindrift.operators import merkle
from spindrift.operators.cohort import CohortError
from spindrift.sources import published, study_files


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def write(root, name, body):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else body.encode())


def code_of(call):
    with pytest.raises(CohortError) as e:
        call()
    return e.value.code


def test_tree_of_files(spark, tmp_path):
    bodies = {"runs-a/u1/attempt-1/attempt.json": "{}", "runs-a/u1/attempt-2/attempt.json": "{}", "runs-a/u1/selected.json": '{"attempt": 2}', "runs-b/u1/attempt-1/attempt.json": "", "runs-b/_hidden": b"\xff\0", "top.txt": "t", "runs-c/other/x": "é"}
    for name, body in bodies.items():
        write(tmp_path, name, body)
    files = study_files.study_files(spark, str(tmp_path))
    assert {(r.path, r.bytes, r.sha256, bytes(r.content)) for r in files.collect()} == {(n, len(b if isinstance(b, bytes) else b.encode()), sha(b), b if isinstance(b, bytes) else b.encode()) for n, b in bodies.items()}
    assert {(r.run, r.unit, r.attempt, r.selected) for r in study_files.attempts(files).collect()} == {("runs-a", "u1", 1, 2), ("runs-a", "u1", 2, 2), ("runs-b", "u1", 1, None)}
    manifest = spark.createDataFrame([(n, len(b if isinstance(b, bytes) else b.encode()), sha(b)) for n, b in bodies.items()], "path string, bytes long, sha256 string")
    assert study_files.asserted(files, manifest, "tree").count() == 7
    for change, code in ((manifest.filter("path <> 'top.txt'"), "tree_unexpected"), (manifest.withColumn("bytes", F.lit(9)), "tree_size_mismatch"), (manifest.withColumn("sha256", F.lit("x")), "tree_hash_mismatch"), (manifest.unionByName(manifest.limit(1).withColumn("path", F.lit("gone"))), "tree_missing")):
        assert code_of(lambda c=change: study_files.asserted(files, c, "tree")) == code


def test_filters_on_runs_are_pushed(spark, tmp_path):
    for r in "abc":
        write(tmp_path, f"run-{r}/f", r)
    files = study_files.study_files(spark, str(tmp_path))
    assert [r.path for r in files.filter("run = 'run-b'").collect()] == ["run-b/f"]
    assert sorted(r.path for r in files.filter("run IN ('run-a', 'run-c', 'x') AND bytes = 1").collect()) == ["run-a/f", "run-c/f"]
    assert files.filter("startswith(run, 'run-c')").rdd.getNumPartitions() == 1
    assert files.filter("run = 'none'").count() == 0


def study(root, **changes):
    records = []
    for i in (1, 2, 3):
        code, context = f"class A{i} {{}}", json.dumps({"snippet_id": f"u-{i:03d}"})
        write(root, f"code/{i}.java", code)
        write(root, f"context/{i}.json", context)
        records.append({"snippet_id": f"u-{i:03d}", "snippet_path": f"code/{i}.java", "snippet_sha256": sha(code), "context_path": f"context/{i}.json", "context_sha256": sha(context), "system_name": "p", "dataset_LOC": i})
    records[1] |= changes
    write(root, "source_manifest.jsonl", "\n".join(map(json.dumps, records)) + "\n")


@pytest.mark.parametrize(
    ("changes", "code"),
    [
        ({}, None), ({"snippet_id": "u-001"}, "source_manifest_method_id"), ({"snippet_id": None}, "source_manifest_method_id"), ({"snippet_path": "code/9.java"}, "snippet_read_failed"), ({"snippet_sha256": "0"}, "snippet_hash_mismatch"),
        ({"context_path": "none"}, "context_read_failed"), ({"context_sha256": None}, "context_hash_mismatch"), ({"snippet_id": "u-009"}, "context_method_id_mismatch"), ({"system_name": ""}, "case_project_invalid"), ({"dataset_LOC": 0}, "case_loc_invalid"),
        ({"dataset_LOC": "many"}, "source_manifest_not_jsonl"),
    ],
)
def test_cases(spark, tmp_path, changes, code):
    study(tmp_path, **changes)
    files = study_files.study_files(spark, str(tmp_path))
    read = lambda: study_files.study_cases(files, expected=3, prefix="u-").collect()
    if code:
        assert code_of(read) == code
    else:
        assert [(r.unit, r.size, r.code) for r in sorted(read())] == [(f"u-{i:03d}", i, f"class A{i} {{}}") for i in (1, 2, 3)]
        assert code_of(lambda: study_files.study_cases(files, expected=4)) == "source_manifest_count_not_4"
        assert code_of(lambda: study_files.study_cases(files, expected=3, prefix="v-")) == "case_method_id_sequence"
        body = (tmp_path / "code/1.java").read_bytes()
        assert study_files.pinned(files, "code/1.java", len(body), sha(body), "outcome_file").count() == 1
        for args, what in ((("x", 1, ""), "missing"), (("code/1.java", 1, sha(body)), "size_mismatch"), (("code/1.java", len(body), "0"), "hash_mismatch")):
            assert code_of(lambda a=args: study_files.pinned(files, *a, "outcome_file")) == f"outcome_file_{what}"


def test_evaluations_are_numbered_in_file_order(spark, tmp_path):
    head = "participant_id,system_name,snippet_signature,developer_position,Cyclomatic complexity,LOC,PBU,AU,more"
    lines = [f'p{i},s{i % 3},"sig ""{i % 4}""\n",dev,1,{i},0,0.5,x' for i in range(40)]
    write(tmp_path, "o.csv", "﻿" + "\n".join([head, *lines]) + "\n")
    units = spark.createDataFrame([(f'sig "{i}"\n', f"m{i}") for i in range(4)], "signature string, unit string")
    read = lambda u=units, **k: study_files.study_evaluations(spark, str(tmp_path / "o.csv"), u, **k)
    rows = sorted(read(expected={"row": 40, "method": 4, "participant": 40, "project": 3}).collect(), key=lambda r: r.evaluation_index)
    assert [(r.evaluation_index, r.participant_id, r.method_id, r.loc) for r in rows] == [(i, f"p{i}", f"m{i % 4}", str(i)) for i in range(40)]
    assert code_of(lambda: read(expected={"participant": 41})) == "outcome_participant_count_mismatch"
    assert code_of(lambda: read(units.filter("unit <> 'm2'"))) == "outcome_signature_not_in_manifest"
    assert code_of(lambda: read(units.unionByName(units.limit(1)))) == "duplicate_signature"
    write(tmp_path, "o.csv", "\n".join([head, lines[0], lines[0]]))
    assert code_of(read) == "outcome_participant_method_duplicate" and read(repeats=True).count() == 2
    write(tmp_path, "o.csv", head.replace("AU", "UA") + "\n")
    assert code_of(read) == "outcome_columns_missing"


def test_writers_race_and_one_wins(spark, tmp_path):
    path, results = f"{tmp_path}/table", []

    def attempt(k):
        try:
            results.append((k, published.publish(spark.range(50).selectExpr("id", f"{k} AS who"), path)))
        except CohortError as e:
            results.append((k, e.code))

    threads = [threading.Thread(target=attempt, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [(k, d) for k, d in results if d != "artifact_already_exists"]
    assert len(won) == 1 and len(results) == 3
    rows = published.published(spark, path, won[0][1])
    assert {r.who for r in rows.collect()} == {won[0][0]} and rows.count() == 50
    assert [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("data-")] == [published.manifest_of(spark, path)["data"]]
    assert code_of(lambda: published.published(spark, path, "0" * 64)) == "artifact_hash_mismatch"
    same = published.publish(spark.range(50).selectExpr("id", f"{won[0][0]} AS who").orderBy(F.desc("id")).repartition(5), f"{tmp_path}/again")
    assert same == won[0][1]


def test_chained_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    record = published.freeze_record("a/manifest.json", "0" * 64, "someone", "2026-01-02T03:04:05Z")
    digests = [published.append_chained(spark.createDataFrame([record | {"reviewer": f"r{i}"}]), path) for i in range(3)]
    links = sorted(published.ledger(spark, path).collect(), key=lambda r: r.number)
    assert [r.sha256 for r in links] == digests and [r.before for r in links] == ["", *digests[:2]]
    assert published.broken_links(spark, path).count() == 0
    first = tmp_path / "ledger/links/000000000000.json"
    first.write_text(first.read_text().replace(links[0].content, "f" * 64))
    (first.parent / ".000000000000.json.crc").unlink(missing_ok=True)
    assert [(r.number, r.finding) for r in published.broken_links(spark, path).collect()] == [(0, "digest_mismatch")]
    first.unlink()
    assert [(r.number, r.finding) for r in published.broken_links(spark, path).collect()] == [(1, "predecessor_missing")]
    bad = [(("a", "0" * 63, "r", "2026-01-02T03:04:05Z"), "freeze_record_hash_invalid"), (("a", "0" * 64, " ", "2026-01-02T03:04:05Z"), "freeze_reviewer_invalid"), (("a", "0" * 64, "r", "now"), "freeze_timestamp_invalid"), (("../a", "0" * 64, "r", "2026-01-02T03:04:05Z"), "freeze_path_invalid")]
    for args, code in bad:
        assert code_of(lambda a=args: published.freeze_record(*a)) == code


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_digest_tree_equals_a_loop(spark, n):
    width = 8
    paths = [f"p/{i:05d}" for i in range(n)]
    random.Random(1).shuffle(paths)
    rows = spark.createDataFrame([(p, sha(p)) for p in paths], "path string, h string").repartition(5)
    levels = merkle.tree(rows, ["path"], "h", width)
    want = [sha(p) for p in sorted(paths)]
    while len(want) > 1:
        want = [sha("\n".join(want[i : i + width])) for i in range(0, len(want), width)]
    assert merkle.root(levels) == (want[0] if want else sha(""))
    if n > 2:
        claims = spark.createDataFrame([(0, sha(min(paths))), (5, sha(sorted(paths)[5])), (5, sha(sorted(paths)[6])), (699, sha(max(paths))), (700, sha("x")), (9999, sha("x"))], "at long, digest string")
        assert sorted((r.at, r.included) for r in merkle.inclusion(levels, claims, width).collect()) == [(0, True), (5, False), (5, True), (699, True), (700, False), (9999, False)]
