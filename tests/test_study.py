"""Assembly operators, gates, medians and stores on small tables."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from spindrift.functions import ranks, similarity, text
from spindrift.operators import audit, cohort, documents, paired, selection
from spindrift.sources import files, report, store
from spindrift.streaming import ledger


def test_gate_rows(spark):
    rows = [(45, 50, 0.30, 0.001, 0.05), (44, 50, 0.9, 0.9, 0.0), (50, 50, 0.29, 0.1, 0.01), (50, 50, 0.4, 0.0, 0.01), (50, 50, 0.4, 0.1, 0.06), (50, 50, None, 0.1, 0.01), (50, 50, 0.4, 0.1, float("nan"))]
    df = spark.createDataFrame(rows, "v int, t int, rho double, low double, p double")
    tell = lambda df: [tuple(r.g) for r in df.select(selection.gate(*(F.col(c) for c in df.columns)).alias("g")).collect()]
    go, no, few = ("GO", "empirical_gate_pass"), ("NO-GO", "empirical_fail_fast"), ("NO-GO", "technical_no_go_inconclusive_association")
    assert tell(df) == [go, few, no, no, no, no, no]
    for bad, code in (((45, 49, 0.3, 0.1, 0.0), "gate_total_methods_not_50"), ((51, 50, 0.3, 0.1, 0.0), "gate_invalid_valid_count"), ((45, 50, 0.3, 0.1, 1.5), "gate_invalid_p_value")):
        with pytest.raises(Exception, match=code):
            tell(spark.createDataFrame([bad], df.schema))


def test_medians(spark):
    rows = [("a", float(i % 7)) for i in range(100)] + [("b", 2.0), ("b", 5.0), (None, 1.0), ("c", None)] + [("d", math.sin(i)) for i in range(1001)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in ranks.medians(df, "v", ["g"], "m").collect()}
    assert got == {g: statistics.median([v for k, v in rows if k == g]) for g in ("a", "b", None, "d")}
    assert ranks.medians(df, "v", [], "m").collect()[0].m == statistics.median([v for _, v in rows if v is not None])
    assert ranks.medians(df.limit(0), "v", ["g"]).count() == 0
    told = {r.g: r["median"] for r in ranks.with_median(df.groupBy("g").count(), df, "v", ["g"]).collect()}
    assert told["c"] is None and told[None] == 1.0


def test_windows_of_one_large_group_are_linear(spark):
    df = spark.range(60_000).select(F.lit(1).alias("u"), "id", (F.col("id") % 1000 == 999).alias("answer"))
    got = cohort.next_event(df, "u", "id", ~F.col("answer"), F.col("answer")).agg(F.sum(F.col("next_at") - F.col("id")).alias("s"), F.count("next_at").alias("n")).collect()[0]
    assert (got.n, got.s) == (59_940, 60 * sum(range(1, 1000)))
    left, right = df.filter("id % 2 = 0").withColumn("id", F.col("id") + 1), df.filter("id % 2 = 1").withColumn("id", F.col("id") + 1)
    assert cohort.nearest_match(left, right, "u", "id", "id").agg(F.max("distance")).collect()[0][0] < 0.7


def test_stages_contents_and_records(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "k string, s int, v int")
    assert [tuple(r) for r in cohort.pivot_stages(df, "k", "s", "v", [0, 1]).collect()] == [("a", 1, 2)]
    with pytest.raises(cohort.CohortError, match="case_without_stage"):
        cohort.pivot_stages(df, "k", "s", "v", [0, 1], "case_without_stage")
    contents, rows = cohort.by_content(spark.createDataFrame([("x", "y"), ("y", "x"), (None, "x")], "l string, r string"), ["l", "r"])
    assert sorted(r.text for r in contents.collect()) == ["x", "y"] and rows.columns == ["l", "r", "l_sha256", "r_sha256"]
    good = spark.createDataFrame([("m", 1.0, 0.5, 3), ("n", None, 0.0, 4)], "m string, p double, o double, loc int")
    assert [r.m for r in cohort.complete_records(good, "m", "p", ["o"], "loc").collect()] == ["m"]
    for bad, code in ((good.unionAll(good), "duplicate_unit"), (good.withColumn("o", F.lit(2.0)), "outcome_out_of_range"), (good.withColumn("loc", F.lit(0)), "size_not_positive")):
        with pytest.raises(cohort.CohortError, match=code):
            cohort.complete_records(bad, "m", "p", ["o"], "loc")


def test_fixed_cohort_and_chain(spark):
    df = spark.createDataFrame([("m", 0, 1, {"a": True}), ("m", 1, 1, {"a": True}), ("n", 0, 1, {"a": True})], "m string, run int, attempt int, checks map<string,boolean>")
    ok = {"rows": 3, "runs": {0: 2, 1: 1}, "per_unit": {1: 1, 2: 1}}
    assert [(r.run, r.m) for r in selection.fixed_cohort(df, "m", "run", "attempt", "checks", **ok).collect()] == [(0, "m"), (0, "n"), (1, "m")]
    for k, bad, code in (("rows", 4, "cohort_row_count"), ("runs", {0: 3}, "cohort_run_counts"), ("per_unit", {1: 3}, "cohort_unit_distribution")):
        with pytest.raises(cohort.CohortError, match=code):
            selection.fixed_cohort(df, "m", "run", "attempt", "checks", **{**ok, k: bad})
    with pytest.raises(cohort.CohortError, match="cohort_cell_not_eligible"):
        selection.fixed_cohort(df.withColumn("attempt", F.lit(2)), "m", "run", "attempt", "checks")
    chain = lambda x: [(r.previous_digest, r.digest) for r in selection.hash_chain(spark.createDataFrame(x, "c string, a int, v string"), ["c"], "a", "v").orderBy("a").collect()]
    one, other = chain([("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z")]), chain([("c", 1, "X"), ("c", 2, "y"), ("c", 3, "z")])
    assert [p for p, _ in one] == [None, one[0][1], one[1][1]] and one[2][1] != other[2][1]  # the last digest binds the first attempt


def test_partial_of_several_controls(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    x[:, 1] += x[:, 2] + 0.5 * x[:, 3]
    x[:, 0] += x[:, 2] - x[:, 4]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    r = np.argsort(np.argsort(x, axis=0), axis=0).astype(float)
    for controls in (["c"], ["c", "d"], ["c", "d", "e"]):
        z = np.column_stack([np.ones(80), r[:, ["abcde".index(c) for c in controls]]])
        left = [r[:, k] - z @ np.linalg.lstsq(z, r[:, k], rcond=None)[0] for k in (0, 1)]
        assert ranks.partial_spearman_of(df, "a", "b", controls).collect()[0].rho == pytest.approx(np.corrcoef(*left)[0, 1])
    assert ranks.partial_spearman_of(df, "a", "b", []).collect()[0].rho == pytest.approx(ranks.spearman(df, "a", "b").collect()[0].rho)


def test_text_forms(spark):
    df = spark.createDataFrame([("ab\ncd\n\nx", 7, "https://github.com/a/b.git"), ("ab", 1, "https://bitbucket.example/a")], "s string, at int, repo string")
    got = df.select(text.line_column(F.col("s"), F.col("at")).alias("p"), text.source_web_url(F.col("repo"), F.lit("c0"), F.lit("p/A.java"), F.lit(3), F.lit(9)).alias("u")).collect()
    assert [tuple(r.p) for r in got] == [(4, 1), (1, 2)]
    assert [r.u for r in got] == ["https://github.com/a/b/blob/c0/p/A.java#L3-L9", "https://bitbucket.example/a/src/c0/p/A.java#lines-3:9"]
    values = spark.createDataFrame([(1.5,), (float("nan"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in values.select(text.json_safe(F.col("x"))).collect()] == [1.5, None, None, None]
    assert spark.range(1).select(ranks.displayed(F.lit(0.04), F.lit(0.55)), ranks.displayed(F.lit(0.05), F.lit(0.9)), ranks.displayed(F.lit(None).cast("double"), F.lit(0.9))).collect()[0][:] == (True, False, False)


def test_prompt_markers(spark):
    one = spark.createDataFrame([("a $1 {{X}}",)], "t string")
    assert one.select(audit.render_prompt("b {{X}} e", "X", F.col("t"))).collect()[0][0] == "b a $1 {{X}} e"
    for template in ("none", "{{X}} and {{X}}"):
        with pytest.raises(Exception, match="prompt_placeholder_count_not_one"):
            one.select(audit.render_prompt(template, "X", F.col("t"))).collect()


def test_long_payloads_and_many_tokens(spark):
    df = spark.createDataFrame([('{"a": "' + 'x\\"y' * 200_000 + '", "Key": 1}',)], "p string")
    assert df.select(documents.isolated(F.col("p"), F.lit("zzz"), ["key"]), documents.isolated(F.col("p"), F.lit("zzz"), ["y"])).collect()[0][:] == (False, True)
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(56_000)), lambda i: i.cast("string")).alias("l"), F.array(F.lit("56000"), F.lit("55999")).alias("r"))
    assert many.select(similarity.token_levenshtein(F.col("l"), F.col("r"))).collect()[0][0] == 55_999


def test_metrics_by_arm(spark):
    df = spark.createDataFrame([(1, 0.5, 0.25), (2, None, 1.0)], "k int, a double, b double")
    got = paired.long_metrics(df, ["k"], {"m": (F.col("a"), F.col("b")), "n": (F.col("b"), F.col("a") * 2)}).collect()
    assert sorted((r.k, r.metric, r.left, r.right) for r in got if r.k == 1) == [(1, "m", 0.5, 0.25), (1, "n", 0.25, 1.0)] and len(got) == 4


def test_report_and_materialize(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5), ("c&d", None)], "name string, value double")
    assert report.latex(df, "50 %") == "\\caption{50 \\%}\n\\begin{tabular}{lr}\n\\hline\nname & value \\\\\n\\hline\na\\_b & 1.5000 \\\\\nc\\&d & — \\\\\n\\hline\n\\end{tabular}\n"
    docs = spark.createDataFrame([(1, "x", "text é"), (2, "y", "")], "id int, kind string, body string")
    files.materialize(docs, f"{tmp_path}/m", "body", ["id"], ["id", "kind"])
    assert {(r.id, r.bytes) for r in spark.read.json(f"{tmp_path}/m/manifest").collect()} == {(1, 7), (2, 0)}
    assert spark.read.option("header", True).csv(f"{tmp_path}/m/index").columns == ["id", "kind"] and spark.read.json(f"{tmp_path}/m/records").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.materialize(docs, f"{tmp_path}/m", "body", ["id"], ["id", "kind"])


def test_store_can_be_cleared(spark):
    path = store.new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert store.unused(spark.createDataFrame([], "_a int, _A_ int"), "_a") == "_a__"
    assert spark.read.parquet(path).count() == 3 and store.clear(spark) >= 1 and store.clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_windows_leave_out_late_rows_in_append_mode(spark, tmp_path):
    at = lambda *hours: spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00", True) for h in hours], "t string, bad boolean").select(F.to_timestamp("t").alias("at"), "bad")
    for k, hours in enumerate(((1, 1, 2), (9,), (10,), (1, 3), (20,))):
        at(*hours).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("at timestamp, bad boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    rows = ledger.drained(ledger.window_rates(source, "at", F.col("bad"), "1 hour", "2 hours"), "append")
    # two batches after 9:30 all before 7:30 is late: neither the rows of the fourth file nor open windows come out
    assert sorted((r.w.start.hour, r.n) for r in rows.collect()) == [(1, 2), (2, 1), (9, 1), (10, 1)]
