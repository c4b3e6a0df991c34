"""Golden values of text, similarity, rank and probability functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import java, probability, ranks, similarity, text
from spindrift.operators import merkle, numbering, resampling
from spindrift.sources import store


def one(spark, **columns):
    """A row's values for expressions over literals."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def arr(items):
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def test_tokens_words_lines(spark):
    r = one(spark, t=text.tokens(F.lit('if (a >= 1.5) return "x \\" y"; // TODO')), w=text.word_count(F.lit("don't stop re-use 2x")), l=text.lines(F.lit("a\r\nb\n\nc\n")), e=text.lines(F.lit("")))
    assert r.t == ["if", "(", "a", ">=", "1.5", ")", "return", '"x \\" y"', ";", "/", "/", "TODO"]
    assert r.w == 4 and r.l == ["a", "b", "", "c"] and r.e == []


def test_static_features(spark):
    code = "if (x) { try { y(); } catch (Exception e) { } } } { // TODO 42"
    r = one(spark, n=text.nesting(text.tokens(F.lit(code))), c=text.branch_proxy(text.tokens(F.lit(code))), s=text.smells(F.lit(code), text.tokens(F.lit(code))))
    assert (r.n, r.c) == (2, 3)
    assert r.s == ["empty_catch", "generic_exception_catch", "magic_number", "todo_or_fixme"]


def test_diff_sides(spark):
    chunk = "@@ -1 +1 @@\n keep\n-old\n+new\n\\ No newline at end of file"
    r = one(spark, a=text.diff_old_side(F.lit(chunk)), b=text.diff_new_side(F.lit(chunk)), c=text.added_side(F.lit("@@ x\n+a  \n-b\n c\n\n")))
    assert (r.a, r.b, r.c) == ("keep\nold", "keep\nnew", "a\nc")


@pytest.mark.parametrize(("reference", "candidate", "score"), [("a b c d", "a b c d", 1.0), ("a a b c", "a a a a", (1 / 96) ** 0.25), ("a b c d", "w x y z", 0.0), ("a b c d", "a b", math.exp(-1))])
def test_bleu(reference, candidate, score):
    assert similarity.bleu_of(reference.split(), candidate.split())["score"] == pytest.approx(score, abs=1e-12)


def test_bleu_precisions():
    r = similarity.bleu_of("a a b c".split(), "a a a a".split())
    assert r["matched"] == [2, 1, 0, 0] and r["precisions"] == [1 / 2, 1 / 3, 1 / 4, 1 / 4]


def test_rouge(spark):
    r = similarity.rouge_of(["a", "b", "c"], ["a", "b"])
    assert r == pytest.approx((1, 2 / 3, 0.8, 1, 0.5, 2 / 3, 1, 2 / 3, 0.8))
    r = similarity.rouge_of(['"a b"', "Foo", ";"], ['"a b"', "foo", ";"])
    assert (r[2], r[5], r[8]) == pytest.approx((2 / 3, 0, 2 / 3))
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b"]), ([], ["a"]), (None, ["a"])], "r array<string>, c array<string>")
    got = df.select(similarity.rouge("r", "c").alias("x"), similarity.bleu("r", "c").alias("b")).collect()
    assert got[0].x.rouge_1_f1 == pytest.approx(0.8) and got[1].x.rouge_1_f1 is None and got[2].b.score is None


def test_lcs_against_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = (rng.choices("abc", k=rng.randint(0, 12)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert similarity.lcs_length(a, b) == t[-1][-1]


def test_token_levenshtein(spark):
    left, right = "if ( x ) return x ;".split(), "if ( y ) return ;".split()
    r = one(spark, d=similarity.token_levenshtein(arr(left), arr(right)), s=similarity.string_similarity(arr(left), arr(right)), z=similarity.string_similarity(arr(["return"]), arr([])), n=similarity.string_similarity(arr([]), arr([])))
    assert r.d == 2 and r.s == pytest.approx(5 / 7) and r.z == 0 and r.n is None


def test_trees():
    t = lambda x: similarity._postorder(x)
    a, b = ("root", [("a", []), ("b", [("c", [])])]), ("root", [("a", []), ("b", [("d", [])])])
    assert similarity.tree_distance(t(a), t(b)) == 1
    assert similarity.tree_distance(t(a), t(("root", [("b", [("c", [])])]))) == 1
    assert similarity.tree_distance(t(("root", [("a", []), ("b", [])])), t(("root", [("b", []), ("a", [])]))) == 2
    assert similarity.tree_distance(t(a), t(a)) == 0


def test_tree_udf(spark):
    schema = "a struct<labels:array<string>,leftmost:array<int>>, b struct<labels:array<string>,leftmost:array<int>>"
    rows = [((["a", "c", "b", "r"], [0, 1, 1, 0]), (["a", "d", "b", "r"], [0, 1, 1, 0]))]
    got = spark.createDataFrame(rows, schema).select(similarity.tree_edit_distance("a", "b").alias("d"), similarity.tree_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert got.d == 1 and got.s == 7 / 8


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    r = one(spark, c=similarity.cosine(v(1.0, 1.0), v(2.0, 4.0)), z=similarity.cosine(v(0.0, 0.0), v(1.0, 1.0)), d=similarity.cosine(v(1.0), v(1.0, 2.0)))
    assert r.c == pytest.approx(6 / math.sqrt(40)) and r.z is None and r.d is None


def test_tiered(spark):
    none, x = F.lit(None).cast("double"), F.lit(0.5)
    r = one(spark, t=similarity.tiered(none, x, F.lit(0.1)), s=similarity.tiered(none, none, x))
    assert (r.t.selected_tier, r.t.score, r.t.reasons) == ("TRS", 0.5, ["grs_unavailable"])
    assert (r.s.selected_tier, r.s.reasons) == ("STS", ["grs_unavailable", "trs_unavailable"])


def test_published_p_value():
    assert probability.t_two_sided(0.028208637104580693, 49) == pytest.approx(0.8474279760811542, abs=1e-12)
    assert probability.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_spearman_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y, z = rng.integers(0, 6, 40), rng.integers(0, 5, 40), rng.integers(0, 7, 40)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(x, y, z, strict=True)], "x int, y int, z int")
    r = [resampling.ranks(v.astype(float))[0] for v in (x, y, z)]
    assert ranks.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(r[0], r[1])[0, 1])
    assert ranks.partial_spearman(df, "x", "y", "z").first().rho == pytest.approx(resampling.partial_statistic(x.astype(float), y.astype(float), [z.astype(float)]))
    assert ranks.spearman(df.withColumn("x", F.lit(1)), "x", "y").first().rho is None


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")
    got = {r["name"]: r.adjusted for r in ranks.holm(df, "name", "p").collect()}
    assert got == {"a": pytest.approx(0.04), "b": pytest.approx(0.09), "c": pytest.approx(0.09), "d": None}


def test_fisher_and_auc(spark):
    low, high = ranks.fisher_interval(F.lit(0.3), F.lit(50))
    r = one(spark, low=low, high=high, none=ranks.fisher_interval(F.lit(0.3), F.lit(3))[0])
    half = probability.Z975 / math.sqrt(47)
    assert (r.low, r.high) == pytest.approx((math.tanh(math.atanh(0.3) - half), math.tanh(math.atanh(0.3) + half))) and r.none is None
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (0, 1.0), (0, 2.0)], "l int, v double")
    assert ranks.auc(df, "l", "v").first().auc == pytest.approx(3.5 / 4)


JAVA = '''package a.b;
import java.util.List;
class A {
  int skip(int n) { return n; }
  /** Doc. */
  public static int f(final List<String> xs, int... n) throws Exception {
    // if (x)
    if (xs.size() > 1 && n.length > 0) { return 1; }
    for (String s : xs) { use("while (") ; }
    Runnable r = () -> { if (true) { } };
    return n[0] > 2 ? 1 : 0;
  }
}
'''


def test_java_facts():
    method = java.extract_method(JAVA, "a.b.A.f(List<String>,int[])")
    assert method.startswith("/** Doc. */") and method.endswith("}")
    facts = java.analyze(method[method.index("public") :])
    assert facts.failure_codes == [] and facts.cyclomatic == 1 + 4 and facts.ncloc == 6
    assert java.context(JAVA) == {"package": "a.b", "imports": ["java.util.List"]}
    assert java.extract_method(JAVA, "a.b.A.g()") is None
    assert "unbalanced_brackets" in java.analyze("int f() { ").failure_codes
    assert java.canonical_source("é\r\nx\r") == "é\nx\n"


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_quantiles_of_ranges_are_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(g, float(v)) for g, scale in (("a", 1.0), (None, 1e6), ("ties", 3.0)) for v in (rng.normal(size=n) * scale if g != "ties" else rng.integers(0, 3, n))] + [("a", None), ("a", float("nan")), ("empty", None)]
    got = {r.g: r[1:] for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", ["g"], [0.0, 0.025, 0.5, 0.9, 1.0]).collect()}
    for g in ("a", None, "ties"):
        own = [v for h, v in rows if h == g and v is not None and not np.isnan(v)]
        assert np.allclose(got[g], np.quantile(own, [0.0, 0.025, 0.5, 0.9, 1.0]), rtol=1e-12, atol=1e-12)
    assert "empty" not in got
    assert np.allclose(ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [], [0.25]).first().q0, np.quantile([v for _, v in rows if v is not None and not np.isnan(v)], 0.25))


def java_sources():
    rng = random.Random(21)
    parts = [
        "int f(int a) {", "void g() {", "A(B b) throws E, x.F<G> {", "}", "}", "{", "(", ")", "[", "]", "if (a > 1 && b || c) {", "for (;;) { x(); }", "while (f(1)) y++;", "switch (x) { case 1: case 2: break; }", "r = () -> {", "x -> { if (y) { } };",
        "return new Foo(1) { int h() { return 2; } };", "String s = \"a { \\\" ( // no\";", "char c = '\\'';", "// if ( {\n", "/* while {\n */", "\"\"\"\n text \\\"\"\"\" { \n\"\"\";", "\n", "\n\n", " \t", "x = a ? b : c;", "0x1F_L + 1.5e-3f", "$v", "_é²", "\"open", "'", "@Ann(1)",
        "do { } while (x);", "catch (E e) { }", ">>>= <<= -> :: ...", "a.b(c) {", "= f(x) {", "é(", ";",
    ]
    return ["", " ", "\n", "int f() { return 1; }", *["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]]


def test_java_expressions_equal_the_plain_version(spark):
    """Tokens, masks, code lines and facts of random sources, whole and broken."""
    sources = [java.canonical_source(s) for s in java_sources()]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string").repartition(4)
    s = F.col("s")
    got = df.select("i", java.tokens(s).alias("t"), java.masked(s).alias("m"), java.code_lines(s).alias("n"), java.facts(s).alias("f")).collect()
    assert len(got) == len(sources)
    kinds = set()
    for r in got:
        want = java.analyze(sources[r.i])
        assert list(r.t) == want.tokens, sources[r.i]
        assert r.m == java.mask(sources[r.i]) and r.n == want.ncloc
        assert (r.f.token_count, r.f.ncloc, r.f.cyclomatic, list(r.f.failure_codes)) == (len(want.tokens), want.ncloc, want.cyclomatic, want.failure_codes), sources[r.i]
        kinds |= {*want.failure_codes, want.cyclomatic > 2}
    assert kinds == {"empty_source", "unbalanced_brackets", "not_exactly_one_method", True, False}


@pytest.fixture
def shaky_cuts(monkeypatch):
    """Approximate quantiles that come a little differently each time they're computed, as on a cluster."""
    exact = F.percentile_approx
    moved = F.udf(lambda cuts: [c + random.uniform(-9, 9) for c in cuts], "array<double>").asNondeterministic()
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda *a: moved(exact(*a)))


def test_ranks_of_values_that_vary_when_computed_again(spark):
    """Sums of doubles differ in their last bits from one computation to the next; no row is lost for it."""
    again = F.udf(lambda i: round(i % 50 + random.random(), 4), "double").asNondeterministic()
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), again("id").alias("v"))
    out = ranks.with_ranks(rows, {"r": "v"}, ["g"]).collect()
    assert len(out) == 2000
    for g in (0, 1):
        values = sorted(x.v for x in out if x.g == g)
        assert all(x.r == (values.index(x.v) + 1 + values.index(x.v) + values.count(x.v)) / 2 for x in out if x.g == g)


def test_ranks_with_cuts_that_vary(spark, shaky_cuts):
    rows = spark.range(3000).select(F.col("id").cast("double").alias("v"))
    assert all(r.r == r.v + 1 for r in ranks.with_ranks(rows, {"r": "v"}).collect())


def test_ranks_of_frequent_and_odd_values(spark):
    """A value of most rows, NaN, negative zero and nulls in values and groups."""
    given = [5.0] * 700 + [float("nan")] * 5 + [-0.0, 0.0, -1.0] * 40 + [float(i) / 7 for i in range(300)]
    rows = spark.createDataFrame([(g, v) for g in (None, "a") for v in given] + [("a", None)], "g string, v double")
    out = ranks.with_ranks(rows, {"r": "v"}, ["g"]).collect()
    order = sorted(math.inf if math.isnan(v) else v for v in given)
    assert len(out) == 2 * len(given)
    for x in out:
        v = math.inf if math.isnan(x.v) else x.v
        assert x.r == order.index(v) + (order.count(v) + 1) / 2


def test_medians_with_cuts_that_vary(spark, shaky_cuts):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    assert {r.g: r.median for r in ranks.medians(rows, "v", ["g"]).collect()} == {0: 1498.5, 1: 1499.5, 2: 1500.5}


def test_quantiles_with_cuts_that_vary(spark, shaky_cuts):
    rows = spark.range(3001).select(F.col("id").cast("double").alias("v"))
    assert tuple(ranks.quantiles(rows, "v", [], [0.0, 0.25, 0.5, 1.0]).first()) == (0.0, 750.0, 1500.0, 3000.0)


def test_simple_upper(spark):
    """ß stays, and so doesn't put SCH into a text; the rest is upper case, null stays null."""
    given = ["Großchen enößch", "ßß", "ﬁsch ŉ", "ärger\nzwei", "", "a", "ß\ue000ı\ue005𐐨"]
    rows = spark.createDataFrame([(g,) for g in [*given, None]], "t string").select("t", text.simple_upper(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {g: "".join(c.upper() if len(c.upper()) == 1 else c for c in g) for g in given} | {None: None}


def test_row_numbers_write_rows_once(spark):
    """Numbers over all rows are added to the stored ranges: the rows aren't shuffled for them or written again."""
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("t"))
    made = store._MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    found = numbering.counted(rows, [], ["v"], "n")
    assert all(r.n == r.v for r in found.collect())
    assert sorted(p.rpartition("/")[2].split("-")[0] for p in made[before:]) == ["counts", "ranges"]
    assert [c for c in merkle.tree(rows, ["v"], "t")[0].columns] == ["at", "digest"]


def test_cells_of_ranks_are_found_by_halving(spark):
    """How many cuts lie below a value, for arrays of any length, repeated cuts, nulls and NaN; ranks interpret no lambda a row."""
    arrays = [[], [1.0], [1.0, 1.0, 2.0], [float(i) for i in range(63)], [0.5 * i for i in range(40)] + [float("nan")], None]
    values = [-1.0, 0.0, -0.0, 1.0, 1.5, 31.0, 62.0, 99.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(a, v) for a in arrays for v in values], "b array<double>, v double")
    for r in ranks._below(df, {"n": ("b", "v")}).collect():
        assert r.n == sum(b < r.v or (math.isnan(r.v) and not math.isnan(b)) for b in r.b or ()), r
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("double").alias("v"))
    assert "lambda" not in ranks.with_ranks(rows, {"r": "v"}, ["g"])._jdf.queryExecution().optimizedPlan().toString()


def test_auc_has_its_label_after_ranking(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (0, 2.0), (0, 1.0)], "label int, v double")
    r = ranks.auc(df, "label", "v").first()
    assert (r.n1, r.n0, r.auc) == (2, 2, 0.875)
