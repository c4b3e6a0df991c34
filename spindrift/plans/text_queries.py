"""Token, line, n-gram, similarity and nested-document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import documents as docs_ops
from ..operators import numbering
from .tables import TURN_PAIRS_SQL, r6, table, turn_pairs

_Q = text.TOKEN_PATTERN.replace("'", "''")


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all({column}, '{_Q}')"


def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), text.word_count(F.col("text")).cast("long").alias("n_words"))


def static_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", text.tokens(F.col("text")).alias("t"))
    smells = text.smells(F.col("text"), F.col("t"))
    rows = rows.withColumn("smells", smells)
    smells = F.col("smells")
    return rows.select(
        "doc_id", F.size("t").cast("long").alias("token_count"), F.greatest(F.size(text.lines(F.col("text"))), F.lit(1)).cast("long").alias("line_count"),
        text.branch_proxy(F.col("t")).cast("long").alias("ccn"), text.nesting(F.col("t")).cast("long").alias("max_nesting"), F.size(smells).cast("long").alias("smell_count"), F.array_join(smells, ",").alias("smell_rules"),
    )


_FEATURES_SQL = f"""(SELECT doc_id, len(t) AS token_count, greatest(len(l), 1) AS line_count, 1 + len(list_filter(t, lambda x: x IN ('if','for','while','case','catch','&&','||','?'))) AS ccn,
  list_filter([CASE WHEN regexp_matches(text, '(?m)^\\s*//\\s*(?:if|for|while|return|throw|new|[A-Za-z_$][\\w$]*\\s*[=(]).*[;{{]') THEN 'commented_out_code' END,
   CASE WHEN regexp_matches(text, '(?s)catch\\s*\\([^)]*\\)\\s*\\{{\\s*\\}}') THEN 'empty_catch' END,
   CASE WHEN regexp_matches(text, 'catch\\s*\\(\\s*(?:Exception|Throwable)\\b') THEN 'generic_exception_catch' END,
   CASE WHEN len(t) >= 100 THEN 'long_fragment' END, CASE WHEN len(list_filter(l, lambda x: length(x) > 120)) > 0 THEN 'long_line' END,
   CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(?:[2-9]|[1-9][0-9]+)(?:\\.[0-9]+)?($|[^A-Za-z0-9_])') THEN 'magic_number' END,
   CASE WHEN contains(text, '.printStackTrace(') THEN 'print_stack_trace' END, CASE WHEN regexp_matches(text, '\\bSystem\\.(?:out|err)\\.print') THEN 'system_output' END,
   CASE WHEN regexp_matches(text, '\\bThread\\.sleep\\s*\\(') THEN 'thread_sleep' END, CASE WHEN regexp_matches(text, '(?i)\\b(?:TODO|FIXME)\\b') THEN 'todo_or_fixme' END], lambda x: x IS NOT NULL) AS s
  FROM (SELECT doc_id, text, {_tokens_sql('text')} AS t, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))"""


def smell_value_counts(spark, d):
    rows = table(spark, d, "documents").select(F.explode(text.smells(F.col("text"), text.tokens(F.col("text")))).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def token_ngram_counts(spark, d):
    """Counts of token bigrams over all benchmark items."""
    grams = text.ngrams(text.tokens(F.col("text")), 2)
    return table(spark, d, "benchmark").select(F.explode(grams).alias("g")).groupBy(F.array_join("g", " ").alias("bigram")).agg(F.count(F.lit(1)).alias("n"))


def bleu4_turn_pairs(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", similarity.bleu(text.tokens(F.col("reference")), text.tokens(F.col("candidate"))).alias("b"))
    return p.select("conv_id", "turn", r6("b.score").alias("bleu"), F.get("b.matched", F.lit(0)).alias("matched_1"), r6("b.brevity_penalty").alias("brevity_penalty"))


_BLEU_SQL = f"""
WITH p AS (SELECT conv_id, turn, {_tokens_sql('reference')} AS r, {_tokens_sql('candidate')} AS c FROM {TURN_PAIRS_SQL}),
o AS (SELECT *, unnest(range(1, least(4, len(c)) + 1)) AS n FROM p WHERE len(r) > 0 AND len(c) > 0),
cg AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, c[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(c) - n + 2)) AS i FROM o)) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, r[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM o)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(cg.k, rg.k)) AS hit FROM cg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
q AS (SELECT o.conv_id, o.turn, o.n, coalesce(m.hit, 0) AS hit, len(c) - o.n + 1 AS poss, len(c) AS lc, len(r) AS lr FROM o LEFT JOIN m USING (conv_id, turn, n)),
z AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS zeros FROM q),
s AS (SELECT conv_id, turn, max(CASE WHEN n = 1 THEN hit END) AS m1, exp(least(0.0, 1 - max(lr) / max(lc)::DOUBLE)) AS bp, avg(ln(CASE WHEN hit > 0 THEN hit / poss::DOUBLE ELSE 1.0 / (pow(2, zeros) * poss) END)) AS lp FROM z GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN m1 IS NULL THEN NULL WHEN m1 = 0 THEN 0.0 ELSE round(bp * exp(lp), 6) END AS bleu, CAST(m1 AS BIGINT) AS matched_1, round(bp, 6) AS brevity_penalty FROM p LEFT JOIN s USING (conv_id, turn)"""


def rouge_turn_pairs(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", similarity.rouge(text.tokens(F.col("reference")), text.tokens(F.col("candidate"))).alias("x"))
    return p.select("conv_id", "turn", r6("x.rouge_1_f1").alias("rouge_1"), r6("x.rouge_2_f1").alias("rouge_2"))


def rouge_l_turn_pairs(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", similarity.rouge(text.tokens(F.col("reference")), text.tokens(F.col("candidate"))).alias("x"))
    return p.select("conv_id", "turn", r6("x.rouge_l_precision").alias("precision"), r6("x.rouge_l_recall").alias("recall"), r6("x.rouge_l_f1").alias("f1"))


_ROUGE_SQL = f"""
WITH p AS (SELECT conv_id, turn, {_tokens_sql('reference')} AS r, {_tokens_sql('candidate')} AS c FROM {TURN_PAIRS_SQL}),
o AS (SELECT *, unnest([1, 2]) AS n FROM p WHERE len(r) > 0 AND len(c) > 0),
cg AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, c[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(c) - n + 2)) AS i FROM o)) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, r[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM o)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(cg.k, rg.k)) AS hit FROM cg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
f AS (SELECT o.conv_id, o.turn, o.n, coalesce(hit, 0) / greatest(len(c) - o.n + 1, 1)::DOUBLE AS pr, coalesce(hit, 0) / greatest(len(r) - o.n + 1, 1)::DOUBLE AS re FROM o LEFT JOIN m USING (conv_id, turn, n)),
w AS (SELECT conv_id, turn, max(CASE WHEN n = 1 THEN CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END END) AS a, max(CASE WHEN n = 2 THEN CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END END) AS b FROM f GROUP BY ALL)
SELECT p.conv_id, p.turn, round(a, 6) AS rouge_1, round(b, 6) AS rouge_2 FROM p LEFT JOIN w USING (conv_id, turn)"""


def token_levenshtein_pairs(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", text.tokens(F.col("reference")).alias("r"), text.tokens(F.col("candidate")).alias("c"))
    return p.select("conv_id", "turn", similarity.token_levenshtein(F.col("r"), F.col("c")).cast("long").alias("distance"), r6(similarity.string_similarity(F.col("r"), F.col("c"))).alias("sts"))


def length_ratio(spark, d):
    p = turn_pairs(spark, d)
    return p.select("conv_id", "turn", r6(F.try_divide(F.size(text.tokens(F.col("candidate"))), F.size(text.tokens(F.col("reference"))))).alias("ratio"))


def cosine_adjacent(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(following, "vec_id").select("vec_id", r6(similarity.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


def ngram_overlap_benchmark(spark, d):
    """Shared distinct token 4-grams of benchmark items and documents; grams are compared by 64-bit hashes.

    Only the grams that a benchmark item has too go on from a document.
    """

    def grams(name: str, key: str):
        def hashes(t):
            each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 4, F.lit(0))), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(4)]))
            return F.when(F.size(t) >= 4, each)

        return table(spark, d, name).select(key, F.explode(text.let(text.tokens(F.lower("text")), hashes)).alias("h"))  # tokens are taken once

    items = grams("benchmark", "item_id").distinct()
    hits = grams("documents", "doc_id").join(items.select("h").distinct(), "h", "left_semi").distinct()
    return hits.join(items, "h").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


def masked_tag_counts(spark, d):
    """Opening and closing tags per page, and those per line."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_count(h, F.lit("<[a-zA-Z]")).cast("long").alias("opening"), F.regexp_count(h, F.lit("</[a-zA-Z]")).cast("long").alias("closing"), F.size(F.array_distinct(F.regexp_extract_all(h, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))).cast("long").alias("kinds"))


_CHUNK = "concat('@@ -1,2 +1,2 @@', chr(10), ' kept ', source, chr(10), '-old ', lang, chr(10), '+new ', source, ' ', lang)"


def diff_sides(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_CHUNK).alias("chunk"))
    return rows.select("doc_id", text.diff_old_side(F.col("chunk")).alias("before"), text.diff_new_side(F.col("chunk")).alias("after"), text.added_side(F.col("chunk")).alias("added"))


def intent_metrics(spark, d):
    """Turns of a conversation as reference intents, those of the assistant as code intents; status by role."""
    role = F.col("role")
    status = F.when(role == "assistant", "preserved").when(role == "user", "changed").otherwise("lost")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(status).alias("s"), F.array_compact(F.collect_list(F.when(role == "assistant", F.col("text")))).alias("c"), F.array_compact(F.collect_list(F.when((role == "assistant") & (F.col("turn") % 4 == 3), F.col("turn")))).alias("a"))
    m = docs_ops.intent_metrics(F.col("s"), F.col("c"), F.col("a"))
    return rows.select("conv_id", m.alias("m")).select("conv_id", F.col("m.reference_intent_count").cast("long").alias("refs"), F.col("m.added_count").cast("long").alias("added"), r6("m.strict_preservation_rate").alias("strict"), r6("m.weighted_preservation_rate").alias("weighted"), r6("m.addition_rate").alias("addition_rate"), r6("m.intent_fidelity_f1").alias("f1"))


def direction_features(spark, d):
    """Turns as directions: each depends on the one before it, and on the first one from the third on."""
    name = lambda t: F.format_string("D%02d", t)
    deps = F.array_compact(F.array(F.when(F.col("turn") >= 2, name(F.lit(1))), F.when(F.col("turn") >= 1, name(F.col("turn").cast("int")))))
    deps = F.array_distinct(deps)
    one = F.struct(F.col("turn"), name((F.col("turn") + 1).cast("int")).alias("id"), F.col("text").alias("action"), F.array(F.col("role")).alias("conditions"), deps.alias("depends_on"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    f = docs_ops.direction_features(F.col("x"))
    return rows.select("conv_id", f.alias("f")).select(
        "conv_id", F.col("f.instruction_count").cast("long").alias("instructions"), F.col("f.action_word_count_total").alias("action_words"), F.col("f.condition_word_count_total").alias("condition_words"),
        F.col("f.dependency_edge_count").cast("long").alias("edges"), r6("f.dependency_edge_density").alias("edge_density"), F.col("f.dependency_max_depth").cast("long").alias("depth"), F.col("f.dependency_max_fan_out").cast("long").alias("fan_out"),
    )


def line_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.array_distinct("l")).cast("long").alias("distinct_lines"), F.coalesce(F.array_max(F.transform("l", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


def stable_order(spark, d):
    """Documents' stable keys and their place in each source by it."""
    rows = table(spark, d, "documents").select("doc_id", "source", text.stable_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"))
    return numbering.counted(rows, ["source"], ["key", "doc_id"], "before").select("doc_id", "source", "key", (F.col("before") + 1).alias("place"))


QUERIES = {f.__name__: f for f in (token_count, static_features, smell_value_counts, token_ngram_counts, bleu4_turn_pairs, rouge_turn_pairs, rouge_l_turn_pairs, token_levenshtein_pairs, length_ratio, cosine_adjacent, ngram_overlap_benchmark, masked_tag_counts, diff_sides, intent_metrics, direction_features, line_features, stable_order)}

_WORD_SQL = text.WORD_PATTERN.replace("\\u2019", "’").replace("'", "''")



def _table_sql(first: str, best: str, along: str, told: str) -> str:
    """A dynamic programme over both token lists, a row of its table at a time: ``best`` from above (v) and from above left (d), then ``along`` the row."""
    return f"""
WITH RECURSIVE p AS (SELECT conv_id, turn, {_tokens_sql('reference')} AS r, {_tokens_sql('candidate')} AS c FROM {TURN_PAIRS_SQL}),
rt AS (SELECT conv_id, turn, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS i FROM p), ct AS (SELECT conv_id, turn, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS j FROM p),
dp(conv_id, turn, i, j, v) AS (SELECT conv_id, turn, CAST(0 AS BIGINT), j, CAST({first} AS BIGINT) FROM (SELECT conv_id, turn, unnest(range(0, len(c) + 1)) AS j FROM p) UNION ALL
SELECT conv_id, turn, i + 1, j, CAST({along} AS BIGINT) FROM (SELECT *, CASE WHEN j = 0 THEN {first.replace("j", "i + 1")} ELSE {best} END AS best FROM (SELECT dp.*, lag(v) OVER (PARTITION BY dp.conv_id, dp.turn ORDER BY dp.j) AS d, coalesce(rt.t = ct.t, false) AS same
FROM dp JOIN rt ON rt.conv_id = dp.conv_id AND rt.turn = dp.turn AND rt.i = dp.i + 1 LEFT JOIN ct ON ct.conv_id = dp.conv_id AND ct.turn = dp.turn AND ct.j = dp.j)) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY j)),
x AS (SELECT conv_id, turn, v, len(r) AS nr, len(c) AS nc FROM dp JOIN p USING (conv_id, turn) WHERE i = len(r) AND j = len(c))
SELECT conv_id, turn, {told} FROM x"""


ORACLE_SQL = {
    "token_levenshtein_pairs": _table_sql("j", "least(v + 1, d + CASE WHEN same THEN 0 ELSE 1 END)", "min(best - j) OVER w + j", "v AS distance, CASE WHEN greatest(nr, nc) > 0 THEN round(1 - v / greatest(nr, nc)::DOUBLE, 6) END AS sts"),
    "rouge_l_turn_pairs": _table_sql(
        "0", "greatest(v, d + CASE WHEN same THEN 1 ELSE 0 END)", "max(best) OVER w",
        "CASE WHEN nr * nc > 0 THEN round(v / nc::DOUBLE, 6) END AS precision, CASE WHEN nr * nc > 0 THEN round(v / nr::DOUBLE, 6) END AS recall, CASE WHEN nr * nc > 0 THEN round(2 * v / (nr + nc)::DOUBLE, 6) END AS f1",
    ),
    "token_count": f"SELECT doc_id, len({_tokens_sql('text')}) AS n_tokens, len(regexp_extract_all(text, '{_WORD_SQL}')) AS n_words FROM documents",
    "static_features": f"""
WITH f AS {_FEATURES_SQL},
b AS (SELECT doc_id, i, CASE t[i] WHEN '{{' THEN 1 ELSE -1 END AS v FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter({_tokens_sql('text')}, lambda x: x IN ('{{', '}}')) AS t FROM documents))),
s AS (SELECT doc_id, i, sum(v) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM b),
m AS (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s),
n AS (SELECT doc_id, max(depth) AS deepest FROM m GROUP BY doc_id),
g AS (SELECT f.*, coalesce(deepest, 0) AS max_nesting FROM f LEFT JOIN n USING (doc_id))
SELECT doc_id, token_count, line_count, ccn, CAST(max_nesting AS BIGINT) AS max_nesting, len(s) + CASE WHEN max_nesting >= 5 THEN 1 ELSE 0 END AS smell_count,
  array_to_string(list_sort(CASE WHEN max_nesting >= 5 THEN list_append(s, 'deep_brace_nesting') ELSE s END), ',') AS smell_rules FROM g""",
    "smell_value_counts": f"SELECT rule, count(*) AS n FROM (SELECT unnest(s) AS rule FROM {_FEATURES_SQL}) GROUP BY rule",
    "token_ngram_counts": f"SELECT t[i] || ' ' || t[i + 1] AS bigram, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {_tokens_sql('text')} AS t FROM benchmark)) GROUP BY 1",
    "bleu4_turn_pairs": _BLEU_SQL,
    "rouge_turn_pairs": _ROUGE_SQL,
    "length_ratio": f"SELECT conv_id, turn, round(len({_tokens_sql('candidate')}) / nullif(len({_tokens_sql('reference')}), 0)::DOUBLE, 6) AS ratio FROM {TURN_PAIRS_SQL}",
    "cosine_adjacent": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "ngram_overlap_benchmark": f"""
WITH a AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS i FROM (SELECT doc_id, {_tokens_sql('lower(text)')} AS t FROM documents))),
b AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 2)) AS i FROM (SELECT item_id, {_tokens_sql('lower(text)')} AS t FROM benchmark)))
SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY ALL""",
    "masked_tag_counts": "SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS opening, len(regexp_extract_all(html, '</[a-zA-Z]')) AS closing, len(list_distinct(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS kinds FROM pages",
    "diff_sides": "SELECT doc_id, 'kept ' || source || chr(10) || 'old ' || lang AS before, 'kept ' || source || chr(10) || 'new ' || source || ' ' || lang AS after, 'kept ' || source || chr(10) || 'new ' || source || ' ' || lang AS added FROM documents",
    "intent_metrics": """
WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS kept, count(*) FILTER (role = 'user') AS changed, count(*) FILTER (role = 'assistant' AND turn % 4 = 3) AS added FROM conversations GROUP BY conv_id),
w AS (SELECT *, (kept + 0.5 * changed) / n AS weighted, CASE WHEN kept = 0 THEN 0.0 ELSE added / kept::DOUBLE END AS ar FROM c)
SELECT conv_id, n AS refs, added, round(kept / n::DOUBLE, 6) AS strict, round(weighted, 6) AS weighted, round(ar, 6) AS addition_rate, round(CASE WHEN weighted + 1 - ar = 0 THEN 0.0 ELSE 2 * weighted * (1 - ar) / (weighted + 1 - ar) END, 6) AS f1 FROM w""",
    "direction_features": f"""
WITH c AS (SELECT conv_id, count(*) AS n, sum(len(regexp_extract_all(text, '{_WORD_SQL}'))) AS aw, sum(len(regexp_extract_all(role, '{_WORD_SQL}'))) AS cw FROM conversations GROUP BY conv_id)
SELECT conv_id, n AS instructions, CAST(aw AS BIGINT) AS action_words, CAST(cw AS BIGINT) AS condition_words, CASE WHEN n >= 2 THEN 1 + (n - 2) * 2 ELSE 0 END AS edges,
  round(CASE WHEN n = 1 THEN 0.0 ELSE (1 + (n - 2) * 2) / (n * (n - 1) / 2.0) END, 6) AS edge_density, n - 1 AS depth, CASE WHEN n = 1 THEN 0 ELSE n - 1 END AS fan_out FROM c""",
    "line_features": """
WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)
SELECT doc_id, len(l) AS n_lines, len(list_distinct(l)) AS distinct_lines, coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS longest FROM l""",
    "stable_order": "SELECT doc_id, source, sha256(source || chr(31) || doc_id) AS key, row_number() OVER (PARTITION BY source ORDER BY sha256(source || chr(31) || doc_id)) AS place FROM documents",
}
