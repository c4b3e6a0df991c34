"""Review events, trees and Java sources made of the driver's tables: the operators that a study applies to single cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, similarity
from ..operators import audit, cohort
from .tables import r6, table


def review_cases(spark, d):
    """Conversations as review timelines: the one review with the id asked for, its revision of the file, and why a case is left out."""
    chunk = F.concat(F.lit("@@ -1 +1 @@\n-old "), "role", F.lit("\n+new "), F.col("turn").cast("string"), F.when(F.col("turn") % 4 == 2, "").otherwise(F.lit("\n kept")))
    header = F.when(F.col("turn") % 3 == 1, "diff a/x/A.java b/x/A.java").otherwise("diff a/y/B.java b/y/B.java")
    code = F.struct(F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, "c0ffee").alias("commit"), F.array(F.struct(header.alias("header"), chunk.alias("chunk")), F.struct(F.lit("diff a/x/A.java b/x/A.java").alias("header"), F.concat(F.lit("@@\n-"), "role").alias("chunk"))).alias("changed_code"))
    event = F.struct("turn", F.when(F.col("role") == "user", "inlineReview").otherwise("commit").alias("type"), F.concat(F.lit("r"), (F.col("turn") % 4).cast("string")).alias("id"), code.alias("revised_code"))
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("t"))  # a conversation's few turns
    asked = convs.withColumn("e", cohort.review_event(F.col("t"), F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string"))))
    path = F.lit("x/A.java")
    rows = asked.withColumn("revision", cohort.same_file_revision(F.col("e"), path)).withColumn("pair", cohort.aligned_revision(F.col("e"), path))
    request = F.when(F.col("conv_id") % 7 == 0, " ").otherwise("please")
    reason = cohort.exclusion_reason(F.col("revision"), F.col("e.revised_code.commit").isNotNull(), request)
    return rows.select("conv_id", F.col("e.turn").cast("long").alias("turn"), "revision", F.col("pair.before").alias("before"), F.col("pair.after").alias("after"), reason.alias("reason"))


def tree_distances(spark, d):
    """Conversations as trees of their turns' roles, each against the next one: edit distance, similarity, and the tier that is used."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))  # a conversation's few turns
    tree = F.struct(F.concat("r", F.array(F.lit("conversation"))).alias("labels"), F.concat(F.transform("r", lambda x, i: i), F.array(F.lit(0))).alias("leftmost"))
    trees = turns.select("conv_id", tree.alias("t"))
    pairs = trees.join(trees.select((F.col("conv_id") - 1).alias("conv_id"), F.col("t").alias("u")), "conv_id")
    known = F.when(F.col("conv_id") % 4 != 0, similarity.tree_similarity(F.col("t"), F.col("u")))
    tier = similarity.tiered(F.lit(None).cast("double"), known, F.when(F.col("conv_id") % 8 != 0, F.lit(0.5)))
    return pairs.select("conv_id", similarity.tree_edit_distance("t", "u").alias("distance"), r6(tier["score"]).alias("score"), tier["selected_tier"].alias("tier"), F.array_join(tier["reasons"], ",").alias("reasons"))


def _source(name: str):
    """A class with two methods of one name: the first line of the text in a comment, the source in a string, braces as deep as the number asks for."""
    n, braces = F.col("n_chars"), (F.col("n_chars") % 4).cast("int")
    return F.concat(
        F.lit("package a.b;\r\nimport java.util.List;\nimport static c.D.*;\nclass A {\n  /** Doc of "), "source", F.lit(" {\n   */\n  int "), F.lit(name), F.lit("(List<String> a, int... b) {\n    String s = \"}"), "source", F.lit("\\\"{\"; // } "), "lang", F.lit("\n"),
        F.repeat(F.lit("    { if (a != null) { b[0]++; } "), braces), F.repeat(F.lit("}"), braces), F.lit("\n    char c = '{'; return "), n.cast("string"), F.lit(";\n  }\n  int "), F.lit(name), F.lit("(int a) { return a; }\n}\n"),
    )


def extracted_methods(spark, d):
    """The method that a signature names, with its comment, out of a class with overloads; none where the signature fits none."""
    rows = table(spark, d, "documents").select("doc_id", _source("work").alias("source"), F.when(F.col("doc_id") % 3 == 0, "a.b.A.work(List<String>,int[])").when(F.col("doc_id") % 3 == 1, "A.work(int)").otherwise("A.work(long)").alias("signature"))
    found = rows.select("doc_id", java.extracted_method("source", "signature").alias("m"), java.source_context("source").alias("c"), F.length(F.regexp_replace(java.masked_source("source"), "[ \r\n]", "")).alias("n_outside"))
    return found.select("doc_id", F.sha2("m", 256).alias("method_sha256"), F.col("c.package").alias("package"), F.array_join("c.imports", ",").alias("imports"), F.col("n_outside").cast("long").alias("n_outside"))


def nested_json(spark, d):
    """Keys at any depth of events' properties beside their types, and the fullest object with the id asked for."""
    inner = lambda k, more: F.concat(F.lit('{"id": "'), F.lit(k), F.lit('", "path": "p", "diffHunk": "'), "event_type", F.lit('"'), more, F.lit("}"))
    doc = F.concat(F.lit('{"a": ['), inner("x", F.lit("")), F.lit(", "), inner("x", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(', "user": '), F.col("user_id").cast("string"))).otherwise(F.lit(""))), F.lit('], "props": '), "props", F.lit("}"))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "{").otherwise(doc).alias("doc"), F.when(F.col("event_id") % 5 == 0, "y").otherwise("x").alias("k"))
    return rows.select("event_id", F.array_join(audit.json_keys("doc"), ",").alias("keys"), audit.find_object("doc", "k").alias("found"))


QUERIES = {f.__name__: f for f in (review_cases, tree_distances, extracted_methods, nested_json)}

_JAVA = (
    "'package a.b;' || chr(13) || chr(10) || 'import java.util.List;' || chr(10) || 'import static c.D.*;' || chr(10) || 'class A {' || chr(10) || '  ' || {doc} || chr(10) || '  ' || {first} || chr(10) || '  ' || {second} || chr(10) || '}' || chr(10)"
)
_DOC = "'/** Doc of ' || source || ' {' || chr(10) || '   */'"
_BODY = "'int work(List<String> a, int... b) {' || chr(10) || '    String s = {string}; {comment}' || chr(10) || repeat('    { if (a != null) { b[0]++; } ', CAST(n_chars % 4 AS INT)) || repeat('}', CAST(n_chars % 4 AS INT)) || chr(10) || '    char c = {char}; return ' || n_chars || ';' || chr(10) || '  }'"
_FIRST = _BODY.replace("{string}", "\"}' || source || '\\\"{\"").replace("{comment}", "// } ' || lang || '").replace("{char}", "''{''")
_BARE = _BODY.replace("{string}", "").replace("{comment}", "").replace("{char}", "")
_SECOND = "'int work(int a) { return a; }'"

_OUTSIDE = _JAVA.replace("{doc}", "''").replace("{first}", _BARE).replace("{second}", _SECOND)

ORACLE_SQL = {
    "review_cases": """
WITH h AS (SELECT c.conv_id, t.turn, t.role FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, turn % 4) AS n FROM conversations WHERE role = 'user') t ON t.conv_id = c.conv_id AND t.n = 1 AND t.turn % 4 = c.conv_id % 3),
x AS (SELECT *, (conv_id + turn) % 5 <> 0 AS recorded, turn % 3 = 1 AS own, 'new ' || turn || CASE WHEN turn % 4 = 2 THEN '' ELSE chr(10) || 'kept' END AS new_side, 'old ' || role || CASE WHEN turn % 4 = 2 THEN '' ELSE chr(10) || 'kept' END AS old_side FROM h)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN recorded AND own THEN new_side END AS revision, CASE WHEN recorded AND own THEN old_side || chr(10) || chr(10) || role END AS before, CASE WHEN recorded AND own THEN new_side END AS after,
CASE WHEN turn IS NULL OR NOT recorded THEN 'no_recorded_revision' WHEN NOT own THEN 'same_file_nonempty_revision_unavailable' WHEN conv_id % 7 = 0 THEN 'review_request_invalid' END AS reason FROM x""",
    "tree_distances": """
WITH t AS (SELECT conv_id, string_agg(role[1:1], '' ORDER BY turn) AS r FROM conversations GROUP BY conv_id), p AS (SELECT a.conv_id, levenshtein(a.r, b.r) AS dist, length(a.r) + length(b.r) + 2 AS n FROM t a JOIN t b ON b.conv_id = a.conv_id + 1)
SELECT conv_id, dist AS distance, CASE WHEN conv_id % 4 <> 0 THEN round(1 - dist / n::DOUBLE, 6) WHEN conv_id % 8 <> 0 THEN 0.5 END AS score, CASE WHEN conv_id % 4 <> 0 THEN 'TRS' WHEN conv_id % 8 <> 0 THEN 'STS' END AS tier, CASE WHEN conv_id % 4 <> 0 THEN 'grs_unavailable' ELSE 'grs_unavailable,trs_unavailable' END AS reasons FROM p""",
    "extracted_methods": f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256({_DOC} || chr(10) || '  ' || {_FIRST}) WHEN 1 THEN sha256({_SECOND}) END AS method_sha256, 'a.b' AS package, 'java.util.List,static c.D.*' AS imports,
CAST(length(regexp_replace({_OUTSIDE}, '[\\s]', '', 'g')) AS BIGINT) AS n_outside FROM documents""",
    "nested_json": """
WITH e AS (SELECT *, event_id % 9 = 0 AS bad, json_keys(props) AS pk, user_id % 2 = 0 AS even FROM events)
SELECT event_id, CASE WHEN NOT bad THEN array_to_string(list_sort(list_distinct(list_concat(pk, ['a', 'props', 'id', 'path', 'diffHunk'], CASE WHEN even THEN ['user'] ELSE [] END))), ',') END AS keys,
CASE WHEN NOT bad AND event_id % 5 <> 0 THEN '{"diffHunk":"' || event_type || '","id":"x","path":"p"' || CASE WHEN even THEN ',"user":' || user_id ELSE '' END || '}' END AS found FROM e""",
}
