"""Cohort mining, matching, timelines, set operations, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cohort, matching
from ..sources import files
from ..streaming import ledger
from .tables import labelled, r6, table


def row_candidates(spark, d):
    """Documents as review rows: every third has a Java path, every fifth a malformed commit."""
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("/A.JAVA"))).otherwise(F.concat(F.col("source"), F.lit("/a.txt")))
    commit = F.when(F.col("doc_id") % 5 == 0, "zz").otherwise(F.sha1(F.col("doc_id").cast("string").cast("binary")))
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("code"), path.alias("path"), commit.alias("commit"))
    return cohort.row_candidates(rows).select("doc_id", F.col("token_count").cast("long").alias("token_count"))


def positive_projects(spark, d):
    """Negatives of sources that have any positive."""
    rows = labelled(spark, d)
    yes = rows.filter("toxic = 1").select("source")
    return rows.filter("toxic = 0").join(yes, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("negatives"))


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 4 == 0).alias("positive"))


def nearest_match_with_replacement(spark, d):
    """Orders' urgent rows with the nearest other order of the customer by price."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("u"))
    rows = cohort.nearest_match(o.filter("u"), o.filter("NOT u"), "o_custkey", "o_totalprice", "o_orderkey")
    return rows.select("o_custkey", "unit", "match", r6("distance").alias("distance"))


def greedy_match_without_replacement(spark, d):
    rows = matching.match_without_replacement(_parts(spark, d), "p_brand", "positive", "p_size", "p_partkey")
    return rows.select("p_brand", "unit", "match", r6("distance").alias("distance"))


def greedy_match_in_one_group(spark, d):
    """All parts as one group: every fourth takes the nearest by price of the parts that are left."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 4 == 0).alias("positive"), F.lit("all").alias("g"))
    return matching.match_without_replacement(parts, "g", "positive", "price", "p_partkey", 512).select("unit", "match", r6("distance").alias("distance"))


#: Of each order status, so many customers, and of all.
_QUOTAS, _TOTAL = {"F": 20, "O": 15, "P": 5}, 60


def _quota_orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


def quota_selection(spark, d):
    """Urgent orders by quotas of their status, no customer twice, then any up to the total."""
    found = matching.fill_quotas(_quota_orders(spark, d).filter("urgent"), "o_custkey", "o_orderstatus", "o_orderkey", _QUOTAS, _TOTAL)
    return found.select(F.col("unit").cast("long").alias("o_orderkey"), F.col("project").cast("long").alias("o_custkey"), F.col("category").alias("o_orderstatus"), "place")


def one_pair_a_project(spark, d):
    """One urgent order a customer, by quotas, with the customer's nearest other order by price."""
    found = matching.one_pair_a_project(_quota_orders(spark, d), "o_custkey", "urgent", "o_orderstatus", "o_totalprice", "o_orderkey", _QUOTAS, _TOTAL)
    return found.select("place", "o_custkey", F.col("category").alias("o_orderstatus"), "unit", "match", r6("distance").alias("distance"))


def closest_pairs_topk(spark, d):
    rows = nearest_match_with_replacement(spark, d)
    return cohort.closest_pairs(rows, "distance", "unit", 60).select("pair_id", "unit", "match", "distance")


def hours_to_next_purchase(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    kinds = sorted(("click", "purchase"))
    rows = cohort.next_event(rows, "user_id", "at", F.col("event_type") == kinds[0], F.col("event_type") == kinds[1])
    return rows.select("event_id", r6((F.col("next_at") - F.col("at")) / 3.6e9).alias("hours"))


def last_row_wins(spark, d):
    rows = cohort.last_wins(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")), ["l_partkey"], "o")
    return rows.select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def manifest_diff(spark, d):
    """Two listings of files by number: documents and benchmark items, and pages, labels and items in lower case."""
    listing = lambda name, key, text, kind: table(spark, d, name).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    expected = listing("documents", "doc_id", F.col("text"), "t").unionByName(listing("benchmark", "item_id", F.col("text"), "b"))
    actual = listing("pages", "page_id", F.col("html"), "t").unionByName(listing("benchmark", "item_id", F.lower("text"), "b")).unionByName(listing("nation", "n_nationkey", F.col("n_name"), "n"))
    return cohort.manifest_diff(expected, actual)


def three_way_split(spark, d):
    """Numbers of labelled documents against those of vectors."""
    a, b = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, d, "labels")
    return cohort.three_way(a, b, "doc_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def multiset_difference(spark, d):
    """Statuses left when orders' statuses are taken from order lines' flags, each as often as it occurs."""
    a, b = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("s")), table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"))
    return a.exceptAll(b).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def distinct_union(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.unionByName(b).distinct()


def bag_union(spark, d):
    """How often each key is in orders and customers together."""
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def missing_units(spark, d):
    """Documents without a label."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def json_numeric_availability(spark, d):
    """Events whose properties hold a number under k, and its mean."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("available"), r6(F.avg(k)).alias("mean"))


def review_hours(spark, d):
    """Review metadata from a user's timeline: events as nested review entries."""
    entry = F.struct(F.when(F.col("event_type") == "purchase", "commit").otherwise("inlineReview").alias("type"), F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("createdAt"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("committedDate"), F.col("event_type").alias("author"), F.array().cast("array<string>").alias("replies"))
    lines = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("timeline"), F.min("ts").alias("first"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))
    lines = lines.withColumn("event", cohort.review_event(F.col("timeline"), F.col("first_id")))
    m = cohort.review_metadata(F.col("timeline"), F.col("event"), F.date_format(F.col("first").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(None).cast("string"))
    return lines.filter("event IS NOT NULL").select("user_id", m.alias("m")).select("user_id", r6("m.hours_to_next_commit").alias("hours"), F.col("m.inline_review_count").cast("long").alias("reviews"), F.col("m.commit_count").cast("long").alias("commits"), F.col("m.reviewer_count").cast("long").alias("reviewers"), F.col("m.merged").alias("merged"))


def secret_findings(spark, d):
    """Secrets in documents, each followed by settings lines made of its own id: rule and line of the first match."""
    docs = table(spark, d, "documents").withColumn("text", F.concat("text", F.lit("\nkey = v\napi_key: "), F.sha2(F.col("doc_id").cast("string"), 256), F.when(F.col("lang") == "en", F.concat(F.lit("\nAuthorization: Bearer "), F.sha1(F.col("source").cast("binary")))).otherwise("\nnothing")))
    return files.scan_secrets(docs, "doc_id", "text").select("doc_id", "rule", F.col("line").cast("long").alias("line"))


def marker_findings(spark, d):
    return files.scan_markers(table(spark, d, "documents"), "doc_id", "text", ["the", "License", "@"]).select("doc_id", "marker", F.col("line").cast("long").alias("line"))


def file_snapshot(spark, d):
    """Path, bytes and digest of all files of the tables' folder, as manifest rows."""
    return files.snapshot_tree(spark, d).select("path", "bytes", "sha256")


def stratified_topk(spark, d):
    """The two cheapest parts of each type, ties by key."""
    w = Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 2").select("p_type", "p_partkey", "place")


def stream_first_valid(spark, d):
    """First valid attempts from the ledger read as a stream."""
    s = ledger.stream_of(spark, f"{d}/lineitem.parquet").withColumn("valid", F.col("l_returnflag") != "R")
    return ledger.drained(ledger.first_valid_stream(s, ["l_orderkey"], "l_linenumber", "valid"), "complete").select("l_orderkey", "attempts", F.col("selected_attempt").cast("long").alias("selected_attempt"))


def stream_decided_cells(spark, d):
    """Orders decided by their lines as they stream in: the first line that wasn't returned, if all before it have come, or that the first three were."""
    s = ledger.stream_of(spark, f"{d}/lineitem.parquet").withColumn("valid", F.col("l_returnflag") != "R")
    rows = ledger.drained(ledger.decisions(s, "l_orderkey", "l_linenumber", "valid", 3), "update", "cell")
    return rows.select(F.col("cell").alias("l_orderkey"), "status", "selected_attempt")


def stream_window_rates(spark, d):
    """Events and errors a day from the event stream."""
    s = ledger.stream_of(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    rows = ledger.drained(ledger.window_rates(s, "at", F.col("event_type") == "error", "1 day", "30 days"), "complete")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "failed")


QUERIES = {f.__name__: f for f in (row_candidates, positive_projects, nearest_match_with_replacement, greedy_match_without_replacement, greedy_match_in_one_group, quota_selection, one_pair_a_project, closest_pairs_topk, hours_to_next_purchase, last_row_wins, manifest_diff, three_way_split, multiset_difference, distinct_union, bag_union, missing_units, json_numeric_availability, review_hours, secret_findings, marker_findings, file_snapshot, stratified_topk, stream_first_valid, stream_decided_cells, stream_window_rates)}

_Q = text.TOKEN_PATTERN.replace("'", "''")
_NEAREST = """(WITH o AS (SELECT o_custkey, o_orderkey, ln(1 + o_totalprice) AS s, o_orderpriority = '1-URGENT' AS u FROM orders),
p AS (SELECT a.o_custkey, a.o_orderkey AS unit, b.o_orderkey AS match, abs(a.s - b.s) AS distance, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.s - b.s), sha256(CAST(b.o_orderkey AS VARCHAR))) AS n FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.u AND NOT b.u)
SELECT o_custkey, unit, match, round(distance, 6) AS distance FROM p WHERE n = 1)"""
#: The same patterns for SQL: an empty group at the start (what stands before the match), look-behind as a group, quotes doubled.
_RULES = {rule: (p.replace("(?i)", "(?i)()") if p.startswith("(?i)") else p.replace("(?<![A-Za-z0-9_-])", "(^|[^A-Za-z0-9_-])") if p.startswith("(?<!") else "()" + p).replace("'", "''") for rule, p in files.SECRET_PATTERNS.items()}



def _quota_sql(where: str) -> str:
    """(o_orderkey, o_custkey, o_orderstatus, place): a step for each category and one for the rest, each over customers that none before has taken."""
    steps, taken = [], []
    for i, (status, n) in enumerate([*_QUOTAS.items(), (None, _TOTAL)]):
        used = f" AND o_custkey NOT IN ({' UNION ALL '.join(f'SELECT o_custkey FROM t{k}' for k in taken)})" if taken else ""
        before = " + ".join(f"(SELECT count(*) FROM t{k})" for k in taken) or "0"
        only = f" AND o_orderstatus = '{status}'" if status else ""
        first = f"SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h) AS f FROM u WHERE true{only}{used}"
        steps.append(f"t{i} AS (SELECT o_orderkey, o_custkey, o_orderstatus, {before} + r AS place FROM (SELECT *, row_number() OVER (ORDER BY h) AS r FROM ({first}) WHERE f = 1) WHERE r <= least({n}, {_TOTAL} - ({before})))")
        taken.append(i)
    source = f"u AS (SELECT *, sha256('quota' || chr(31) || o_custkey || chr(31) || o_orderkey) AS h FROM orders WHERE o_orderpriority = '1-URGENT'{where})"
    return f"WITH {source}, {', '.join(steps)} {' UNION ALL '.join(f'SELECT * FROM t{k}' for k in taken)}"


ORACLE_SQL = {
    "greedy_match_in_one_group": """
WITH RECURSIVE q AS (SELECT p_partkey AS k, p_partkey % 4 = 0 AS pos, ln(1 + p_retailprice) AS s, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part),
a AS (SELECT *, row_number() OVER (ORDER BY h) AS i FROM q WHERE pos),
m(i, unit, match, distance, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[]) UNION ALL
SELECT i, unit, match, distance, list_append(used, match) FROM (SELECT a.i, a.k AS unit, n.k AS match, abs(a.s - n.s) AS distance, m.used, row_number() OVER (ORDER BY abs(a.s - n.s), n.h) AS best
FROM m JOIN a ON a.i = m.i + 1 JOIN q n ON NOT n.pos AND NOT list_contains(m.used, n.k)) WHERE best = 1)
SELECT unit, match, round(distance, 6) AS distance FROM m WHERE i > 0""",
    "quota_selection": f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(place AS BIGINT) AS place FROM ({_quota_sql('')})",
    "one_pair_a_project": f"""
SELECT place, o_custkey, o_orderstatus, unit, match, round(distance, 6) AS distance FROM (
SELECT CAST(c.place AS BIGINT) AS place, c.o_custkey, c.o_orderstatus, c.o_orderkey AS unit, n.o_orderkey AS match, abs(ln(1 + o.o_totalprice) - ln(1 + n.o_totalprice)) AS distance,
       row_number() OVER (PARTITION BY c.place ORDER BY abs(ln(1 + o.o_totalprice) - ln(1 + n.o_totalprice)), sha256(CAST(n.o_orderkey AS VARCHAR))) AS r
FROM ({_quota_sql(" AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')")}) c JOIN orders o USING (o_orderkey) JOIN orders n ON n.o_custkey = c.o_custkey AND n.o_orderpriority <> '1-URGENT') WHERE r = 1""",
    "greedy_match_without_replacement": """
WITH RECURSIVE q AS (SELECT p_brand, p_partkey AS k, p_partkey % 4 = 0 AS pos, ln(1 + CAST(p_size AS DOUBLE)) AS s, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS i FROM q WHERE pos),
m(p_brand, i, unit, match, distance, used) AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[]) FROM q UNION ALL
SELECT p_brand, i, unit, match, distance, list_append(used, match) FROM (SELECT m.p_brand, a.i, a.k AS unit, n.k AS match, abs(a.s - n.s) AS distance, m.used, row_number() OVER (PARTITION BY m.p_brand ORDER BY abs(a.s - n.s), n.h) AS best
FROM m JOIN a ON a.p_brand = m.p_brand AND a.i = m.i + 1 JOIN q n ON n.p_brand = m.p_brand AND NOT n.pos AND NOT list_contains(m.used, n.k)) WHERE best = 1)
SELECT p_brand, unit, match, round(distance, 6) AS distance FROM m WHERE i > 0""",
    "row_candidates": f"SELECT doc_id, len(regexp_extract_all(text, '{_Q}')) AS token_count FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND strlen(text) <= 24000 AND len(regexp_extract_all(text, '{_Q}')) BETWEEN 12 AND 900",
    "positive_projects": "WITH l AS (SELECT source, toxic FROM documents JOIN labels USING (doc_id)) SELECT source, count(*) AS negatives FROM l WHERE toxic = 0 AND source IN (SELECT source FROM l WHERE toxic = 1) GROUP BY source",
    "nearest_match_with_replacement": f"SELECT * FROM {_NEAREST}",
    "closest_pairs_topk": f"WITH t AS (SELECT *, sha256(CAST(unit AS VARCHAR)) AS h FROM {_NEAREST} ORDER BY distance, h LIMIT 60) SELECT 'half-pair-' || lpad(CAST(row_number() OVER (ORDER BY h) AS VARCHAR), 4, '0') AS pair_id, unit, match, distance FROM t",
    "hours_to_next_purchase": "WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS at, event_type FROM events) SELECT a.event_id, round((min(b.at) - any_value(a.at)) / 3.6e9, 6) AS hours FROM a LEFT JOIN a b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.at >= a.at WHERE a.event_type = 'click' GROUP BY a.event_id",
    "last_row_wins": "SELECT l_partkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1",
    "manifest_diff": "WITH e AS (SELECT 't' || doc_id AS path, strlen(text) AS n, sha256(text) AS h FROM documents UNION ALL SELECT 'b' || item_id, strlen(text), sha256(text) FROM benchmark), a AS (SELECT 't' || page_id AS path, strlen(html) AS n, sha256(html) AS h FROM pages UNION ALL SELECT 'b' || item_id, strlen(lower(text)), sha256(lower(text)) FROM benchmark UNION ALL SELECT 'n' || n_nationkey, strlen(n_name), sha256(n_name) FROM nation), f AS (SELECT path, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'unexpected' WHEN a.n <> e.n THEN 'size_mismatch' WHEN a.h <> e.h THEN 'hash_mismatch' END AS finding FROM e FULL JOIN a USING (path)) SELECT * FROM f WHERE finding IS NOT NULL",
    "three_way_split": "SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.vec_id IS NULL THEN 'unexpected' ELSE 'common' END AS side, count(*) AS n FROM (SELECT DISTINCT vec_id FROM embeddings) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.vec_id = b.doc_id GROUP BY 1",
    "multiset_difference": "SELECT s, count(*) AS n FROM (SELECT l_linestatus AS s FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders) GROUP BY s",
    "distinct_union": "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer",
    "bag_union": "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY k",
    "missing_units": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "json_numeric_availability": "SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS available, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean FROM events GROUP BY event_type",
    "review_hours": "WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1), g AS (SELECT f.user_id, e.ts AS at FROM f JOIN events e ON e.event_id = f.id WHERE e.event_type <> 'purchase') SELECT g.user_id, round((min(epoch_us(e.ts)) FILTER (e.event_type = 'purchase' AND e.ts >= g.at) - any_value(epoch_us(g.at))) / 3.6e9, 6) AS hours, count(*) FILTER (e.event_type <> 'purchase') AS reviews, count(*) FILTER (e.event_type = 'purchase') AS commits, count(DISTINCT e.event_type) FILTER (e.event_type <> 'purchase') AS reviewers, false AS merged FROM g JOIN events e USING (user_id) GROUP BY g.user_id",
    "secret_findings": " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, CAST(length(s) - length(replace(s, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, string_split_regex(text, '{p}')[1] || regexp_extract(text, '{p}', 1) AS s FROM (SELECT doc_id, text || chr(10) || 'key = v' || chr(10) || 'api_key: ' || sha256(CAST(doc_id AS VARCHAR)) || CASE WHEN lang = 'en' THEN chr(10) || 'Authorization: Bearer ' || sha1(source) ELSE chr(10) || 'nothing' END AS text FROM documents) WHERE regexp_matches(text, '{p}'))" for rule, p in _RULES.items()),
    "marker_findings": "SELECT doc_id, marker, length(substr(text, 1, instr(text, marker) - 1)) - length(replace(substr(text, 1, instr(text, marker) - 1), chr(10), '')) + 1 AS line FROM documents, (SELECT unnest(['the', 'License', '@']) AS marker) WHERE instr(text, marker) > 0",
    "stratified_topk": "SELECT p_type, p_partkey, place FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS place FROM part) WHERE place <= 2",
    "stream_first_valid": "SELECT l_orderkey, count(*) AS attempts, CAST(min(l_linenumber) FILTER (l_returnflag <> 'R') AS BIGINT) AS selected_attempt FROM lineitem GROUP BY 1",
    "stream_decided_cells": "WITH a AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, n, ok, count(*) OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM a WHERE n BETWEEN 1 AND 3), s AS (SELECT l_orderkey, min(n) FILTER (ok AND n = k) AS first, count(*) FILTER (n = k AND NOT ok) AS failed FROM p GROUP BY 1) SELECT l_orderkey, CASE WHEN first IS NOT NULL THEN 'selected' ELSE 'blocked' END AS status, first AS selected_attempt FROM s WHERE first IS NOT NULL OR failed = 3",
    "stream_window_rates": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
}
