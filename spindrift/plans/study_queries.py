"""Assembly of a study's tables: asserted joins, audits, prompts, documents, association tables and metrics by arm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, ranks, text
from ..operators import aggregates, audit, cohort, documents, paired, selection
from .rank_queries import _UNITS_SQL, _corr, _units
from .tables import TURN_PAIRS_SQL, r6, table, turn_pairs


def strict_joins(spark, d):
    """Orders with their customers, nations and regions; a row without a partner at any step is an error."""
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_totalprice")
    steps = (("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey"), ("region", "r_regionkey", "r_name"))
    for name, key, keep in steps:
        right = table(spark, d, name).select(F.col(key).alias("k"), F.col(keep).alias("next"))
        rows = cohort.strict_join(rows.withColumnRenamed(rows.columns[0], "k"), right, ["k"], f"order_without_{name}").select("next", "o_totalprice")
    return rows.groupBy(F.col("next").alias("region")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean"))


def staged_cases(spark, d):
    """Conversations that have all of their first four turns, a column each."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return cohort.pivot_stages(turns, "conv_id", "turn", "chars", [0, 1, 2, 3])


def content_lookup(spark, d):
    """Lengths of both texts of turn pairs, computed once for each distinct text and joined back twice."""
    contents, rows = cohort.by_content(turn_pairs(spark, d), ["reference", "candidate"])
    known = contents.select("sha256", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))
    for side in ("reference", "candidate"):
        rows = rows.join(known.select(F.col("sha256").alias(f"{side}_sha256"), F.col("n").alias(f"{side}_tokens")), f"{side}_sha256")
    return rows.select("conv_id", "turn", "reference_tokens", "candidate_tokens")


def complete_records(spark, d):
    """Labelled documents as complete records: a unit each, outcomes 0 or 1, positive length, a predictor."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("predictor", F.when(F.col("lang") != "de", F.col("n_chars")))
    rows = cohort.complete_records(rows, "doc_id", "predictor", ["quality", "toxic"], "n_chars")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("predictor").cast("long").alias("predictor"))


def fixed_cohort(spark, d):
    """First attempts of all order lines as a closed cohort, in order, by run."""
    checks = F.create_map(F.lit("quantity"), F.col("l_quantity") > 0, F.lit("price"), F.col("l_extendedprice") > 0)
    cells = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("run"), F.lit(1).alias("attempt"), checks.alias("checks"))
    # what there must be is taken from the orders' side: lines by number, and orders by how many lines they have
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per_unit = {r["n"]: r["units"] for r in lines.groupBy("n").agg(F.count(F.lit(1)).alias("units")).collect()}
    runs = {r["l"]: r["n"] for r in table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("l")).agg(F.count("l_orderkey").alias("n")).collect()}
    return selection.fixed_cohort(cells, "l_orderkey", "run", "attempt", "checks", sum(n * units for n, units in per_unit.items()), runs, per_unit).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def usage_audit(spark, d):
    """Order lines as usage records, some without numbers, some with a wrong total: how many break which rule first."""
    n = F.col("l_linenumber").cast("long")
    q = F.col("l_quantity").cast("long")
    usage = F.struct(
        F.when(F.col("l_returnflag") != "A", q).alias("prompt_tokens"), n.alias("completion_tokens"), F.when(F.col("l_returnflag") == "R", q).otherwise(q + n).alias("total_tokens"),
        F.when(F.col("l_tax") == 0, F.lit(-1)).alias("prompt_cache_hit_tokens"), F.lit(None).cast("long").alias("prompt_cache_miss_tokens"),
    )
    code = audit.usage_error(F.when(F.col("l_discount") > 0, usage))
    return table(spark, d, "lineitem").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def pin_audit(spark, d):
    """Parts as required inputs and pins: what is missing, unresolved or not pinned."""
    parts = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("id"), "p_size", "p_type", F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("sha"))
    kind = F.element_at(F.array(*map(F.lit, (*audit.PIN_TYPES, "other"))), (F.col("p_size") % 6 + 1).cast("int"))
    pins = parts.filter("p_size <> 7").select(
        "id", F.when(F.col("p_size") == 9, "open").otherwise("pinned").alias("status"), kind.alias("pin_type"), F.when(F.col("p_size") < 30, "there").alias("source"),
        F.when(F.col("p_size") < 40, F.col("sha")).otherwise("main").alias("revision"), F.when(F.col("p_size") < 35, "x==1").otherwise("x>1").alias("requirement"),
        F.when(F.col("p_size") < 20, "https://h").otherwise("http://h").alias("endpoint"), F.when(F.col("p_size") < 45, "m").otherwise("TBD").alias("model"),
    )
    return audit.pin_findings(parts.filter("p_size <> 11").select("id"), pins).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def tree_paths(spark, d):
    """Documents as files of a tree: those under two folders, less those that a glob names, with the folder taken off."""
    files = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    chosen = audit.expand_paths(files, ["fr/none.txt"], ["en", "de/"], ["*7.txt", "en/?rc1*"])
    return audit.subtree(chosen, "en").unionByName(audit.subtree(chosen, "de"))


def artifact_audit(spark, d):
    """Events as artifacts with JSON and CSV contents: forbidden names, keys and headers."""
    name = F.concat(F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", ".json").when(F.col("event_type") == "error", ".csv").otherwise(".txt"))
    content = F.when(F.col("event_type") == "error", "user id,value\n1,2").when(F.col("event_type") == "click", F.concat(F.lit('{"Raw_Code": '), F.coalesce("props", F.lit("null")), F.lit("}"))).otherwise(F.col("props"))
    rows = table(spark, d, "events").select(name.alias("path"), content.alias("content"))
    found = audit.artifact_findings(rows, "path", "content", r"(^|/)purchase-[0-9]*0\.txt$", ["rawCode"], ["User ID"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def latest_events(spark, d):
    """The last event of each user and kind."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return audit.latest_record(rows, ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id")


def rendered_prompts(spark, d):
    """Digest of each benchmark item's prompt."""
    prompt = audit.render_prompt("Read this.\n{{CASE_JSON}}\nAnswer in JSON.", "CASE_JSON", F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(prompt, 256).alias("prompt_sha256"))


def isolated_payloads(spark, d):
    """Documents whose payload holds neither the text that is to be kept apart, nor its digest, nor a forbidden key."""
    code = F.element_at(F.array(F.lit("SCH"), F.lit("TION"), F.lit("ABLE")), (F.col("n_chars") % 3 + 1).cast("int"))
    rows = table(spark, d, "documents").select(code.alias("code"), F.concat(F.lit('{"Source": "'), "source", F.lit('", "lang": "'), "lang", F.lit('", "text": "'), text.simple_upper(F.col("text")), F.lit('"}')).alias("payload"))
    return rows.groupBy(documents.isolated(F.col("payload"), F.col("code"), ["original_code"]).alias("isolated"), documents.isolated(F.col("payload"), F.col("code"), ["LANG"]).alias("without_lang")).agg(F.count(F.lit(1)).alias("n"))


def code_documents(spark, d):
    """Documents as generated code: how many break which rule first."""
    made = F.struct(F.when(F.col("source") > "src2", "regenerated-code-v1").otherwise("v0").alias("schema_version"), F.when(F.col("lang") == "en", "java").otherwise(F.col("lang")).alias("language"), F.concat(F.when(F.col("n_chars") % 3 == 0, " ").otherwise("x"), "source").alias("code"))
    raw = F.when(F.col("n_chars") % 7 == 0, "{").otherwise(F.to_json(made))
    return table(spark, d, "documents").groupBy(documents.code_error(raw).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def recovered_answers(spark, d):
    """JSON objects out of answers that are plain, fenced or have words around them."""
    body = F.concat(F.lit('{"b": '), F.col("n_chars").cast("string"), F.lit(', "a": "'), "source", F.lit('"}'))
    raw = F.when(F.col("lang") == "en", body).when(F.col("lang") == "de", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("lang") == "fr", F.concat(F.lit("Here {it} is: "), body, F.lit(" done."))).otherwise("no object")
    return table(spark, d, "documents").select("doc_id", documents.recovered_json(raw).alias("found"))


def text_places(spark, d):
    """Line and column of the first capital T, a web address, a file name and a normalised key of each document."""
    at = F.instr("text", "T") - 1
    place = text.line_column(F.col("text"), F.greatest(at, F.lit(0)))
    url = text.source_web_url(F.when(F.col("lang") == "en", "https://github.com/a/b.git").otherwise("https://example.org/c.git"), F.lit("f00"), F.col("source"), F.col("doc_id"), F.col("doc_id") + 2)
    return table(spark, d, "documents").select("doc_id", F.when(at >= 0, place["line"]).cast("long").alias("line"), F.when(at >= 0, place["column"]).cast("long").alias("col"), url.alias("url"), text.safe_filename(F.concat(F.lit("x y/"), "source", F.lit("::"), "lang")).alias("file"), text.normalized_key(F.concat("source", F.lit("_K-1"))).alias("key"))


def normalized_views(spark, d):
    """Digest of each benchmark item's tokens with single spaces between them."""
    return table(spark, d, "benchmark").select("item_id", F.sha2(text.joined(text.tokens(F.col("text"))), 256).alias("view_sha256"))


def safe_numbers(spark, d):
    """Ratios of discount and tax as JSON can hold them, summed."""
    ratio = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide("l_discount", "l_tax"))
    rows = table(spark, d, "lineitem").select(text.json_safe(ratio).alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), r6(F.avg("x")).alias("mean"))


def java_class_facts(spark, d):
    """Facts of a Java method made from each document's numbers: branches, literals and lambdas as many as they ask for; French ones lack their last brace, German ones have a second method."""
    many = lambda piece, n: F.repeat(F.lit(piece), n.cast("int"))
    source = F.concat(
        F.lit("/** if (x) { "), "source", F.lit(" */\nint f(int a) throws java.io.IOException, E {\n"), many("  if (a > 1 && a < 9) { a++; } // while (\n", F.col("n_chars") % 5), many("  String s = \"while (\\\"{\";\n", F.col("doc_id") % 3),
        many("  Runnable r = () -> { if (a > 0) { } };\n\n", F.col("doc_id") % 2), F.lit("  return a > 0 ? a : 1;\n"), F.when(F.col("lang") == "fr", "").otherwise("}\n"), F.when(F.col("lang") == "de", "int g() { return 1; }\n").otherwise(""),
    )
    rows = table(spark, d, "documents").select("doc_id", java.facts(source).alias("f"))
    return rows.select("doc_id", F.col("f.token_count").cast("long").alias("token_count"), F.col("f.ncloc").cast("long").alias("ncloc"), F.col("f.cyclomatic").cast("long").alias("cyclomatic"), F.array_join("f.failure_codes", ",").alias("failure_codes"))


def partial_spearman_two_controls(spark, d):
    rows = ranks.partial_spearman_of(_units(spark, d), "price", "orders", ["balance", "done"], ["c_mktsegment"])
    return rows.select("c_mktsegment", "n", r6("rho").alias("rho"))


def size_association(spark, d):
    """Tokens against line feeds, by language, with Fisher's interval."""
    rows = table(spark, d, "documents").select("lang", F.size(text.tokens(F.col("text"))).alias("tokens"), "n_chars")
    return ranks.association(rows, "tokens", "n_chars", ["lang"]).select("lang", "n", *[r6(c).alias(c) for c in ("rho", "low", "high")])


def association_table(spark, d):
    """Every order figure with every customer figure, raw and with the number of orders held."""
    rows = ranks.association_table(_units(spark, d), ["price", "done"], ["balance", "c_nationkey"], "orders")
    return rows.select("predictor", "outcome", "n", *[r6(c).alias(c) for c in ("rho", "low", "high", "partial", "partial_low", "partial_high")])


def strongest_feature(spark, d):
    """The order figure that goes with each customer figure most."""
    rows = ranks.association_table(_units(spark, d), ["price", "done"], ["balance", "c_nationkey"], "orders")
    return ranks.strongest(rows.withColumn("rho", r6("rho")), "predictor", "rho", ["outcome"])


def metric_contrasts(spark, d):
    """Named pairs of order line figures as arms: means, differences and signs by metric."""
    rows = paired.long_metrics(table(spark, d, "lineitem"), ["l_orderkey"], {"rates": (F.col("l_discount"), F.col("l_tax")), "counts": (F.col("l_quantity"), F.col("l_linenumber"))})
    s = paired.paired_summary(rows, "left", "right", ["metric"])
    return s.select("metric", "n", *[r6(c).alias(c) for c in ("left_mean", "right_mean", "difference_mean", "difference_median", "difference_sd")], "positive", "zero", "negative")


def displayed_contrasts(spark, d):
    """Which customers' segments would be marked: order figures that separate, with a share as p."""
    rows = _units(spark, d).select("c_mktsegment", "c_custkey", F.col("done").alias("left"), F.round(F.col("orders") / 40, 6).alias("right"))
    s = paired.arm_auc(rows, "left", "right", ["c_mktsegment"])
    return s.select("c_mktsegment", r6("separation").alias("separation"), ranks.displayed(1 / F.col("n1"), F.col("separation")).alias("displayed"))


def unit_outcomes(spark, d):
    """Documents' figures by source, with a column that must not vary."""
    rows = table(spark, d, "lineitem").select("l_orderkey", r6(F.col("l_quantity") / 50).alias("au"), (F.col("l_returnflag") != "R").cast("int").alias("pbu"), (F.col("l_orderkey") % 7).alias("project"))
    u = aggregates.unit_outcomes(rows, "l_orderkey", "au", "pbu", ("project",))
    return u.groupBy("project").agg(F.count(F.lit(1)).alias("units"), r6(F.avg("score_mean")).alias("mean"), r6(F.avg("score_sd")).alias("sd"), F.sum("pass_numerator").alias("passed"), F.sum("pass_denominator").cast("long").alias("judged"))


QUERIES = {f.__name__: f for f in (
    strict_joins, staged_cases, content_lookup, complete_records, fixed_cohort, usage_audit, pin_audit, tree_paths, artifact_audit, latest_events, rendered_prompts, isolated_payloads, code_documents,
    recovered_answers, text_places, normalized_views, safe_numbers, java_class_facts, partial_spearman_two_controls, size_association, association_table, strongest_feature, metric_contrasts,
    displayed_contrasts, unit_outcomes,
)}

_Q = text.TOKEN_PATTERN.replace("'", "''")
_RANK = lambda by, *names: ", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS r{c}" for c in names)
_PARTIAL = lambda xy, xz, yz: f"(({xy}) - ({xz}) * ({yz})) / sqrt((1 - ({xz}) * ({xz})) * (1 - ({yz}) * ({yz})))"
_FISHER = lambda rho, n, sign, room: f"round(tanh(atanh({rho}) {sign} 1.959963984540054 / sqrt({n} - {room})), 6)"
_TABLE = f"""(WITH u AS (SELECT p.k AS predictor, p.v AS x, o.k AS outcome, o.v AS y, CAST(orders AS DOUBLE) AS z FROM {_UNITS_SQL} u, (VALUES ('price'), ('done')) AS a(k), (VALUES ('balance'), ('c_nationkey')) AS b(k),
LATERAL (SELECT a.k AS k, CASE a.k WHEN 'price' THEN price ELSE done END AS v) p, LATERAL (SELECT b.k AS k, CASE b.k WHEN 'balance' THEN balance ELSE c_nationkey END AS v) o),
r AS (SELECT predictor, outcome, {_RANK("predictor, outcome", "x", "y", "z")} FROM u),
c AS (SELECT predictor, outcome, count(*) AS n, {_corr("rx", "ry")} AS rho, {_corr("rx", "rz")} AS xz, {_corr("ry", "rz")} AS yz FROM r GROUP BY ALL),
p AS (SELECT *, {_PARTIAL("rho", "xz", "yz")} AS pr FROM c)
SELECT predictor, outcome, n, round(rho, 6) AS rho, {_FISHER("rho", "n", "-", 3)} AS low, {_FISHER("rho", "n", "+", 3)} AS high, round(pr, 6) AS partial, {_FISHER("pr", "n", "-", 4)} AS partial_low, {_FISHER("pr", "n", "+", 4)} AS partial_high FROM p)"""
_SUMMARY = lambda name, a, b: f"SELECT '{name}' AS metric, count(*) AS n, round(avg({a}), 6) AS left_mean, round(avg({b}), 6) AS right_mean, round(avg({a} - {b}), 6) AS difference_mean, round(median({a} - {b}), 6) AS difference_median, round(stddev_samp({a} - {b}), 6) AS difference_sd, count(*) FILTER ({a} > {b}) AS positive, count(*) FILTER ({a} = {b}) AS zero, count(*) FILTER ({a} < {b}) AS negative FROM lineitem"

ORACLE_SQL = {
    "strict_joins": "SELECT r_name AS region, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "staged_cases": "SELECT * FROM (SELECT conv_id, " + ", ".join(f"max(length(text)) FILTER (turn = {k}) AS turn_{k}" for k in range(4)) + " FROM conversations GROUP BY 1) WHERE turn_0 IS NOT NULL AND turn_1 IS NOT NULL AND turn_2 IS NOT NULL AND turn_3 IS NOT NULL",
    "content_lookup": f"SELECT conv_id, turn, len(regexp_extract_all(reference, '{_Q}')) AS reference_tokens, len(regexp_extract_all(candidate, '{_Q}')) AS candidate_tokens FROM {TURN_PAIRS_SQL}",
    "complete_records": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS predictor FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de' GROUP BY 1",
    "fixed_cohort": "SELECT CAST(l_linenumber AS BIGINT) AS run, count(*) AS n FROM lineitem GROUP BY 1",
    "usage_audit": "SELECT CASE WHEN NOT l_discount > 0 THEN 'provider_usage_missing' WHEN l_tax = 0 THEN 'provider_usage_prompt_cache_hit_tokens_invalid' WHEN l_returnflag = 'A' THEN 'provider_usage_core_fields_missing' WHEN l_returnflag = 'R' THEN 'provider_usage_total_mismatch' END AS code, count(*) AS n FROM lineitem GROUP BY 1",
    "pin_audit": """WITH p AS (SELECT p_size AS s, p_size % 6 AS k FROM part), f AS (SELECT CASE WHEN s = 11 THEN ['undeclared_pin_record'] WHEN s = 7 THEN ['required_pin_missing'] WHEN s = 9 THEN ['input_unresolved']
ELSE list_filter([CASE WHEN k = 1 AND s >= 30 THEN 'git_source_unpinned' END, CASE WHEN k = 1 AND s >= 40 THEN 'git_revision_unpinned' END, CASE WHEN k = 2 AND s >= 35 THEN 'package_requirement_unpinned' END, CASE WHEN k = 2 AND s >= 30 THEN 'package_source_unpinned' END,
CASE WHEN k = 3 AND s >= 20 THEN 'service_endpoint_unpinned' END, CASE WHEN k = 3 AND s >= 45 THEN 'service_model_unpinned' END, CASE WHEN k = 5 THEN 'pin_type_invalid' END], lambda x: x IS NOT NULL) END AS codes FROM p)
SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM f) GROUP BY 1""",
    "tree_paths": "SELECT source || '-' || doc_id || '.txt' AS path FROM documents WHERE lang IN ('en', 'de') AND NOT (doc_id % 10 = 7) AND NOT (lang = 'en' AND regexp_matches(source, '^.rc1'))",
    "artifact_audit": "SELECT rule, count(*) AS n FROM (SELECT 'json_key_forbidden' AS rule FROM events WHERE event_type = 'click' UNION ALL SELECT 'csv_header_forbidden' FROM events WHERE event_type = 'error' UNION ALL SELECT 'filename_forbidden' FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0) GROUP BY 1",
    "latest_events": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "rendered_prompts": "SELECT item_id, sha256('Read this.' || chr(10) || text || chr(10) || 'Answer in JSON.') AS prompt_sha256 FROM benchmark",
    "isolated_payloads": "SELECT NOT contains(upper(text), ['SCH', 'TION', 'ABLE'][n_chars % 3 + 1]) AS isolated, false AS without_lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "code_documents": "SELECT CASE WHEN n_chars % 7 = 0 THEN 'regenerated_not_json' WHEN source <= 'src2' THEN 'regenerated_schema_version' WHEN lang <> 'en' THEN 'regenerated_language' WHEN n_chars % 3 = 0 THEN 'regenerated_code_not_trimmed' END AS code, count(*) AS n FROM documents GROUP BY 1",
    "recovered_answers": """SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN '{"a":"' || source || '","b":' || n_chars || '}' END AS found FROM documents""",
    "text_places": r"""WITH t AS (SELECT *, instr(text, 'T') AS i FROM documents), b AS (SELECT *, substr(text, 1, greatest(i - 1, 0)) AS before FROM t)
SELECT doc_id, CASE WHEN i > 0 THEN length(before) - length(replace(before, chr(10), '')) + 1 END AS line, CASE WHEN i > 0 THEN length(string_split(before, chr(10))[-1]) + 1 END AS col,
CASE WHEN lang = 'en' THEN 'https://github.com/a/b/blob/f00/' || source || '#L' || doc_id || '-L' || (doc_id + 2) ELSE 'https://example.org/c/src/f00/' || source || '#lines-' || doc_id || ':' || (doc_id + 2) END AS url,
'x_y_' || regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') || '_' || lang AS file, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') || 'k1' AS key FROM b""",
    "normalized_views": f"SELECT item_id, sha256(array_to_string(regexp_extract_all(text, '{_Q}'), ' ')) AS view_sha256 FROM benchmark",
    "safe_numbers": "SELECT count(*) AS n, count(*) FILTER (l_tax <> 0) AS known, round(avg(l_discount / l_tax) FILTER (l_tax <> 0), 6) AS mean FROM lineitem",
    "java_class_facts": "WITH k AS (SELECT doc_id, lang, n_chars % 5 AS b, doc_id % 3 AS s, doc_id % 2 AS l, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS whole, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS two FROM documents) SELECT doc_id, CAST(7 + 8 + 15 * b + 5 * s + 17 * l + 9 + whole + 9 * two AS BIGINT) AS token_count, CAST(2 + b + s + l + whole + two AS BIGINT) AS ncloc, CAST(CASE WHEN whole = 1 THEN 2 + 2 * b ELSE 1 END AS BIGINT) AS cyclomatic, CASE WHEN whole = 0 THEN 'unbalanced_brackets' WHEN two = 1 THEN 'not_exactly_one_method' ELSE '' END AS failure_codes FROM k",
    "partial_spearman_two_controls": f"""WITH u AS (SELECT c_mktsegment AS g, price AS x, orders AS y, balance AS z, done AS w FROM {_UNITS_SQL}), r AS (SELECT g, {_RANK("g", "x", "y", "z", "w")} FROM u),
c AS (SELECT g, count(*) AS n, {", ".join(f"{_corr('r' + a, 'r' + b)} AS {a}{b}" for a, b in ("xy", "xz", "yz", "xw", "yw", "zw"))} FROM r GROUP BY g),
p AS (SELECT g, n, {_PARTIAL("xy", "xz", "yz")} AS xy, {_PARTIAL("xw", "xz", "zw")} AS xw, {_PARTIAL("yw", "yz", "zw")} AS yw FROM c)
SELECT g AS c_mktsegment, n, round({_PARTIAL("xy", "xw", "yw")}, 6) AS rho FROM p""",
    "size_association": f"""WITH u AS (SELECT lang, len(regexp_extract_all(text, '{_Q}')) AS x, n_chars AS y FROM documents), r AS (SELECT lang, {_RANK("lang", "x", "y")} FROM u), c AS (SELECT lang, count(*) AS n, {_corr("rx", "ry")} AS rho FROM r GROUP BY lang)
SELECT lang, n, round(rho, 6) AS rho, {_FISHER("rho", "n", "-", 3)} AS low, {_FISHER("rho", "n", "+", 3)} AS high FROM c""",
    "association_table": f"SELECT * FROM {_TABLE}",
    "strongest_feature": f"SELECT outcome, predictor, rho FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY abs(rho) DESC, predictor) AS k FROM {_TABLE}) WHERE k = 1",
    "metric_contrasts": _SUMMARY("rates", "l_discount", "l_tax") + " UNION ALL " + _SUMMARY("counts", "l_quantity", "l_linenumber"),
    "displayed_contrasts": f"""WITH u AS (SELECT c_mktsegment AS g, done, round(orders / 40.0, 6) AS o FROM {_UNITS_SQL}), l AS (SELECT g, 1 AS l, done AS x FROM u UNION ALL SELECT g, 0, o FROM u), r AS (SELECT g, l, {_RANK("g", "x")} FROM l),
a AS (SELECT g, sum(l) AS n1, (sum(rx) FILTER (l = 1) - sum(l) * (sum(l) + 1) / 2.0) / (sum(l) * sum(1 - l)) AS auc FROM r GROUP BY g)
SELECT g AS c_mktsegment, round(greatest(auc, 1 - auc), 6) AS separation, 1.0 / n1 < 0.05 AND greatest(auc, 1 - auc) >= 0.55 AS displayed FROM a""",
    "unit_outcomes": "WITH u AS (SELECT l_orderkey, any_value(l_orderkey % 7) AS project, avg(round(l_quantity / 50, 6)) AS m, coalesce(stddev_samp(round(l_quantity / 50, 6)), 0) AS s, count(*) FILTER (l_returnflag <> 'R') AS p, count(*) AS j FROM lineitem GROUP BY 1) SELECT project, count(*) AS units, round(avg(m), 6) AS mean, round(avg(s), 6) AS sd, CAST(sum(p) AS BIGINT) AS passed, CAST(sum(j) AS BIGINT) AS judged FROM u GROUP BY 1",
}
