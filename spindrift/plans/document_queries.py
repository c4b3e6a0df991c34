"""Directions and code documents, strict and lenient: every document is a template filled with a row of the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents
from .tables import table

_STRICT = {"schema_version": documents.DIRECTIONS_VERSION}
_ONE = {"id": "D01", "action": "Read @S@.", "conditions": ["if @L@", "else"], "depends_on": []}
_TWO = {"id": "D02", "action": "Write @N@ lines.", "conditions": [], "depends_on": ["D01"]}


def _doc(*directions, **change) -> str:
    return json.dumps(_STRICT | {"directions": list(directions)} | change)


#: Documents with places for a source, a language and a number; each breaks another rule, or none.
DIRECTIONS = [
    _doc(_ONE, _TWO), _doc(_ONE), "{", "[@N@]", '"@S@"', "@N@", "null", _doc(_ONE, more=1), '{"directions": []}', _doc(_ONE, schema_version="v@N@"), _doc(_ONE, schema_version=None), _doc(directions="@S@"), _doc(directions={"a": 1}), _doc(),
    _doc("@S@"), _doc(None), _doc(_ONE, 3), _doc({k: v for k, v in _ONE.items() if k != "conditions"}), _doc(_ONE | {"x": 1}), _doc(_ONE | {"id": "D@N@"}), _doc(_ONE | {"id": 1}), _doc(_TWO), _doc(_ONE, _ONE),
    _doc(_ONE | {"action": 5}), _doc(_ONE | {"action": None}), _doc(_ONE | {"action": ""}), _doc(_ONE | {"action": " @S@"}), _doc(_ONE | {"action": "@S@ "}), _doc(_ONE | {"action": "a\nb"}), _doc(_ONE | {"action": "x" * 1995 + "@S@"}), _doc(_ONE | {"action": "x" * 2001}),
    _doc(_ONE | {"conditions": "@S@"}), _doc(_ONE | {"conditions": [f"c{i}" for i in range(65)]}), _doc(_ONE | {"conditions": [None]}), _doc(_ONE | {"conditions": ["ok", " bad"]}), _doc(_ONE | {"conditions": ["a\rb"]}), _doc(_ONE | {"conditions": ["y" * 1001]}), _doc(_ONE | {"conditions": ["@L@", "en"]}),
    _doc(_ONE, _TWO | {"depends_on": None}), _doc(_ONE, _TWO | {"depends_on": ["D02"]}), _doc(_ONE, _TWO | {"depends_on": ["D1"]}), _doc(_ONE, _TWO | {"depends_on": ["D01", "D01"]}), _doc(_ONE, _TWO | {"depends_on": ["D00"]}), _doc(_ONE, _TWO | {"depends_on": ["way too long"]}),
]

#: Answers of a looser format.
LENIENT = [
    '{"directions": [" Read @S@. ", "", 5, null, "Write."], "note": 1}', '{"directions": ["@L@"]}', '{"directions": []}', '{"directions": ["", " "]}', '{"directions": "@S@"}', '{"other": ["@S@"]}', "  plain words about @S@  ", "", " \n ", '["@S@"]', '{"directions": ["' + "z" * 5001 + '", "kept @N@"]}',
    '{"directions": [' + ", ".join(f'"d{i}"' for i in range(201)) + "]}", "{ broken @N@", '{"code": "int @S@ = @N@;"}', '{"code": " a\\r\\nb\\rc = @N@ ; "}', '{"code": "x"}', '{"code": ""}', '{"code": 7}', '{"code": null}', '{"code": "' + "é" * 32_001 + '"}', '{"code": "' + "w " * 2_000 + '"}',
]


def _filled(spark, d, templates):
    made = spark.createDataFrame(list(enumerate(templates)), "k long, t string")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(F.broadcast(made), F.col("doc_id") % len(templates) == F.col("k"))
    filled = F.col("t")
    for mark, c in (("@S@", F.col("source")), ("@L@", F.col("lang")), ("@N@", F.col("n_chars").cast("string"))):
        filled = F.replace(filled, F.lit(mark), c)
    return rows.select("doc_id", filled.alias("raw"))


def direction_documents(spark, d):
    """The first rule that each directions document breaks."""
    return _filled(spark, d, DIRECTIONS).select("doc_id", documents.direction_error(F.col("raw")).alias("code"))


def lenient_documents(spark, d):
    """Lenient directions and code of the same answers, and what is made of an answer that isn't a document."""
    r = _filled(spark, d, LENIENT).select("doc_id", documents.directions_from_output(F.col("raw")).alias("o"), documents.lenient_directions(F.col("raw")).alias("d"), documents.lenient_code(F.col("raw")).alias("c"))
    return r.select("doc_id", F.size("o.directions").alias("n_directions"), F.sha2(F.array_join("o.directions", "\n"), 256).alias("directions_sha256"), F.col("o.error").alias("output_error"), F.col("d.error").alias("directions_error"), F.col("c.error").alias("code_error"), F.length("c.code").alias("n_code"))


def valid_judgments(spark, d):
    """References and judgments made of conversations: turns are intents, roles give statuses."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # a conversation's few turns
    status = F.transform("t", lambda x: F.when(x["role"] == "user", "preserved").when(x["role"] == "assistant", "changed").otherwise("unknown"))
    added = F.transform(F.filter("t", lambda x: x["turn"] % 3 == 1), lambda x: (x["turn"] - F.col("conv_id") % 2 * 2).cast("int"))
    intents = F.transform("t", lambda x: F.when(F.length(x["text"]) % 7 == 0, " ").otherwise(x["text"]))
    return turns.select("conv_id", documents.valid_reference(intents).alias("reference"), documents.valid_judgment(status, F.col("t.text"), added, F.size("t")).alias("judgment"))


QUERIES = {f.__name__: f for f in (direction_documents, lenient_documents, valid_judgments)}


def _filled_sql(templates) -> str:
    values = ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in enumerate(templates))
    return f"r AS (SELECT doc_id, replace(replace(replace(t, '@S@', source), '@L@', lang), '@N@', CAST(n_chars AS VARCHAR)) AS raw FROM documents JOIN (VALUES {values}) v(k, t) ON doc_id % {len(templates)} = k), j AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM r)"


_EDGE = r"[\s\x{A0}\x{1C}-\x{1F}\x{85}]"


def _text_sql(x: str, code: str, most: int) -> str:
    s = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) IS DISTINCT FROM 'VARCHAR' THEN '{code}_not_string' WHEN {s} = '' OR regexp_matches({s}, '^{_EDGE}|{_EDGE}$') THEN '{code}_not_trimmed_nonempty' WHEN regexp_matches({s}, '[\\r\\n\\x00]') THEN '{code}_not_single_line' WHEN length({s}) > {most} THEN '{code}_too_long' END"


def _list_sql(x: str, code: str, items: int, most: int, i: str) -> str:
    each = f"list_transform(range(CAST(json_array_length({x}) AS BIGINT)), lambda {i}: {_text_sql(f'json_extract({x}, {chr(39)}$[{chr(39)} || {i} || {chr(39)}]{chr(39)})', code + '_item', most)})"
    strings = f"from_json({x}, '[\"VARCHAR\"]')"
    return f"CASE WHEN json_type({x}) IS DISTINCT FROM 'ARRAY' THEN '{code}_not_array' WHEN json_array_length({x}) > {items} THEN '{code}_too_many' WHEN len(list_filter({each}, lambda e: e IS NOT NULL)) > 0 THEN list_filter({each}, lambda e: e IS NOT NULL)[1] WHEN len(list_distinct({strings})) <> len({strings}) THEN '{code}_duplicate' END"


_AT = "json_extract(d, '$.{}')"
_DIRECTION_SQL = f"""CASE WHEN json_type(d) IS DISTINCT FROM 'OBJECT' THEN 'direction_not_object' WHEN list_sort(json_keys(d)) <> ['action', 'conditions', 'depends_on', 'id'] THEN 'direction_keys'
WHEN json_type(d, '$.id') <> 'VARCHAR' OR (d ->> '$.id') <> 'D' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') THEN 'direction_id_not_sequential'
ELSE coalesce({_text_sql(_AT.format('action'), 'direction_action', documents.MAX_ACTION)}, {_list_sql(_AT.format('conditions'), 'direction_conditions', documents.MAX_CONDITIONS, documents.MAX_CONDITION, 'k')}, {_list_sql(_AT.format('depends_on'), 'direction_dependencies', documents.MAX_DIRECTIONS, documents.MAX_DEPENDENCY, 'k')},
CASE WHEN len(list_filter(from_json({_AT.format('depends_on')}, '["VARCHAR"]'), lambda x: NOT list_contains(list_transform(range(1, i + 1), lambda n: 'D' || lpad(CAST(n AS VARCHAR), 2, '0')), x))) > 0 THEN 'direction_dependency_not_prior' END) END"""
_Q = text.TOKEN_PATTERN.replace("'", "''")
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_EDGE}+', ''), '{_EDGE}+$', '')"

ORACLE_SQL = {
    "direction_documents": f"""
WITH {_filled_sql(DIRECTIONS)},
e AS (SELECT doc_id, min_by(c, i) FILTER (c IS NOT NULL) AS c FROM (SELECT doc_id, i, {_DIRECTION_SQL} AS c FROM (SELECT doc_id, i, json_extract(v, '$.directions[' || i || ']') AS d FROM (SELECT doc_id, v, unnest(range(CAST(json_array_length(v, '$.directions') AS BIGINT))) AS i FROM j WHERE json_type(v, '$.directions') = 'ARRAY'))) GROUP BY doc_id)
SELECT doc_id, CASE WHEN v IS NULL THEN 'directions_not_json' WHEN json_type(v) <> 'OBJECT' THEN 'directions_document_not_object' WHEN list_sort(json_keys(v)) <> ['directions', 'schema_version'] THEN 'directions_root_keys'
WHEN json_type(v, '$.schema_version') <> 'VARCHAR' OR (v ->> '$.schema_version') <> '{documents.DIRECTIONS_VERSION}' THEN 'directions_schema_version' WHEN json_type(v, '$.directions') <> 'ARRAY' THEN 'directions_not_array'
WHEN json_array_length(v, '$.directions') NOT BETWEEN 1 AND {documents.MAX_DIRECTIONS} THEN 'directions_count_out_of_range' ELSE e.c END AS code FROM j LEFT JOIN e USING (doc_id)""",
    "lenient_documents": f"""
WITH {_filled_sql(LENIENT)},
u AS (SELECT doc_id, list({_STRIP("s")} ORDER BY i) FILTER ({_STRIP("s")} <> '' AND length(s) <= {documents.LENIENT_DIRECTION}) AS ds FROM (SELECT doc_id, i, json_type(v, '$.directions[' || i || ']') AS t, v ->> ('$.directions[' || i || ']') AS s FROM (SELECT doc_id, v, unnest(range(CAST(json_array_length(v, '$.directions') AS BIGINT))) AS i FROM j WHERE json_type(v, '$.directions') = 'ARRAY')) WHERE t = 'VARCHAR' GROUP BY doc_id),
x AS (SELECT doc_id, raw, ds, CASE WHEN v IS NULL THEN 'directions_not_json' WHEN json_type(v) <> 'OBJECT' OR NOT list_contains(json_keys(v), 'directions') THEN 'directions_schema_invalid' WHEN NOT coalesce(len(ds) BETWEEN 1 AND {documents.LENIENT_DIRECTIONS}, false) THEN 'directions_value_invalid' END AS de,
      CASE WHEN v IS NULL THEN 'code_not_json' WHEN json_type(v) <> 'OBJECT' OR NOT list_contains(json_keys(v), 'code') THEN 'code_schema_invalid' WHEN json_type(v, '$.code') <> 'VARCHAR' OR {_STRIP("(v ->> '$.code')")} = '' OR strlen(v ->> '$.code') > {documents.LENIENT_CODE} THEN 'code_value_invalid'
      WHEN len(regexp_extract_all({_STRIP("(v ->> '$.code')")}, '{_Q}')) < {documents.LEAST_TOKENS} THEN 'code_too_short' END AS ce, {_STRIP("regexp_replace((v ->> '$.code'), '[\\r][\\n]?', chr(10), 'g')")} AS code, {_STRIP("raw")} AS whole FROM j LEFT JOIN u USING (doc_id)),
o AS (SELECT *, CASE WHEN de IS NULL THEN ds WHEN whole <> '' AND strlen(whole) <= {documents.LENIENT_TEXT} THEN [whole] END AS out FROM x)
SELECT doc_id, CAST(CASE WHEN out IS NULL THEN NULL ELSE len(out) END AS INTEGER) AS n_directions, sha256(array_to_string(out, chr(10))) AS directions_sha256, CASE WHEN out IS NULL THEN 'directions_text_invalid' END AS output_error, de AS directions_error, ce AS code_error, CAST(CASE WHEN ce IS NULL THEN length(code) END AS INTEGER) AS n_code FROM o""",
    "valid_judgments": """
WITH t AS (SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) % 7 = 0 OR trim(text) = '' OR length(text) > 4000) AS bad, count(*) FILTER (role NOT IN ('user', 'assistant')) AS unknown, count(*) FILTER (turn % 3 = 1) AS a,
count(*) FILTER (turn % 3 = 1 AND (turn - conv_id % 2 * 2 < 0 OR turn - conv_id % 2 * 2 >= m)) AS outside, count(DISTINCT turn) FILTER (turn % 3 = 1) AS d FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id)
SELECT conv_id, n BETWEEN 1 AND 40 AND bad = 0 AS reference, n <= 80 AND unknown = 0 AND d = a AND outside = 0 AS judgment FROM t""",
}
