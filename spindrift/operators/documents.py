"""Nested documents: intent judgments, directions and generated code: validation and features."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_PATTERN, tokens

# Limits and schema names of the document formats.
DIRECTIONS_VERSION, CODE_VERSION = "implementation-directions-v1", "regenerated-code-v1"
MAX_DIRECTIONS, MAX_ACTION, MAX_CONDITIONS, MAX_CONDITION, MAX_DEPENDENCY = 999, 2000, 64, 1000, 8
STATUSES = ("preserved", "changed", "lost")
#: A key of a JSON text.  Without a repeated group, which would overflow the stack on long strings; keys with quotes in them don't match.
KEY = r'"([^"]*+)"\s*+:'


def intent_metrics(statuses: Column, code_intents: Column, added: Column) -> Column:
    """Counts and rates of one judgment; F1 of weighted preservation and 1 - addition rate."""
    count = lambda s: F.size(F.filter(statuses, lambda x: x == s))
    n, codes, adds = F.size(statuses), F.size(code_intents), F.size(added)
    kept, changed, lost = count("preserved"), count("changed"), count("lost")
    weighted = (kept + 0.5 * changed) / F.nullif(n, F.lit(0))
    addition = F.coalesce(F.try_divide(adds, codes), F.lit(0.0))
    precision = 1 - addition
    f1 = F.when(weighted.isNotNull(), F.coalesce(F.try_divide(2 * weighted * precision, weighted + precision), F.lit(0.0)))
    rate = lambda c: F.try_divide(c, n)
    return F.struct(
        n.alias("reference_intent_count"), codes.alias("code_intent_count"), kept.alias("preserved_count"), changed.alias("changed_count"), lost.alias("lost_count"), adds.alias("added_count"),
        rate(kept).alias("strict_preservation_rate"), weighted.alias("weighted_preservation_rate"), rate(changed).alias("change_rate"), rate(lost).alias("loss_rate"),
        addition.alias("addition_rate"), f1.alias("intent_fidelity_f1"),
    )


def valid_reference(intents: Column) -> Column:
    """1 to 40 non-blank intents of at most 4,000 characters."""
    return F.coalesce((F.size(intents).between(1, 40)) & F.forall(intents, lambda x: x.isNotNull() & (F.trim(x) != "") & (F.length(x) <= 4000)), F.lit(False))


def valid_judgment(statuses: Column, code_intents: Column, added: Column, references: Column) -> Column:
    """At most 80 code intents; one known status a reference; added indices distinct and in range."""
    ok = (F.size(code_intents) <= 80) & (F.size(statuses) == references) & F.forall(statuses, lambda s: s.isin(*STATUSES))
    return F.coalesce(ok & (F.size(F.array_distinct(added)) == F.size(added)) & F.forall(added, lambda i: (i >= 0) & (i < F.size(code_intents))), F.lit(False))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def direction_features(directions: Column) -> Column:
    """The fourteen features of an array of (id, action, conditions, depends_on) directions."""
    total = lambda x, zero=0: F.aggregate(x, F.lit(zero).cast("long"), lambda a, b: a + b)
    n = F.size(directions)
    action_words = F.transform(directions, lambda d: words(d["action"]).cast("long"))
    action_chars = F.transform(directions, lambda d: F.length(d["action"]).cast("long"))
    conditions = F.flatten(F.transform(directions, lambda d: d["conditions"]))
    edges = F.flatten(F.transform(directions, lambda d: d["depends_on"]))
    fan_out = F.transform(directions, lambda d: F.size(F.filter(edges, lambda e: e == d["id"])))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))

    def deeper(known: Column, d: Column) -> Column:
        above = F.array_max(F.transform(d["depends_on"], lambda x: F.element_at(known, x)))
        return F.map_concat(known, F.create_map(d["id"], F.coalesce(above + 1, F.lit(0))))

    depth = F.array_max(F.map_values(F.aggregate(directions, empty, deeper)))
    possible = n * (n - 1) / 2
    return F.struct(
        n.alias("instruction_count"), total(action_words).alias("action_word_count_total"), (total(action_words) / n).alias("action_word_count_mean"), F.array_max(action_words).alias("action_word_count_max"),
        total(action_chars).alias("action_character_count_total"), (total(action_chars) / n).alias("action_character_count_mean"),
        F.size(conditions).alias("condition_count"), (F.size(conditions) / n).alias("condition_density"), total(F.transform(conditions, lambda c: words(c).cast("long"))).alias("condition_word_count_total"),
        F.size(edges).alias("dependency_edge_count"), F.coalesce(F.try_divide(F.size(edges), possible), F.lit(0.0)).alias("dependency_edge_density"),
        depth.alias("dependency_max_depth"), F.array_max(fan_out).alias("dependency_max_fan_out"), (F.size(edges) / n).alias("dependency_mean_fan_out"),
    )


# Checks on VARIANT values.  A rule is a code and a condition that must hold; the first broken one is told.


def _type(v: Column) -> Column:
    """``STRING``, ``OBJECT<...``, ``ARRAY<...``, ``VOID`` for a JSON null, and so on."""
    return F.schema_of_variant(v)


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _first_broken(rules: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The code of the first rule that doesn't hold (a null counts as not), else ``otherwise``."""
    told = F.lit(None).cast("string") if otherwise is None else otherwise
    for code, holds in reversed(rules):
        told = F.when(~F.coalesce(holds, F.lit(False)), code).otherwise(told)
    return told


def _first(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


def _trimmed(s: Column) -> Column:
    return ~s.rlike(r"(?Us)^[\s\x1c-\x1f]|[\s\x1c-\x1f]\z")


def _text_rules(v: Column, code: str, most: int) -> list[tuple[str, Column]]:
    s = _get(v, "string")
    return [
        (f"{code}_not_string", _type(v) == "STRING"), (f"{code}_not_trimmed_nonempty", (s != "") & _trimmed(s)),
        (f"{code}_not_single_line", ~s.rlike(r"[\r\n\x00]")), (f"{code}_too_long", F.length(s) <= most),
    ]


def _list_error(v: Column, code: str, items: int, most: int) -> Column:
    xs = _get(v, "array<variant>")
    strings = _get(v, "array<string>")
    inside = _first(F.transform(xs, lambda x: _first_broken(_text_rules(x, f"{code}_item", most))))
    rules = [(f"{code}_not_array", xs.isNotNull()), (f"{code}_too_many", F.size(xs) <= items)]
    return _first_broken(rules, F.coalesce(inside, F.when(F.size(F.array_distinct(strings)) != F.size(strings), f"{code}_duplicate")))


def _keys(v: Column) -> Column:
    return F.array_sort(F.map_keys(_get(v, "map<string,variant>")))


def _has_keys(v: Column, *keys: str) -> Column:
    return _keys(v) == F.array(*map(F.lit, sorted(keys)))


def _one_direction(d: Column, i: Column) -> Column:
    """Ids count up from D01, so what may be depended on are the ids below the direction's own."""
    own = F.format_string("D%02d", (i + 1).cast("int"))
    number = lambda x: F.substring(x, 2, 9).try_cast("int")
    prior = lambda x: F.coalesce((F.format_string("D%02d", number(x)) == x) & number(x).between(1, i), F.lit(False))
    texts = F.coalesce(
        _first_broken(_text_rules(_get(d, "variant", "$.action"), "direction_action", MAX_ACTION)),
        _list_error(_get(d, "variant", "$.conditions"), "direction_conditions", MAX_CONDITIONS, MAX_CONDITION),
        _list_error(_get(d, "variant", "$.depends_on"), "direction_dependencies", MAX_DIRECTIONS, MAX_DEPENDENCY),
        F.when(F.exists(_get(d, "array<string>", "$.depends_on"), lambda x: ~prior(x)), "direction_dependency_not_prior"),
    )
    rules = [("direction_not_object", _type(d).startswith("OBJECT")), ("direction_keys", _has_keys(d, "id", "action", "conditions", "depends_on")), ("direction_id_not_sequential", (_type(_get(d, "variant", "$.id")) == "STRING") & (_get(d, "string", "$.id") == own))]
    return _first_broken(rules, texts)


def direction_error(raw: Column) -> Column:
    """The code of the first rule that a directions document breaks; null if it is sound.

    JSON is taken strictly: a repeated key or NaN makes the text no JSON.
    """
    v = F.try_parse_json(raw)
    items = _get(v, "array<variant>", "$.directions")
    version = _get(v, "variant", "$.schema_version")
    rules = [
        ("directions_not_json", v.isNotNull()), ("directions_document_not_object", _type(v).startswith("OBJECT")), ("directions_root_keys", _has_keys(v, "schema_version", "directions")),
        ("directions_schema_version", (_type(version) == "STRING") & (_get(version, "string") == DIRECTIONS_VERSION)), ("directions_not_array", items.isNotNull()), ("directions_count_out_of_range", F.size(items).between(1, MAX_DIRECTIONS)),
    ]
    return _first_broken(rules, _first(F.transform(items, _one_direction)))


def code_error(raw: Column) -> Column:
    """The code of the first rule that a generated-code document breaks; null if it is sound."""
    v = F.try_parse_json(raw)
    at = lambda key: _get(v, "variant", f"$.{key}")
    is_text = lambda key, value: (_type(at(key)) == "STRING") & (_get(v, "string", f"$.{key}") == value)
    code = _get(v, "string", "$.code")
    return _first_broken([
        ("regenerated_not_json", v.isNotNull()), ("regenerated_document_not_object", _type(v).startswith("OBJECT")), ("regenerated_root_keys", _has_keys(v, "schema_version", "language", "code")),
        ("regenerated_schema_version", is_text("schema_version", CODE_VERSION)), ("regenerated_language", is_text("language", "java")),
        ("regenerated_code_empty", (_type(at("code")) == "STRING") & code.rlike(r"(?U)[^\s\x1c-\x1f]")), ("regenerated_code_nul", ~code.rlike(r"\x00")), ("regenerated_code_not_trimmed", _trimmed(code)),
    ])


# Limits of the lenient formats.
LENIENT_DIRECTION, LENIENT_DIRECTIONS, LENIENT_CODE, LENIENT_TEXT, LEAST_TOKENS = 5000, 200, 64_000, 128_000, 3


def _stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?Us)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def lenient_directions(raw: Column) -> Column:
    """(directions, error) of a looser document: the usable strings of its list, trimmed; others are passed over."""
    v = F.try_parse_json(raw)
    items = _get(v, "array<variant>", "$.directions")
    texts = F.filter(F.transform(F.filter(items, lambda x: _type(x) == "STRING"), lambda x: _get(x, "string")), lambda s: (_stripped(s) != "") & (F.length(s) <= LENIENT_DIRECTION))
    error = _first_broken([("directions_not_json", v.isNotNull()), ("directions_schema_invalid", F.coalesce(F.array_contains(_keys(v), "directions"), F.lit(False))), ("directions_value_invalid", F.size(texts).between(1, LENIENT_DIRECTIONS))])
    return F.struct(F.when(error.isNull(), F.transform(texts, _stripped)).alias("directions"), error.alias("error"))


def directions_from_output(raw: Column) -> Column:
    """(directions, error) of a model's answer: its lenient document, else the whole answer as one direction."""
    found, whole = lenient_directions(raw), _stripped(raw)
    usable = (whole != "") & (F.octet_length(whole) <= LENIENT_TEXT)
    return F.struct(F.when(found["error"].isNull(), found["directions"]).when(usable, F.array(whole)).alias("directions"), F.when(found["error"].isNotNull() & ~F.coalesce(usable, F.lit(False)), "directions_text_invalid").alias("error"))


def lenient_code(raw: Column) -> Column:
    """(code, error) of a looser document: its code with line feeds only, trimmed, of at least three tokens."""
    v = F.try_parse_json(raw)
    code = _get(v, "string", "$.code")
    clean = _stripped(F.regexp_replace(code, "\r\n?", "\n"))
    error = _first_broken([
        ("code_not_json", v.isNotNull()), ("code_schema_invalid", F.coalesce(F.array_contains(_keys(v), "code"), F.lit(False))),
        ("code_value_invalid", (_type(_get(v, "variant", "$.code")) == "STRING") & (_stripped(code) != "") & (F.octet_length(code) <= LENIENT_CODE)), ("code_too_short", F.size(tokens(clean)) >= LEAST_TOKENS),
    ])
    return F.struct(F.when(error.isNull(), clean).alias("code"), error.alias("error"))


def recover_json(raw: str | None):
    """The first JSON object in a model's answer: plain, fenced, or the first object that parses."""
    text = (raw or "").strip()
    fence = re.match(r"^```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", text, re.S)
    for candidate in (text, fence[1] if fence else None):
        if candidate is None:
            continue
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def recovered_json(raw: pd.Series) -> pd.Series:
    """Canonical JSON of the recovered object; null if there is none."""
    found = raw.map(recover_json)
    return found.map(lambda x: None if x is None else canonical_json(x))


def canonical_json(value, newline: bool = False) -> str:
    """Sorted keys, no spaces, no NaN; the artifact flavour ends with a line feed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n" * newline


def isolated(payload: Column, code: Column, forbidden: list[str]) -> Column:
    """Whether a payload holds neither the code, its digest nor a forbidden key at any depth."""
    keys = F.regexp_extract_all(F.lower(payload), F.lit(KEY), F.lit(1))
    return ~F.contains(payload, code) & ~F.contains(payload, F.sha2(code, 256)) & ~F.arrays_overlap(keys, F.array(*[F.lit(k.lower()) for k in forbidden]))
