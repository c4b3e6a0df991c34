"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontamination, embeddings, licenses, manifest, mixing, near_duplicates, pages, secrets, suffix_dedup, toxicity, urls, warc

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_pages": pages.op2_pages,
    "op3_licenses": licenses.op3_licenses,
    "op4_urls": urls.op4_urls,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_minhash": near_duplicates.op6_minhash,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
    "op11_secrets": secrets.op11_secrets,
    "op12_centroids": centroids.op12_centroids,
    "op13_manifest": manifest.op13_manifest,
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TEMPLATES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASE_HITS = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    for phrase, label in licenses.PHRASES
)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What a block is, and the character references of the driver's pages; the operator knows all of HTML's.
_BLOCK_TAG = "(?i)</?(article|section|div|p|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|pre)\\b[^>]*>"
_ARTICLE = r"regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*?)(</article>|$)', 1)"
for _out in ("<!--.*?-->", *(f"<{tag}\\b.*?</{tag}>" for tag in ("script", "style", "nav", "aside", "form", "header", "footer"))):
    _ARTICLE = f"regexp_replace({_ARTICLE}, '(?is){_out}', '', 'g')"
_PIECES = f"regexp_replace(regexp_replace(regexp_replace({_ARTICLE}, '(?i)<br[^>]*>', ' ', 'g'), '{_BLOCK_TAG}', chr(1), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _PIECES = f"replace({_PIECES}, '{_name}', '{_char}')"
_PIECES = f"regexp_replace({_PIECES}, '&amp;?', '&', 'g')"

#: CRC-32 as a fold over bytes, with the table of all bytes' remainders; and characters as numbers.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _numbers(text: str, digits: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(strpos('{digits}', substr({text}, i, 1)) - 1 AS BIGINT))"


def _crc32(text: str, table: str) -> str:
    """Of ASCII text."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_PREFIX = [*(ord(c) >> 5 for c in secrets.AGE_PREFIX), 0, *(ord(c) & 31 for c in secrets.AGE_PREFIX)]
_BECH32_STEP = "xor(((t & 33554431) << 5), v)"
for _bit, _g in enumerate(secrets.BECH32_GENERATOR):
    _BECH32_STEP = f"xor({_BECH32_STEP}, CASE WHEN (t >> {25 + _bit}) & 1 = 1 THEN {_g} ELSE 0 END)"
_BECH32 = f"list_reduce(list_prepend(1, list_concat({_PREFIX}, {_numbers('lower(substr(s, 17, 58))', secrets.BECH32)})), lambda t, v: {_BECH32_STEP})"

_ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: The kinds without a checksum: matches stand between marks, so that pieces' lengths give their places.
_BASE_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, string_split(p, chr(57345))[1] AS m, sum(length(p) - (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) - length(p) + (i > 1)::INT AS start, i "
    rf"FROM (SELECT doc_id, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM d))) WHERE i > 1 AND {keep}"
    for k, (kind, pattern, keep) in enumerate(
        (
            ("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6"),
            ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
            ("hex", "[0-9a-f]+", "length(m) >= 24"),
        )
    )
)


def _clusters_sql() -> str:
    """Every round as two tables: the assignment and the centroids after it."""
    distance = "CAST(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS BIGINT)"
    parts = [
        "q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM q ORDER BY c LIMIT {centroids.K})",
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT r, vec_id, v, x.c AS c, x.d AS d FROM (SELECT q.r, q.vec_id, q.v, min(struct_pack(d := {distance}, c := c.c)) AS x FROM q, c{i} c GROUP BY ALL))")
        if i < centroids.ROUNDS:
            parts.append(f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j)")
            parts.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    n = centroids.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{n} a JOIN c{n} c ON a.c = c.c"""


def _levels_sql(name: str, levels: int) -> list[str]:
    """Tables name0 (tree, pos, h) to name{levels}: nodes level by level, a tree that has come to one node staying as it is; and name_p (tree, pos, l, left, rest), each node's siblings on every level."""
    parts, sides = [], []
    for i in range(levels):
        parts.append(f"{name}{i}_n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i})")
        parts.append(f"{name}{i}_g AS (SELECT tree, pos // 16 AS up, n, list(h ORDER BY pos) AS hs FROM {name}{i}_n GROUP BY ALL)")
        parts.append(f"{name}{i + 1} AS (SELECT tree, up AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{i}_g)")
        sides.append(f"SELECT tree, up, {i} AS l, hs FROM {name}{i}_g WHERE n > 1")
    return [*parts, f"{name}_p AS ({' UNION ALL '.join(sides)})"]


_MANIFEST_LEVELS = 6
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = " || ".join(map(_FIELD, manifest.FIELDS[:-1]))
_ROLL = "list_reduce(list_prepend({first}, {sides}), lambda o, s: {{'a': '', 'b': '', 'h': sha256(s.a || o.h || s.b)}}).h"


def _manifest_sql() -> str:
    """Leaves, a tree for each source and one above them; a leaf's siblings come from the runs that it is in, level by level."""
    low, high = _levels_sql("lo", _MANIFEST_LEVELS), _levels_sql("hi", _MANIFEST_LEVELS)
    sides = "list({'a': array_to_string(hs[:own], ''), 'b': array_to_string(hs[own + 2:], ''), 'h': ''} ORDER BY l)"
    place = "CAST((pos // CAST(pow(16, l) AS BIGINT)) % 16 AS BIGINT) AS own"
    joined = lambda name: f"SELECT x.tree, x.pos, {sides} AS path FROM (SELECT p.l, p.hs, n.tree, n.pos, {place.replace('pos //', 'n.pos //', 1)} FROM {name}0 n JOIN {name}_p p ON p.tree = n.tree AND p.up = n.pos // CAST(pow(16, p.l + 1) AS BIGINT)) x GROUP BY x.tree, x.pos"
    altered = _LEAF + " || " + _FIELD(_LOWER_TEXT)
    return f"""
WITH t AS (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_FIELD('text')}) AS h, {_crc32('CAST(doc_id AS VARCHAR)', 't.crc')} % 5 = 0 AS chosen, sha256({altered}) AS altered FROM documents, t),
lo0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS pos FROM d),
{", ".join(low)},
hi0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, tree AS grp, h FROM lo{_MANIFEST_LEVELS}),
{", ".join(high)},
lp AS ({joined("lo")}), hp AS ({joined("hi")}),
f AS (SELECT d.doc_id, d.h AS leaf, g.h AS subroot, r.h AS root, list_concat(coalesce(lp.path, []), coalesce(hp.path, [])) AS path, CASE WHEN d.chosen THEN d.altered ELSE d.h END AS own
      FROM lo0 d JOIN hi0 g ON g.grp = d.tree CROSS JOIN hi{_MANIFEST_LEVELS} r LEFT JOIN lp ON lp.tree = d.tree AND lp.pos = d.pos LEFT JOIN hp ON hp.pos = g.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.a || s.b), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, {_ROLL.format(first="{'a': '', 'b': '', 'h': own}", sides="path")} AS folded_root FROM f)"""


_LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_pages": rf"""
WITH b AS (SELECT page_id, url, list_filter(list_transform(string_split({_PIECES}, chr(1)), lambda x: trim(regexp_replace(x, '[\s\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '') AS b FROM pages),
t AS (SELECT page_id, url, array_to_string(b, chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t""",
    "op1_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op3_licenses": rf"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
hits AS ({_PHRASE_HITS}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
t AS (SELECT k, label, list_distinct(regexp_extract_all(lower(text), '{_WORDS}')) AS tw FROM (VALUES {_TEMPLATES}) AS x(k, label, text)),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(block, '{_WORDS}')) AS bw FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])([\x20\x09-\x0D])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS block FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(bw, tw)) / len(tw)::DOUBLE AS share FROM b, t WHERE len(bw) > 0 AND len(list_intersect(bw, tw)) >= ceil({licenses.CONTAINMENT} * len(tw) - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
late AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM late),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, g),
cuts AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
          FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)""",
    "op6_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' '), least(len(w), 5)) AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_secrets": rf"""
WITH t AS (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
places AS (SELECT doc_id, start, substr(t, CAST(start + 1 AS BIGINT), 75) AS s FROM (SELECT doc_id, t, unnest(range(0, length(t))) AS start FROM d WHERE regexp_matches(t, 'gh[pousr]_|npm_|AGE-SECRET-KEY-1'))),
sealed AS (SELECT doc_id, 3 + (s[1:1] = 'n')::INT AS k, CASE WHEN s[1:1] = 'n' THEN 'npm' ELSE 'github' END AS kind, start, start + 40 AS stop FROM places, t
           WHERE regexp_matches(s, '^(gh[pousr]|npm)_[0-9A-Za-z]{{36}}([^0-9A-Za-z]|$)') AND {_crc32("substr(s, 5, 30)", "crc")} = list_reduce({_numbers("substr(s, 35, 6)", secrets.BASE62)}, lambda a, b: 62 * a + b)
           UNION ALL SELECT doc_id, 5, 'age', start, start + 74 FROM places WHERE regexp_matches(s, '^AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{{58}}([^0-9A-Z]|$)') AND {_BECH32} = 1),
spans AS (SELECT doc_id, k, kind, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM ({_BASE_SPANS} UNION ALL SELECT * FROM sealed)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)""",
    "op12_centroids": _clusters_sql(),
    "op13_manifest": _manifest_sql(),
}
