"""Secret scans: keywords by an Aho-Corasick automaton, an expression anchored at each hit, and checksums where the format has one.

One pass of the automaton over the lower-cased text finds the keywords of all rules.  A rule's expression is
tried at its keywords only, from left to right, and a keyword inside the rule's last match isn't tried, so a
rule's matches are its leftmost non-overlapping ones.  A match that is too short or whose embedded checksum
is wrong is dropped, though it still covers what it matched.  Runs of hexadecimal digits have no keyword;
they are found by a byte-class scan of the same bytes.

Rules of the contract: ``assign``, ``access`` and ``hex``.  The method's own ones all carry a checksum, so that
a look-alike isn't taken for a secret: ``github`` and ``npm`` tokens (CRC-32 in base 62) and ``age`` keys (Bech32).

Null and empty texts have no spans.  Whole texts of any length are searched, in pieces that overlap by a keyword;
keywords and matches never cross rows.  Every row is searched by itself: repeated rows and repeated or null ids get
a result each, an empty table an empty one, and other columns are ignored (``scanned``) or kept (``redacted``).
Spans of different rules may overlap.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import CHUNK, scan, text_chunks

# Digits of base 62 and of Bech32, and the generator of Bech32's checksum.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
AGE_PREFIX = "age-secret-key-"


def base62(n: int, width: int = 6) -> str:
    digits = ""
    while n:
        n, rest = divmod(n, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def crc_holds(match: re.Match) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before, in base 62."""
    return base62(zlib.crc32(match[1])).encode() == match[2]


def bech32_sum(prefix: str, values: list[int]) -> int:
    """The checksum polynomial of a prefix and five-bit values; 1 if the values' last six are right."""
    total = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *values]:
        top = total >> 25
        total = (total & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            total ^= g if top >> i & 1 else 0
    return total


def bech32_holds(match: re.Match) -> bool:
    return bech32_sum(AGE_PREFIX, [BECH32.index(c) for c in match[1].decode().lower()]) == 1


class Rule(NamedTuple):
    """``keywords`` in lower case, each a beginning of what ``pattern`` matches; ``holds`` keeps a match."""

    kind: str
    keywords: tuple[str, ...]
    pattern: bytes
    holds: Callable[[re.Match], bool]


ASSIGN, ACCESS, HEX = "assign", "access", "hex"
BASE = (ASSIGN, ACCESS, HEX)
HEX_LEAST = 24
RULES = (
    Rule(ASSIGN, ("password", "passwd", "secret", "token", "api_key", "apikey"), rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    Rule(ACCESS, ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", crc_holds),
    Rule("npm", ("npm_",), rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", crc_holds),
    Rule("age", ("age-secret-key-1",), rb"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])", bech32_holds),
)
#: The order of kinds that start at one place.
KINDS = (*BASE, *(r.kind for r in RULES if r.kind not in BASE))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_HEX_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))


class Scanner:
    """The automaton of all rules' keywords; made in the task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(re.compile(r.pattern), r.holds) for r in rules]
        self.kinds = [KINDS.index(r.kind) for r in rules]
        owners: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            for k in r.keywords:
                owners[k].append(i)
        self.automaton = ahocorasick.Automaton()
        for k, own in owners.items():
            self.automaton.add_word(k, (len(k), tuple(own)))
        self.automaton.make_automaton()
        self.longest = max(map(len, owners))

    def hits(self, data: np.ndarray, piece: int = CHUNK) -> dict[int, list[int]]:
        """Places of the keywords of each rule, ascending."""
        found: dict[int, list[int]] = defaultdict(list)
        for lo in range(0, len(data), piece):
            letters = data[lo : lo + piece + self.longest - 1].tobytes().lower().decode("latin-1")
            for last, (length, own) in self.automaton.iter(letters):
                at = last - length + 1
                if at < piece:
                    for i in own:
                        found[i].append(lo + at)
        return {i: sorted(at) for i, at in found.items()}

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, kind number, end) in bytes of the row, in order, by row number."""
        raw, found = data.tobytes(), defaultdict(list)
        for i, places in self.hits(data).items():
            (pattern, holds), kind, covered = self.rules[i], self.kinds[i], 0
            rows = np.searchsorted(offsets, places, "right") - 1
            for at, row in zip(places, rows.tolist(), strict=True):
                if at >= covered and (m := pattern.match(raw, at, int(offsets[row + 1]))):
                    covered = m.end()
                    if holds(m):
                        found[row].append((at - int(offsets[row]), kind, m.end() - int(offsets[row])))
        starts, ends, _ = scan(data, offsets, _HEX_DIGIT)
        long = np.flatnonzero(ends - starts >= HEX_LEAST)
        rows = np.searchsorted(offsets, starts[long], "right") - 1
        for k, row in zip(long.tolist(), rows.tolist(), strict=True):
            found[row].append((int(starts[k] - offsets[row]), KINDS.index(HEX), int(ends[k] - offsets[row])))
        return {row: sorted(s) for row, s in found.items()}


def _points(row: np.ndarray, places: set[int]) -> dict[int, int]:
    """Code points before each of some byte places of a row."""
    told, done, points = {}, 0, 0
    for at in sorted(places):
        points += int(np.count_nonzero((row[done:at] & 0xC0) != 0x80))
        done = at
        told[at] = points
    return told


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        told: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for lo, _, data, offsets in text_chunks(batch.column(1)):
            for row, spans in scanner.spans(data, offsets).items():
                points = _points(data[offsets[row] : offsets[row + 1]], {at for s, _, e in spans for at in (s, e)})
                told[lo + row] = [{"kind": KINDS[kind], "start": points[s], "end": points[e]} for s, kind, e in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind)], ["doc_id", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: all secrets found, by start and kind, as (kind, start, end)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scanned, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every secret in ``text`` replaced by its kind in square brackets; overlapping ones by the first one's."""
    at = docs.columns.index("text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts, changed = batch.column(at), {}
            for lo, _, data, offsets in text_chunks(texts):
                for row, spans in scanner.spans(data, offsets).items():
                    raw, out, done = data[offsets[row] : offsets[row + 1]].tobytes(), [], 0
                    for s, kind, e in spans:
                        if s >= done:
                            out += [raw[done:s], b"[", KINDS[kind].encode(), b"]"]
                        done = max(done, e)
                    changed[lo + row] = b"".join([*out, raw[done:]]).decode("utf-8", "replace")
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type))
            yield batch

    return docs.mapInArrow(of_batches, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
