"""URL filter: allow and block rules, and a character language-model ratio for what no rule fits.

Two variable-order Markov models over the characters of host, path and the rest are counted, one on
URLs that rules accept and one on URLs that they reject.  Each order is smoothed with the next lower
one, down to a uniform character.  A URL's score is the difference of its log-likelihoods divided by
its length; it is blocked above a threshold at which, on rule-judged URLs kept out of the counts,
both kinds err equally often.

Counts cover all rule-judged URLs.  They are exact, in a table of (context, character) runs that
grows with the input.  An order's probabilities are joined to those of the next lower one by run; a
run has at most 257 longer ones, so no key is hot.  URLs are stored in chunks; a chunk's distinct
runs are joined to the model and come back to its URLs, so nothing of the model is broadcast.

Null URLs and those without ``://`` have an empty host and path, fit no rule and are allowed; so is
everything else without a rule while one of the two kinds has no URLs to learn from; equal URLs get
equal verdicts; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .words import text_chunks

#: (verdict, host, path); a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 4
#: How many counts of a lower order weigh as much as one context, and bits of a character in a run.
TRUST, BITS = 4.0, 9
#: Bytes of URLs whose runs are looked up together.
CHUNK = 1 << 18
#: Of every so many rule-judged URLs, one is kept for calibration.
FOLDS = 5
BINS, BIN = 4001, 0.005


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the longest fitting rule and its verdict, null if none fits."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def _texts(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each character, its run).

    A run is a character and the ORDER before it, the character in the lowest bits; a byte is 1 to 256, and
    0 stands for what is missing at a URL's beginning.  Its low k + 1 characters are the run of order k.
    """
    for lo, hi, data, offsets in text_chunks(column):
        n = np.diff(offsets)
        row = np.repeat(np.arange(hi - lo), n)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], n)
        own = data.astype(np.int64) + 1
        run = own.copy()
        for k in range(1, ORDER + 1):
            before = np.zeros(len(data), dtype=np.int64)
            before[k:] = own[:-k]
            before[place < k] = 0
            run |= before << (BITS * k)
        yield lo, hi, row, run


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, _, _ in text_chunks(_texts(batch, "said"), CHUNK):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(hi - lo, number))], [*part.schema.names, "chunk"])
            number += 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, run, allow, block): distinct runs of each chunk, and how often they stand in URLs to learn from."""
    for batch in batches:
        chunk = _texts(batch, "chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(begin, end - begin)
            learn = ~_texts(part, "aside").to_numpy(zero_copy_only=False)
            ruled = _texts(part, "ruled").to_numpy(zero_copy_only=False)
            for lo, _, row, run in _runs(_texts(part, "said")):
                runs, at = np.unique(run, return_inverse=True)
                n = [np.bincount(at, weights=(learn & (ruled == kind))[lo + row], minlength=len(runs)).astype(np.int64) for kind in ("allow", "block")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), chunk[begin])), pa.array(runs), *map(pa.array, n)], ["chunk", "run", "allow", "block"])


def model(counts: DataFrame) -> DataFrame:
    """(run, ratio) of every run in ``counts`` (run, allow, block): log-likelihood of the rejected model less that of the accepted one."""
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.col("run").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("run")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = Window.partitionBy(F.shiftright("run", BITS))  # 257 rows at most
        own = own.withColumns({f"{kind}_context": F.sum(kind).over(context) for kind in ("allow", "block")})
        if k:
            own = own.withColumn("shorter", F.col("run").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(lower, "shorter")
        else:
            own = own.withColumns({f"{kind}_p": F.lit(1 / 256) for kind in ("allow", "block")})
        p = [((F.col(kind) + TRUST * F.col(f"{kind}_p")) / (F.col(f"{kind}_context") + TRUST)).alias(f"{kind}_p") for kind in ("allow", "block")]
        lower = own.select(F.col("run").alias("shorter"), *p)
    return lower.select(F.col("shorter").alias("run"), (F.log("block_p") - F.log("allow_p")).alias("ratio"))


def _scored(rows: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk's rows with their score: the mean of their characters' ratios."""
    runs, ratios = found.column("run").to_numpy(), found.column("ratio").to_numpy()
    order = np.argsort(runs, kind="stable")
    runs, ratios = runs[order], ratios[order]
    out = np.zeros(rows.num_rows)
    for lo, hi, row, run in _runs(_texts(rows, "said")):
        total = np.bincount(row, weights=ratios[np.searchsorted(runs, run)], minlength=hi - lo)
        out[lo:hi] = total / np.maximum(1, np.bincount(row, minlength=hi - lo))
    return rows.drop_columns(["said", "chunk"]).append_column("score", pa.array(out))


def scored(ruled: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, ruled, aside, score) of :func:`with_rules` rows; ``score`` is null while a kind has nothing to learn from."""
    said = F.when(F.contains(F.col("url"), F.lit("://")), F.regexp_replace("url", r"(?s)^.*?://", "")).otherwise("")
    aside = F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0)
    rows = ruled.select("page_id", "host", "path", "rule", "ruled", aside.alias("aside"), said.alias("said"))
    kinds = f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string, aside boolean"
    rows = stored(rows.mapInArrow(_chunked, f"{kinds}, said string, chunk bigint"), "urls")
    runs = stored(rows.mapInArrow(_counted, "chunk bigint, run bigint, allow bigint, block bigint"), "url-runs")
    counts = stored(runs.groupBy("run").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-counts")
    if not all(counts.agg(F.sum("allow"), F.sum("block")).first()):
        return rows.drop("said", "chunk").withColumn("score", F.lit(None).cast("double"))
    found = runs.select("chunk", "run").join(model(counts), "run").select("chunk", "run", "ratio")
    return stored(rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scored, f"{kinds}, score double"), "url-scores")


def threshold(rows: DataFrame) -> float:
    """Where both kinds of the rule-judged URLs kept aside err equally often; 0 while a kind has none."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.rint(F.col("score") / BIN).cast("long") + BINS // 2))
    tally = np.zeros((2, BINS), dtype=np.int64)
    for r in rows.filter("aside AND score IS NOT NULL").groupBy((F.col("ruled") == "block").cast("int").alias("kind"), place.alias("bin")).count().collect():
        tally[r["kind"], r["bin"]] = r["count"]
    if not tally[0].any() or not tally[1].any():
        return 0.0
    wrongly_blocked = 1 - np.cumsum(tally[0]) / tally[0].sum()  # of accepted ones, above each bin
    wrongly_allowed = np.cumsum(tally[1]) / tally[1].sum()
    gap = np.abs(wrongly_blocked - wrongly_allowed) + wrongly_blocked + wrongly_allowed
    best = np.flatnonzero(gap == gap.min())
    return float((best[len(best) // 2] - BINS // 2 + 0.5) * BIN)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` is null without a model."""
    rows = scored(with_rules(pages, rules))
    own = F.when(F.col("score") > F.lit(threshold(rows)), "block").otherwise("allow")
    own = F.when((F.col("host") == "") & (F.col("path") == ""), "allow").otherwise(own)  # a URL that says nothing, whatever the threshold
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages`` URLs."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
