"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs with one word between them.  The
model is trained one example at a time with per-coordinate rates and L1 sparsity; what is left of the
2**20 weights is small enough to broadcast (its size is checked).  Whole texts are scored, in Spark's
tasks.  Only the text is an input of a score.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows, those with the least hash of the
id, as far as they hold ``MOST_FEATURES`` features together.  All features of a row are learned from.  Null and empty texts have no features and score as the bias alone; rows with a null id or label
are never learned from; an id with several texts has all of them learned from, each once, within ``SAMPLE``; repeated labels of an id count once, toxic if any says so; without labelled
rows every score is the prior of an untrained model, below 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, hashes, mixed, scan, text_chunks

BITS = 20
#: Labelled rows that are learned from at most.
SAMPLE = 8_000
#: Features that these rows hold together at most (4 bytes each); the first row is always taken.
MOST_FEATURES = 1 << 26
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
#: Weights that may be broadcast at most (12 bytes each).
MOST_WEIGHTS = 1 << BITS

_SHIFT = np.uint64(64 - BITS)
_GAPS = ((1, np.uint64(0x9E6C63D0876A9A47)), (2, np.uint64(0xC2B2AE3D27D4EB4F)))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each feature, feature) of a text column, chunk by chunk; features may repeat."""
    for lo, hi, data, offsets in text_chunks(column):
        starts, ends, first = scan(data, offsets, ALNUM)
        h = hashes(data, starts, ends)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        rows, found = [row], [h >> _SHIFT]
        for gap, salt in _GAPS:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            found.append(mixed(h[:-gap] * salt + h[gap:])[same] >> _SHIFT)
        yield lo, hi, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [b""] * batch.num_rows
        for lo, hi, row, feature in features(batch.column(2)):
            pairs = np.unique((row << BITS) | feature)
            cuts = np.searchsorted(pairs >> BITS, np.arange(hi - lo + 1))
            own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            for i in range(hi - lo):
                lists[lo + i] = own[cuts[i] : cuts[i + 1]].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], ["place", "toxic", "features"])


class FTRL:
    """Follow-the-regularised-leader with per-coordinate rates; the bias isn't regularised."""

    def __init__(self, size: int = 1 << BITS) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA)

    def learn(self, i: np.ndarray, y: int) -> None:
        w, b = self.weights(i), self.bias
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += g * g


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["place", "toxic", "features"], kind="stable")
    examples = [(np.frombuffer(f, dtype=np.int32), int(y)) for f, y in zip(rows["features"], rows["toxic"], strict=True)]
    model = FTRL()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[k])
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "weight": [w[at].tobytes()], "bias": [model.bias]})


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learned from labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy(F.col("doc_id").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("place", F.xxhash64("known_id")).orderBy("place", "known_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), F.col("doc_id") == F.col("known_id")).withColumn("said", F.xxhash64("text"))  # at most `sample` rows of three numbers
    # an id may have rows with different texts: its texts count once each, and rows as a whole are bounded
    first = chosen.select("place", "said").distinct().orderBy("place", "said").limit(sample).withColumnsRenamed({"place": "first_place", "said": "first_said"})
    chosen = chosen.join(F.broadcast(first), (F.col("place") == F.col("first_place")) & (F.col("said") == F.col("first_said"))).dropDuplicates(["place", "said"])
    examples = chosen.select("place", "toxic", "text").mapInArrow(_examples, "place bigint, toxic int, features binary")
    before = Window.orderBy("place", "toxic", "features").rowsBetween(Window.unboundedPreceding, -1)  # at most `sample` rows
    examples = examples.withColumn("before", F.coalesce(F.sum(F.octet_length("features")).over(before), F.lit(0))).filter(F.col("before") < 4 * MOST_FEATURES).drop("before")
    found = examples.groupBy().applyInPandas(_fit, "at binary, weight binary, bias double").collect()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0), -1.0
    return np.frombuffer(found[0]["at"], dtype=np.int32), np.frombuffer(found[0]["weight"]), found[0]["bias"]


def _scores(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(column), bias)
    for lo, hi, row, feature in features(column):
        on = table[feature] != 0
        pairs = np.unique((row[on] << BITS) | feature[on])
        out[lo:hi] += np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _shared_table(docs: DataFrame, model):
    at, weight, bias = model
    if len(at) > MOST_WEIGHTS:
        raise ValueError("more weights than may be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((at, weight, bias))

    def load() -> tuple[np.ndarray, float]:
        at, weight, bias = shared.value
        table = np.zeros(1 << BITS)
        table[at] = weight
        return table, bias

    return load


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    load = _shared_table(docs, model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = load()
        for batch in batches:
            s = _scores(batch.column(2), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(of_batches, schema)


def without_toxic(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    load, at = _shared_table(docs, model), docs.columns.index("text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = load()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), table, bias) < 0.5))

    return docs.mapInArrow(of_batches, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
