"""The attempt ledger as a stream: the first valid attempt of every cell, and failure rates in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import new_folder


def first_valid_stream(attempts: DataFrame, cell: list[str], attempt: str, valid: str) -> DataFrame:
    """Streaming (cell..., attempts, selected_attempt), updated as attempts arrive; state is one row a cell."""
    return attempts.groupBy(*cell).agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col(valid), F.col(attempt))).alias("selected_attempt"))


class Attempts(StatefulProcessor):
    """State of a cell: its attempts so far by number, until it is decided; then only that it is.

    A cell is ``selected`` by its first valid attempt once all earlier ones have come, ``blocked`` once the first ``cap``
    have come and none is valid, and ``expired`` if nothing has decided it ``wait_ms`` after its latest attempt (by
    event time).  Each is told once.  An attempt that comes again counts as valid only if all its copies are; what
    comes after the decision changes nothing.
    """

    def __init__(self, cap: int, wait_ms: int | None) -> None:
        self.cap, self.wait_ms = cap, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "attempt bigint", "valid boolean")
        self.done = handle.getValueState("done", "done boolean")
        self.latest = handle.getValueState("latest", "ms bigint")

    def _told(self, key: tuple, status: str, attempt: int | None, n: int) -> pd.DataFrame:
        self.done.update((True,))
        self.seen.clear()
        for at in list(self.handle.listTimers()) if self.wait_ms is not None else []:
            self.handle.deleteTimer(at)
        return pd.DataFrame({"cell": [key[0]], "status": [status], "selected_attempt": pd.array([attempt], dtype="Int64"), "attempts": [n]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        decided, latest = self.done.exists(), self.latest.get()[0] if self.latest.exists() else None
        for batch in rows:
            if decided:
                continue
            for attempt, valid, ms in zip(batch["attempt"].tolist(), batch["valid"].tolist(), batch["ms"].tolist(), strict=True):
                if attempt != attempt or attempt is None:
                    continue
                before = self.seen.getValue((int(attempt),))[0] if self.seen.containsKey((int(attempt),)) else True
                self.seen.updateValue((int(attempt),), (bool(before and valid),))
                latest = ms if latest is None or ms > latest else latest
        if decided:
            return
        known = {k[0]: v[0] for k, v in self.seen.iterator()}
        for n in range(1, self.cap + 1):
            if n not in known:
                break
            if known[n]:
                yield self._told(key, "selected", n, len(known))
                return
        else:
            yield self._told(key, "blocked", None, len(known))
            return
        if self.wait_ms is not None and latest is not None:
            self.latest.update((int(latest),))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(latest) + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.done.exists():
            yield self._told(key, "expired", None, sum(1 for _ in self.seen.keys()))

    def close(self) -> None:
        pass


def decided_cells(attempts: DataFrame, cell: str, attempt: str, valid: str, cap: int, at: str | None = None, wait_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Streaming (cell, status, selected_attempt, attempts): each cell once, when its attempts decide it, in append mode.

    Attempts may come late, repeated and out of order.  With ``at`` and ``wait_ms``, cells that stay open are told as expired
    when the watermark (``late`` behind) has passed their latest attempt by that much.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = attempts.select(F.col(cell).cast("string").alias("cell"), F.col(attempt).cast("long").alias("attempt"), F.coalesce(F.col(valid), F.lit(False)).alias("valid"), (F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")).alias("at"))
    if at:
        rows = rows.withWatermark("at", late)
    rows = rows.withColumn("ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    timed = at is not None and wait_ms is not None
    return rows.groupBy("cell").transformWithStateInPandas(Attempts(cap, wait_ms if timed else None), "cell string, status string, selected_attempt bigint, attempts bigint", "Append", "EventTime" if timed else "None")


def decisions(attempts: DataFrame, cell: str, attempt: str, valid: str, cap: int) -> DataFrame:
    """Streaming (cell, status, selected_attempt) in update mode: the cells that their attempts so far decide, by the rules of :class:`Attempts`.

    State is a flag for each of the first ``cap`` attempts of a cell, kept by Spark's own aggregate, so no cell is a call of
    Python.  A decided cell is told again when more of its attempts come; the first telling counts (:func:`drained` with ``key``).
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ok = F.coalesce(F.col(valid), F.lit(False))
    flags = attempts.groupBy(F.col(cell).alias("cell")).agg(*[F.bool_and(F.when(F.col(attempt) == n, ok)).alias(f"_{n}") for n in range(1, cap + 1)])
    failed, selected = F.lit(True), F.lit(None).cast("long")
    for n in range(1, cap + 1):
        selected = F.coalesce(selected, F.when(failed & F.col(f"_{n}"), F.lit(n).cast("long")))
        failed = failed & ~F.col(f"_{n}")
    status = F.when(selected.isNotNull(), "selected").when(failed, "blocked")
    return flags.select("cell", status.alias("status"), selected.alias("selected_attempt")).filter("status IS NOT NULL")


def window_rates(events: DataFrame, at: str, failed, size: str, late: str) -> DataFrame:
    """Events and failures per tumbling window, late rows accepted within the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("failed"))


def drained(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """Runs a stream over what its source has now and gives the sink's rows: of the last batch in complete mode, of all in append mode, and in update mode the first one of each ``key``.

    Rows go to Parquet in the shared folder, with the stream's checkpoint beside them; none go to the driver.
    """
    spark: SparkSession = stream.sparkSession
    folder = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row
    if mode == "update":
        others = [c for c in stream.columns if c != key]
        return rows.groupBy(key).agg(F.min_by(F.struct(*others), "batch").alias("_first")).select(key, "_first.*")
    return rows.drop("batch")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream.  The file source reads folders or globs, so a single file is named by a glob."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")
