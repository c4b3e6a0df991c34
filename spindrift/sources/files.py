"""Readers and writers: records with asserted shape, file trees, and write-once outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merkle
from ..operators.cohort import CohortError, last_wins, require_none
from . import digests

#: Longer files are hashed by ranges.
WHOLE_BYTES = 32 << 20

# Patterns of secrets that must not be published.
SECRET_PATTERNS = {
    "authorization_bearer": r"(?i)\bauthorization\s*:\s*bearer\s+[^\s\"']{8,}",
    "private_key_block": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "provider_secret_literal": r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,}",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{16,}",
}


def read_evaluations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV rows as strings with a source index (file order); every needed column must be in the header."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    if missing := [c for c in columns if c not in names]:
        raise CohortError("missing_columns:" + ",".join(missing))
    rows = raw.select(*[F.col(f"`{names[c]}`").alias(c) for c in columns])
    return rows.withColumn("evaluation_index", F.monotonically_increasing_id())


def read_tsv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """All rows of a TSV, or one a key, the last in file order."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("multiLine", True).csv(path)
    return last_wins(rows.withColumn("_i", F.monotonically_increasing_id()), [key], "_i").drop("_i") if key else rows


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; one that can't be parsed is an error."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def unique_map(df: DataFrame, key: str, value: str, expected: int | None = None) -> DataFrame:
    """(key, value) rows of which no key may repeat."""
    rows = df.select(key, value)
    require_none(rows.groupBy(key).count().filter("count > 1"), f"duplicate_{key}")
    if expected is not None and rows.count() != expected:
        raise CohortError(f"unexpected_{key}_count")
    return rows


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of files without bytes, which Spark's readers leave out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(top, True)
    found, depth = [], top.depth()
    while listed.hasNext():
        file = listed.next()
        names = file.getPath().toUri().getPath().strip("/").split("/")[depth:]
        if file.getLen() == 0 and not any(name.startswith(("_", ".")) for name in names):
            found.append(file.getPath().toString())
    return found


def snapshot_tree(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """(path below root, bytes, sha256) of all files; contents are hashed where they are read.

    Files of up to ``WHOLE_BYTES`` are read whole by Spark, longer ones by ranges (:mod:`.digests`) when this is called; in a store
    that Arrow's file systems don't open, they are read whole too, which Spark does up to 2 GiB. Names that begin with ``_`` or ``.``
    are hidden from Spark's readers and aren't files of the tree.
    """
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.removeprefix("file://").rstrip("/")) + "/", "")
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tree = tree.filter(~below.rlike(exclude)) if exclude else tree
    long = {r.path: r.length for r in tree.filter(F.col("length") > WHOLE_BYTES).select("path", "length").collect()}
    found = digests.places(spark, list(long)) if long else None
    rows = (tree.filter(F.col("length") <= WHOLE_BYTES) if found else tree).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if found:
        rows = rows.unionByName(digests.by_ranges(spark, [(path, found[path], n) for path, n in long.items()]))
    if empty := _empty_files(spark, root):
        nothing = spark.createDataFrame([(path, 0) for path in empty], "path string, length long").withColumn("sha256", F.sha2(F.lit(b""), 256))
        rows = rows.unionByName(nothing.filter(~below.rlike(exclude)) if exclude else nothing)
    return rows.select(below.alias("path"), F.col("length").alias("bytes"), "sha256")


def tree_digest(snapshot: DataFrame) -> DataFrame:
    """(files, bytes, sha256): one digest of a snapshot, the root of a digest tree over its rows as canonical JSON in path order."""
    row = F.sha2(F.to_json(F.struct(F.col("bytes"), F.col("path"), F.col("sha256"))), 256)
    levels = merkle.tree(snapshot.select("path", row.alias("h")), ["path"], "h")
    totals = snapshot.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return totals.withColumn("sha256", F.lit(merkle.root(levels)))


def verify_contents(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (path, sha256) whose file is missing or has another digest."""
    rows = expected.join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    return rows.filter("found IS NULL OR found <> sha256")


def scan_secrets(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, rule, line) of the first match of each secret rule in each text."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(rule).alias("rule"), F.regexp_instr(text, F.lit(p)).alias("at"))) for rule, p in SECRET_PATTERNS.items()]))
    rows = df.select(path, text, F.explode(hits).alias("h"))
    return rows.select(path, F.col("h.rule").alias("rule"), (F.length(F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("h.at") - 1), "[^\n]", "")) + 1).alias("line"))


def scan_markers(df: DataFrame, path: str, text: str, markers: list[str]) -> DataFrame:
    """(path, marker, line) of the first place of each marker."""
    rows = df.select(path, text, F.explode(F.array(*map(F.lit, markers))).alias("marker")).withColumn("at", F.instr(F.col(text), F.col("marker"))).filter("at > 0")
    return rows.select(path, "marker", (F.length(F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("at") - 1), "[^\n]", "")) + 1).alias("line"))


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_or_verify(df: DataFrame, path: str) -> str:
    """Writes, or holds the rows against what is there: ``written`` or ``verified``; an error if they differ."""
    from ..operators.cohort import same_multiset

    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_once(df, path)
        return "written"
    if there.columns != df.columns or not same_multiset(there, df):
        raise CohortError("write_once_conflict")
    return "verified"


def append_records(df: DataFrame, path: str) -> None:
    """JSON lines added to a ledger."""
    df.write.mode("append").json(path)


def materialize(df: DataFrame, path: str, text: str, keys: list[str], index: list[str]) -> None:
    """A data set as files: ``records`` (JSON lines), ``index`` (CSV of some columns) and ``manifest`` (bytes and digest of each text).

    Each part is written once and never over another.
    """
    digest = df.select(*keys, F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    df.write.mode("errorifexists").json(f"{path}/records")
    df.select(*index).write.mode("errorifexists").option("header", True).csv(f"{path}/index")
    digest.write.mode("errorifexists").json(f"{path}/manifest")
