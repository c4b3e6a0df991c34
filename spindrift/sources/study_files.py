"""Study folders as a Spark data source, and asserted readers on top of it.

``spark.read.format("study_files").load(root)`` lists a tree of files.  Only the folders right below the root are listed
when the query is planned; each is a partition, whose task lists and reads its own files.  Filters on ``run`` (the first
folder's name) are pushed down, so other runs are not even listed.  Empty files and names with a leading dot or underscore are files as
well.  Paths may be any that Arrow's file systems open (local and shared mounts, object stores).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..operators.cohort import CohortError, manifest_diff, require_none
from ..operators.numbering import counted

SCHEMA = "run string, path string, bytes bigint, sha256 string, content binary"
#: Bytes of contents of a batch, about.
_BATCH = 16 << 20


@dataclass
class RunFolder(InputPartition):
    """One folder below the root, or with an empty name the files right in it."""

    name: str


class StudyFilesReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.keep = root, []

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes those on ``run`` that name its values; the rest stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("run",):
                self.keep.append(f)
            else:
                yield f

    def _kept(self, run: str) -> bool:
        tests = {EqualTo: lambda f: run == f.value, In: lambda f: run in f.value, StringStartsWith: lambda f: run.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.keep)

    def partitions(self) -> list[RunFolder]:
        from pyarrow import fs

        system, top = self._system()
        found = system.get_file_info(fs.FileSelector(top))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        return [RunFolder(n) for n in [*([""] if any(f.is_file for f in found) else []), *names] if self._kept(n)]

    def read(self, partition: RunFolder | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition is None:  # no folder is left by the filters
            return
        system, top = self._system()
        top = top.rstrip("/")
        listed = system.get_file_info(fs.FileSelector(f"{top}/{partition.name}".rstrip("/"), recursive=bool(partition.name)))
        names, kinds = ["run", "path", "bytes", "sha256", "content"], (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        rows, held = [], 0
        for info in sorted((f for f in listed if f.is_file), key=lambda f: f.path):
            with system.open_input_stream(info.path) as stream:
                content = stream.read()
            rows.append((partition.name, info.path[len(top) + 1 :], len(content), hashlib.sha256(content).hexdigest(), content))
            held += len(content)
            if held >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class StudyFiles(DataSource):
    """Files below ``path``, with their sizes and digests."""

    @classmethod
    def name(cls) -> str:
        return "study_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StudyFilesReader:
        return StudyFilesReader(self.options["path"])


def study_files(spark: SparkSession, root: str) -> DataFrame:
    """(run, path, bytes, sha256, content) of all files below ``root``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StudyFiles)
    return spark.read.format("study_files").load(root)


def asserted(files: DataFrame, manifest: DataFrame, code: str) -> DataFrame:
    """``files`` if they are those of ``manifest`` (path, bytes, sha256); a file that is missing, unexpected, or of another size or digest is an error ``<code>_<finding>``."""
    found = manifest_diff(manifest, files.select("path", "bytes", "sha256")).groupBy("finding").count().orderBy("finding").first()
    if found is not None:
        raise CohortError(f"{code}_{found['finding']}")
    return files


def expect(df: DataFrame, counts: dict[str, tuple[str | None, int]]) -> DataFrame:
    """``df`` if it has the expected numbers: error code: (column, or None for rows, and how many distinct values it must have)."""
    if not counts:
        return df
    measured = df.agg(*[(F.count(F.lit(1)) if c is None else F.count_distinct(c)).alias(f"n{i}") for i, (c, _) in enumerate(counts.values())]).first()
    for i, (code, (_, n)) in enumerate(counts.items()):
        if measured[f"n{i}"] != n:
            raise CohortError(code)
    return df


def pinned(files: DataFrame, path: str, size: int, sha256: str, code: str) -> DataFrame:
    """The one file of that path, which must have this size and digest."""
    row = files.filter(F.col("path") == path).select("bytes", "sha256").collect()  # paths are unique
    for bad, what in ((not row, "missing"), (row and row[0]["bytes"] != size, "size_mismatch"), (row and row[0]["sha256"] != sha256, "hash_mismatch")):
        if bad:
            raise CohortError(f"{code}_{what}")
    return files.filter(F.col("path") == path)


def json_lines(files: DataFrame, path: str, schema: str, code: str) -> DataFrame:
    """The rows of one JSON-lines file, each an object of ``schema``; a line that isn't is an error."""
    lines = files.filter(F.col("path") == path).select(F.explode(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("line")).filter("trim(line) <> ''")
    rows = lines.select(F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    require_none(rows.filter("_bad IS NOT NULL"), f"{code}_not_jsonl")
    return rows.drop("_bad")


def study_cases(files: DataFrame, manifest: str = "source_manifest.jsonl", expected: int | None = None, prefix: str = "") -> DataFrame:
    """(unit, project, size, code, code_sha256, context) of a study's units; each broken rule is an error of its own.

    The manifest names a unit's text and context files with their digests.  Ids must be unique and, with ``prefix``, be
    ``<prefix>001`` and so on, as many as ``expected``.
    """
    rows = json_lines(files, manifest, "snippet_id string, snippet_path string, snippet_sha256 string, context_path string, context_sha256 string, system_name string, dataset_LOC bigint", "source_manifest")
    require_none(rows.filter("snippet_id IS NULL").unionByName(rows.groupBy("snippet_id").count().filter("count > 1").select("snippet_id"), allowMissingColumns=True), "source_manifest_method_id")
    if expected is not None:
        expect(rows, {f"source_manifest_count_not_{expected}": (None, expected)})
    kept = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"), F.col("content").alias("_c"))
    for kind in ("snippet", "context"):
        rows = rows.join(kept.withColumnsRenamed({"_p": f"{kind}_p", "_h": f"{kind}_h", "_c": f"{kind}_c"}), F.col(f"{kind}_path") == F.col(f"{kind}_p"), "left")
        require_none(rows.filter(f"{kind}_p IS NULL"), f"{kind}_read_failed")
        require_none(rows.filter(f"{kind}_h <> {kind}_sha256 OR {kind}_sha256 IS NULL"), f"{kind}_hash_mismatch")
    require_none(rows.filter(~F.is_valid_utf8(F.col("snippet_c").cast("string"))), "snippet_read_failed")
    context = F.col("context_c").cast("string")
    require_none(rows.filter(~F.coalesce(F.get_json_object(context, "$.snippet_id") == F.col("snippet_id"), F.lit(False))), "context_method_id_mismatch")
    require_none(rows.filter("system_name IS NULL OR system_name = ''"), "case_project_invalid")
    require_none(rows.filter("dataset_LOC IS NULL OR dataset_LOC < 1"), "case_loc_invalid")
    if prefix and expected is not None:
        require_none(rows.filter(~F.col("snippet_id").isin([f"{prefix}{i:03d}" for i in range(1, expected + 1)])) if expected <= 1000 else rows.limit(0), "case_method_id_sequence")
    return rows.select(F.col("snippet_id").alias("unit"), F.col("system_name").alias("project"), F.col("dataset_LOC").alias("size"), F.col("snippet_c").cast("string").alias("code"), F.col("snippet_sha256").alias("code_sha256"), context.alias("context"))


EVALUATION_COLUMNS = ("participant_id", "system_name", "snippet_signature", "developer_position", "Cyclomatic complexity", "LOC", "PBU", "AU")


def study_evaluations(spark: SparkSession, path: str, units: DataFrame, expected: dict[str, int] | None = None, repeats: bool = False) -> DataFrame:
    """Participants' evaluations in the order of the file, numbered 0, 1, ..., with the unit that each signature names.

    ``units``: (signature, unit).  Needed columns must be in the header, every signature must be known, and no
    participant may evaluate a unit twice unless ``repeats``.  ``expected`` gives counts of rows, methods, participants
    and projects that must be met.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    if any(c not in names for c in EVALUATION_COLUMNS):
        raise CohortError("outcome_columns_missing")
    rows = raw.select(*[F.col(f"`{names[c]}`").alias(c) for c in EVALUATION_COLUMNS], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    rows = counted(rows, [], ["_file", "_block", "_row"], "evaluation_index")
    require_none(units.groupBy("signature").count().filter("count > 1"), "duplicate_signature")
    known = units.select(F.col("signature").alias("_s"), F.col("unit").alias("method_id"))
    rows = rows.join(known, F.col("snippet_signature") == F.col("_s"), "left")
    require_none(rows.filter("method_id IS NULL"), "outcome_signature_not_in_manifest")
    rows = rows.select("evaluation_index", "participant_id", "method_id", F.col("system_name").alias("project"), F.col("developer_position").alias("participant_group"), F.col("LOC").alias("loc"), F.col("Cyclomatic complexity").alias("cyclomatic_complexity"), F.col("PBU").alias("pbu"), F.col("AU").alias("au"))
    if not repeats:
        require_none(rows.groupBy("participant_id", "method_id").count().filter("count > 1"), "outcome_participant_method_duplicate")
    columns = {"row": None, "method": "method_id", "participant": "participant_id", "project": "project"}
    return expect(rows, {f"outcome_{k}_count_mismatch": (columns[k], n) for k, n in (expected or {}).items()})


def attempts(files: DataFrame) -> DataFrame:
    """(run, unit, attempt, selected) of every attempt file ``<run>/<unit>/attempt-<n>/attempt.json``; ``selected`` is the number that the unit's ``selected.json`` names, if there is one."""
    parts = F.split("path", "/")
    tried = files.filter(F.col("path").rlike(r"^[^/]+/[^/]+/attempt-[0-9]+/attempt\.json$")).select("run", parts[1].alias("unit"), F.regexp_extract(parts[2], "[0-9]+", 0).cast("int").alias("attempt"))
    chosen = files.filter(F.col("path").rlike(r"^[^/]+/[^/]+/selected\.json$")).select(F.col("run").alias("_r"), parts[1].alias("_u"), F.get_json_object(F.col("content").cast("string"), "$.attempt").cast("int").alias("selected"))
    return tried.join(chosen, (F.col("run") == F.col("_r")) & (F.col("unit") == F.col("_u")), "left").drop("_r", "_u")
