"""SHA-256 of long files, a range a task.

A digest over a file is a chain: a range can be hashed only from the state that the bytes before it leave.  So
files go in rounds: in each, one task a file reads the next range from the state of the one before, in small windows, and
hands its state on.  Files advance side by side; a task reads a range at most and holds one window, whatever the file's
length, and a task that is lost repeats its range only.  The rounds are as many as the longest file has ranges.

``hashlib`` doesn't give its state away; OpenSSL's functions, which it calls, do.  Where they can't be loaded, or don't
agree with ``hashlib`` in a trial, a file is hashed to its end in one task, by windows as well.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.cohort import CohortError

#: Bytes of a file that one task reads, and that it holds at once.
RANGE_BYTES, WINDOW = 256 << 20, 1 << 20
_ROWS = "path string, place string, size bigint, at bigint, stop bigint, state binary"
_TOLD = pa.schema([("path", pa.string()), ("at", pa.int64()), ("state", pa.binary()), ("sha256", pa.string())])


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


class _Chained:
    """A SHA-256 that starts from a state (b"" at the beginning) and gives it away."""

    def __init__(self, lib: ctypes.CDLL, state: bytes) -> None:
        self.lib = lib
        self.context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            lib.SHA256_Init(ctypes.byref(self.context))

    def update(self, raw: bytes) -> None:
        self.lib.SHA256_Update(ctypes.byref(self.context), ctypes.c_char_p(raw), ctypes.c_size_t(len(raw)))

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), _Context.from_buffer_copy(self.state())
        self.lib.SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()


def _agrees(lib: ctypes.CDLL) -> bool:
    """Whether a text hashed in two parts, with the state handed on between, has the digest that hashlib gives."""
    raw = bytes(range(200))
    first = _Chained(lib, b"")
    first.update(raw[:77])
    second = _Chained(lib, first.state())
    second.update(raw[77:])
    return second.hexdigest() == hashlib.sha256(raw).hexdigest()


@lru_cache(maxsize=1)
def _openssl() -> ctypes.CDLL | None:
    """The library that ``hashlib`` is linked with, or the system's; None if there is none that hands states on."""
    for find in (lambda: sys.modules["_hashlib"].__file__, lambda: ctypes.util.find_library("crypto")):
        try:
            if (name := find()) and _agrees(lib := ctypes.CDLL(name)):
                return lib
        except (KeyError, OSError, AttributeError):
            continue
    return None


def _opened(place: str):
    """(Arrow's file system, path in it) of a file as Hadoop writes it, without escapes."""
    from pyarrow import fs

    if place.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", place)
    return fs.FileSystem.from_uri(quote(place, safe="/:@"))


def advance(source, path: str, size: int, at: int, stop: int, state: bytes) -> tuple[int, bytes, str | None]:
    """(place reached, state there, digest at the file's end else None) after the bytes [at, stop) of an open file."""
    lib = _openssl()
    if lib is None:
        at, stop = 0, size
    digest = _Chained(lib, state) if lib else hashlib.sha256()
    while at < stop:
        raw = source.read_at(min(WINDOW, stop - at), at)
        if not raw:
            raise CohortError(f"file_changed:{path}")
        digest.update(raw)
        at += len(raw)
    return at, digest.state() if lib else b"", digest.hexdigest() if at == size else None


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            store, name = _opened(r["place"])
            with store.open_input_file(name) as source:
                told = advance(source, r["path"], r["size"], r["at"], r["stop"], r["state"])
            yield pa.RecordBatch.from_pylist([dict(zip(_TOLD.names, (r["path"], *told), strict=True))], schema=_TOLD)


def places(spark: SparkSession, paths: list[str]) -> dict[str, str] | None:
    """Where each path is for Arrow's file systems, mounts of Hadoop's views resolved; None if one is in a store that they don't open."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    found, seen = {}, set()
    for path in paths:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        found[path] = place = name.getFileSystem(hadoop).resolvePath(name).toString()
        store = re.match(r"[^/]*(//[^/]*)?", place)[0]
        if store not in seen:
            try:
                system, inside = _opened(place)
                if not system.get_file_info(inside).is_file:
                    return None
            except (OSError, ValueError, NotImplementedError):
                return None
            seen.add(store)
    return found


def by_ranges(spark: SparkSession, files: list[tuple[str, str, int]]) -> DataFrame:
    """(path, length, sha256) of (path, place, bytes) files; a round's states, about a hundred bytes a file, pass the driver."""
    size, place, done = {p: n for p, _, n in files}, {p: w for p, w, _ in files}, []
    left = [(p, 0, b"") for p in size]
    while left:
        rows = [(p, place[p], size[p], at, min(size[p], at + RANGE_BYTES), bytearray(state)) for p, at, state in left]
        plan = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), _ROWS)
        told = plan.mapInArrow(_ranges, "path string, at bigint, state binary, sha256 string").collect()
        done += [(r.path, size[r.path], r.sha256) for r in told if r.sha256 is not None]
        left = [(r.path, r.at, bytes(r.state)) for r in told if r.sha256 is None]
    return spark.createDataFrame(done, "path string, length long, sha256 string")
