"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The writer marks repeated payloads as revisits.  The reader cuts the files into byte ranges; a task
looks for gzip magic in its range, takes a place for a member only if it unpacks to a WARC header,
and owns the records that start inside, reading on past its range for the last one.  It reads a
window at a time, so it holds one record and one window, and reads nothing twice.

Files are written and read through Arrow's file systems under the shared folder, to names of their
own per attempt; only files of tasks that succeeded are read.  Archives hold whole payloads.

Null html is an empty payload; a null url leaves the target out; a null page_id is written as such and
read back as null; in a group of equal payloads it is never the response; repeated rows of the first
page_id are all responses; an empty table gives no archive and no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_folder

#: Payloads under this many bytes are never revisits.
LEAST_REVISIT = 100
#: A file is closed beyond this size; a range that one task reads at least, and the number of ranges from which they get longer.
FILE_BYTES, RANGE_BYTES, MOST_RANGES = 1 << 30, 16 << 20, 50_000
#: Bytes that a task reads and holds at once; of a member, those that its header is looked for in, and those unpacked at a time then.
WINDOW, FIRST, STEP = 1 << 18, 4096, 1 << 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = "path string, start bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _escaped(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    name = lambda x: f"<{ID_PREFIX}{'null' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", _escaped(url)))
    lines.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        lines += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return zlib.compress(_header(lines) + block + b"\r\n\r\n", 6, wbits=31)


def write(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write (page_id, url, html) rows as archives in ``folder``; gives (path, bytes) of the files.

    Equal payloads are found by digest: the groups' least ids are aggregated (partly in each task)
    and joined back, so a group of any size is never gathered.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    groups = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    marked = rows.join(groups.filter("n > 1"), F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = marked.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                size += out.write(record(page_id, url, html.encode(), digest, refers_to))
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "size": [n for _, n in done]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64())]))

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return sorted((r["path"], r["size"]) for r in marked.mapInArrow(of_batches, "path string, size bigint").collect())


class _Ahead:
    """Bytes of an open file from any place on, read a window at a time; going forward, each byte is read once."""

    def __init__(self, source, size: int, window: int) -> None:
        self.source, self.size, self.window = source, size, window
        self.begin, self.held = 0, b""

    def of(self, at: int) -> memoryview:
        """What is held from ``at`` on; b"" at the end of the file."""
        if not self.begin <= at < self.begin + len(self.held):
            self.begin, self.held = at, self.source.read_at(min(self.window, self.size - at), at) if at < self.size else b""
        return memoryview(self.held)[at - self.begin :]

    def find(self, at: int, end: int) -> int:
        """The first place of the magic in [at, end), -1 if there is none."""
        while at < end:
            k = self.held.find(MAGIC, at - self.begin) if len(self.of(at)) >= len(MAGIC) else -1
            if k >= 0:
                return self.begin + k if self.begin + k < end else -1
            after = self.begin + len(self.held)
            if after >= self.size:
                return -1
            at = max(at, after - len(MAGIC) + 1)
            self.begin, self.held = at, b""  # so that the next window starts with these last bytes
        return -1


def _member(ahead: _Ahead, start: int) -> tuple[bytes, int] | None:
    """(plain bytes, end) of the gzip member at ``start``, or None if none with a WARC header starts there."""
    unpack, plain, at, most = zlib.decompressobj(wbits=31), bytearray(), start, FIRST
    while len(chunk := ahead.of(at)[:most]):
        try:
            plain += unpack.decompress(chunk)
        except zlib.error:
            return None
        if len(plain) >= 5 and plain[:5] != b"WARC/":
            return None
        at, most = at + len(chunk), STEP
        if unpack.eof:
            return (bytes(plain), at - len(unpack.unused_data)) if b"\r\n\r\n" in plain else None
    return None


def parsed(plain: bytes) -> dict:
    """The fields of one record; an HTTP block's payload is what follows its header."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().strip().lower()] = v.decode(errors="replace").strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if fields.get("warc-type") == "revisit":
            size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), size)
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    if kind == "response" and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    bare = lambda k: (fields[k].strip("<>") if k in fields else None)
    return {"record_type": kind, "record_id": bare("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind != "revisit" else None}


def records_in(source, size: int, start: int, end: int, window: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """(start, plain bytes) of the records that start in [start, end) of an open file.

    The file is read a window at a time, on past ``end`` as far as the last record goes (to the end of a window).
    """
    ahead, at = _Ahead(source, size, window), start
    while (at := ahead.find(at, end)) >= 0:
        got = _member(ahead, at)
        if got is None:
            at += 1
        else:
            yield at, got[0]
            at = got[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for uri, path, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, _ = fs.FileSystem.from_uri(uri)
            rows: list[dict] = []
            with store.open_input_file(path) as source:
                for at, plain in records_in(source, size, start, end):
                    rows.append({"path": path, "start": at} | parsed(plain))
                    if len(rows) == 512:
                        yield _to_batch(rows, names)
                        rows = []
            if rows:
                yield _to_batch(rows, names)


def _to_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"start": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]], range_bytes: int | None = None) -> DataFrame:
    """All records of the (path, bytes) files, one task a byte range; ranges grow with the files, their number is bounded by theirs and ``MOST_RANGES``."""
    range_bytes = range_bytes or max(RANGE_BYTES, -(-sum(n for _, n in files) // MOST_RANGES))
    ranges = [(folder, path, size, at, min(at + range_bytes, size)) for path, size in files for at in range(0, size, range_bytes)]
    plan = spark.createDataFrame(ranges, "uri string, path string, size bigint, start bigint, stop bigint")
    return plan.repartition(max(1, len(ranges))).mapInArrow(_read, RECORD_SCHEMA)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    folder = new_folder(spark, "warc")
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) AS bigint)")
    return read(spark, folder, files).select(
        number("record_id").alias("page_id"), "payload_bytes", F.expr("substring(payload_digest, 8)").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )
