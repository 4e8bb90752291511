"""WARC archives: a writer of one gzip member for each record, and a reader that splits archives by byte ranges.

A reading task gets a range of a file. It looks for the magic bytes of a gzip member, takes a place for a member only if the bytes from there on decode to
a WARC header, and owns all records whose member begins inside its range, also the one that ends beyond. So any cut of a file gives each record
once. The file system is Arrow's, by the URI of the folder, so executors need no local folder.

A payload that itself holds a whole record as an uncompressed gzip member could pass for one; what the writer compresses never does, as its payloads aren't stored plain.

Responses hold an HTTP response with the payload. A record whose payload equals that of an earlier one is a revisit: it keeps the HTTP header,
with the length, and the payload's digest, and names the response that holds the payload.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, saved, shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once.
CHUNK = 1 << 20
#: Range of a reading task.
SPLIT_BYTES = 4 << 20
RECORD = "path string, offset long, record_type string, record_id string, uri string, refers_to string, payload_digest string, http_length long, payload binary"


def _line(name: str, value: str) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record(page: str, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """A whole record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", str(len(payload))) + b"\r\n"
    block = http if refers is not None else http + payload
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)))
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(_line(*x) for x in head) + b"\r\n" + block + b"\r\n\r\n"


def write_warc(df: DataFrame, folder: str | None = None, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record for each row to archives in the folder, and returns their list: path, size, records.

    Of records with equal payloads (UTF-8; null: empty) of at least least bytes, that with the smallest page is a response and
    the others are revisits; rows that repeat the smallest page are responses all, as are all where every page is null. An archive that a lost or repeated task left behind is not
    in the list. A payload of any length is one record, whole; a null URL is none. Other columns don't matter, whatever their names. An empty table gives an empty list.
    """
    folder = folder or shared_dir(df.sparkSession, "warc")
    small_batches(df.sparkSession, 500)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = df.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least).select("digest", "page")
    first = long.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & F.coalesce(F.col("page") != F.col("first"), F.lit(True)), F.col("first"))
    rows = rows.select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", refers.cast("string").alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        out, size, n, name = None, 0, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(r["page"] or "null", r["url"], r["payload"], r["digest"], r["refers"], date)) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [n]})

    return saved(rows.mapInArrow(write, "path string, size long, records long"), "warc-list")


class Range:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""


def member(source: Range, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at this place holds and where it ends; None if no whole WARC record is there."""
    z, out, pos = zlib.decompressobj(31), [], at
    n = 1 << 12
    try:
        while not z.eof:
            data = source.read(pos, n)
            if not data:
                return None
            out.append(z.decompress(data))
            pos += len(data)
            if len(out) == 1 and not out[0].startswith(b"WARC/"[: len(out[0])]):
                return None
            n = CHUNK
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, pos - len(z.unused_data)) if whole.startswith(b"WARC/") else None


def records(source: Range, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each record whose member begins in start to below end."""
    at = start
    while at < end:
        window = source.read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        got = member(source, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def parsed(data: bytes) -> dict | None:
    """Header fields and payload of a record; None if it is cut short."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not sep or not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    sizes = [v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")) if k.lower() == "content-length"]
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest"), "http_length": int(sizes[0]) if sizes and sizes[0].isdigit() else None, "payload": payload,
    }


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the archives (path, size), in RECORD's columns; damaged records are left out, those after them are not.

    What a record doesn't say (a URI, whom it refers to) is null. An archive that is listed twice is read twice; null paths and sizes are left out, other columns don't
    matter. A record of any length is read whole by the task in whose range it begins. An empty list gives no rows.
    """
    small_batches(archives.sparkSession, 500)
    spans = archives.where("size > 0 and path is not null").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    spans = spans.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    tasks = max(1, min(20_000, spans.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for span in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(span["path"])
                with fs.open_input_file(at) as f:
                    for offset, data in records(Range(f, span["size"]), span["start"], span["end"]):
                        one = parsed(data)
                        if one is None:
                            continue
                        rows.append(one | {"path": span["path"], "offset": offset})
                        held += len(one["payload"])
                        if held > 8 * CHUNK or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return spans.repartition(tasks).mapInArrow(read, RECORD)


by_value(__name__)
