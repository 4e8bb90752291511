"""Zipped archives and workbooks, split by member.

One pass reads only the archives' directories, by ranged reads, and gives a row for each member: where it begins, how long it is, how it is packed. A filter on these rows is all the
pruning there is to do. The members are then dealt out over the tasks, each of which opens the archive at its member's place and inflates it as a stream, so neither an archive nor a member
is ever held whole. The file system is Arrow's, by the URI of the path.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "source_archive string, member string, line long, fields map<string,string>"
MEMBERS = "path string, member string, offset long, packed long, size long, method int, crc long"
ROWS_AT_ONCE = 2000
#: Bytes read or inflated at once.
CHUNK = 1 << 20
#: Methods of a member: as the format numbers them, and a workbook that is the file itself.
STORED, DEFLATED, WORKBOOK = 0, 8, -1


def list_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and size of each file; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def _opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return fs.open_input_file(at)


def members(archives: DataFrame, pattern: str = ".*", path: str = "path") -> DataFrame:
    """The members of archives whose whole name, without folders, fits the pattern, in MEMBERS' columns, from the archives' directories alone.

    A workbook is one member, itself, whatever the pattern. Null paths and files that are no archives have none, as do folders in an archive; encrypted members are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive in batch.column(0).to_pylist():
                if archive is None:
                    continue
                with _opened(archive) as f:
                    try:
                        z = zipfile.ZipFile(f)
                    except (zipfile.BadZipFile, pa.ArrowInvalid):  # Arrow's files don't seek to before their start
                        continue
                    found = z.infolist()
                    if any(m.filename == "[Content_Types].xml" for m in found):
                        rows.append((archive, archive.rsplit("/", 1)[-1], 0, f.size(), f.size(), WORKBOOK, 0))
                        continue
                    rows += [(archive, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC) for m in found if not m.is_dir() and not m.flag_bits & 1 and re.fullmatch(pattern, m.filename.rsplit("/", 1)[-1], re.I)]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["path", "member", "offset", "packed", "size", "method", "crc"])

    return archives.select(F.col(path).alias("path")).mapInArrow(run, MEMBERS)


class Member(io.RawIOBase):
    """A member as a stream, from its place in an open archive; what is broken, or hasn't the checksum that the directory tells, is an error."""

    def __init__(self, f, offset: int, packed: int, method: int, crc: int):
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04" or method not in (STORED, DEFLATED):
            raise zipfile.BadZipFile(f"no stored or deflated member at {offset}")
        f.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        self.f, self.left, self.crc, self.seen = f, packed, crc, 0
        self.inflate = zlib.decompressobj(-15) if method == DEFLATED else None

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        most, out = min(len(to), CHUNK), b""
        while not out and not (self.inflate and self.inflate.eof):
            kept = self.inflate.unconsumed_tail if self.inflate else b""
            if not kept and self.left:
                kept = self.f.read(min(CHUNK if self.inflate else most, self.left))
                self.left -= len(kept)
            if not self.inflate:
                out = kept
                break
            out = self.inflate.decompress(kept, most)
            if not out and not kept and not self.inflate.eof:
                raise zipfile.BadZipFile("a member ends too early")
        self.seen = zlib.crc32(out, self.seen)
        if not out and self.seen != self.crc:
            raise zipfile.BadZipFile("a member hasn't its checksum")
        to[: len(out)] = out
        return len(out)


def sheet_rows(file) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet, as text."""
    plain = lambda tag: tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(file) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if plain(t.tag) == "t"))
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        with z.open(sheets[0]) as f:
            yield from _cells_of(f, shared)


def _cells_of(file, shared: list[str]) -> Iterator[list[str]]:
    """Rows of a sheet by its tags as they come, so no tree is built: a row's elements are cells, what v and t in them say is their text."""
    rows: list[list[str]] = []
    columns: dict[str, int] = {}  # by a cell's letters
    out: list[str] | None = None  # the open row
    depth, said, own, parts = 0, False, {}, []

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal out, depth, said, own, parts
        tag = tag.rpartition("}")[2]
        if out is None:
            if tag == "row":
                out, depth = [], 0
            return
        depth += 1
        if depth == 1:
            own, parts = attributes, []
        said = tag == "v" or tag == "t"

    def text(some: str) -> None:
        if said:
            parts.append(some)

    def end(tag: str) -> None:
        nonlocal out, depth, said
        said = False
        if out is None:
            return
        if depth == 0:
            rows.append(out)
            out = None
            return
        depth -= 1
        if depth:
            return
        letters = own.get("r", "").rstrip("0123456789")
        at = columns.get(letters)
        if at is None:
            at = 0
            for c in re.match("[A-Z]*", letters)[0]:
                at = at * 26 + ord(c) - 64
            columns[letters] = at
        if at - 1 > len(out):
            out += [""] * (at - 1 - len(out))
        whole = "".join(parts)
        out.append(shared[int(whole)] if own.get("t") == "s" and whole else whole)

    parser = expat.ParserCreate(None, "}")
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
    while data := file.read(1 << 16):
        parser.Parse(data)
        yield from rows
        rows.clear()
    parser.Parse(b"", True)
    yield from rows


def _table(rows: Iterator[list[str]], archive: str, member: str) -> Iterator[tuple]:
    header = None
    for n, row in enumerate(rows):
        if header is None:
            header = [x.lstrip("﻿").strip() for x in row]
        elif any(row) and len(row) <= len(header):  # a row of more cells than the header is malformed
            yield archive, member, n, [(h, x) for h, x in dict(zip(header, row)).items() if h]


def member_rows(found: DataFrame, sep: str = ",", quote: str = '"', encoding: str = "UTF-8", tasks: int | None = None) -> DataFrame:
    """source_archive, member, line and fields (header -> text) of each row of members, as members() tells them.

    Delimited members and workbooks (.xlsx, in an archive or by themselves) are read alike. A row of more cells than its header is left out, one of fewer lacks the last
    fields. Bytes that aren't of the encoding become the replacement character. Members are dealt out over as many tasks as the session shuffles with, or over `tasks`.
    """

    def rows_of(m: dict) -> Iterator[tuple]:
        with _opened(m["path"]) as f:
            if m["method"] == WORKBOOK:
                yield from _table(sheet_rows(f), m["path"], m["member"])
                return
            stream = io.BufferedReader(Member(f, m["offset"], m["packed"], m["method"], m["crc"]), CHUNK)
            if m["member"].lower().endswith(".xlsx"):  # a workbook is an archive again, and read from its end
                yield from _table(sheet_rows(io.BytesIO(stream.read())), m["path"], m["member"])
                return
            text = io.TextIOWrapper(stream, encoding, errors="replace", newline="")
            own = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
            yield from _table(csv.reader((x.replace("\0", "") for x in text), delimiter=sep, **own), m["path"], m["member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
        send = lambda some: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), kinds)], ["source_archive", "member", "line", "fields"])
        some: list[tuple] = []
        for batch in batches:
            for m in batch.to_pylist():
                for row in rows_of(m):
                    some.append(row)
                    if len(some) == ROWS_AT_ONCE:
                        yield send(some)
                        some = []
        if some:
            yield send(some)

    tasks = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "path", "offset").mapInArrow(run, ROWS)


def zipped_rows(archives: DataFrame, pattern: str, sep: str = ",", quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """The rows of the members that fit the pattern: members() and member_rows() of archives (path)."""
    return member_rows(members(archives, pattern), sep, quote, encoding)


def write_archives(files: DataFrame, folder: str, order: Sequence[str] = (), text: str | Column = "text", tasks: int | None = None) -> DataFrame:
    """Writes an archive of the files (path, member, text) for each path, a name below the folder, and returns their list: path.

    A file is one row, or the texts of several, put together as they are by the columns of `order`, so no file has to be held whole; null is empty. An archive is written by one task, as a stream,
    member by member in order of name, under its own name, so a task that runs again writes the same. `text` may be an expression of other columns: it is made where it is written, and only these are shuffled. Archives are dealt
    out over as many tasks as Spark sees fit, or over `tasks`.
    Rows are dealt by a hash of the path: a union of files that are each dealt by path would else be taken as dealt already, though its parts needn't be alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name, member, out, into, done = None, None, None, None, []

        def closed() -> None:
            if into:
                into.close()
            if out:
                out.close()

        for batch in batches:
            paths, names, texts = (c.to_pylist() for c in batch.columns)
            for (path, own), some in groupby(range(len(paths)), lambda i: (paths[i], names[i])):
                if out is None or path != name:
                    closed()
                    name, member, into = path, None, None
                    out = zipfile.ZipFile(fs.open_output_stream(f"{at}/{name}"), "w", zipfile.ZIP_DEFLATED)
                    done.append(f"{folder.rstrip('/')}/{name}")
                if into is None or own != member:
                    if into:
                        into.close()
                    info = zipfile.ZipInfo(own)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    member, into = own, out.open(info, "w", force_zip64=True)  # how long it gets isn't known yet
                into.write("".join(texts[i] or "" for i in some).encode())
        closed()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    text = F.col(text) if isinstance(text, str) else text
    by = F.xxhash64("path")
    return (files.repartition(tasks, by) if tasks else files.repartition(by)).sortWithinPartitions("path", "member", *order).select("path", "member", text.alias("text")).mapInArrow(run, "path string")


def same_header(name: Column) -> Column:
    """A header without its case and white space."""
    return F.upper(F.translate(name, " \t\n\x0b\f\r", ""))


def field(*names: str) -> Column:
    """The first of these headers that a row of zipped_rows() has, whatever its case and white space."""

    def found(name: str) -> Column:
        key = "".join(name.upper().split())
        return F.get(F.map_values(F.map_filter("fields", lambda k, _: same_header(k) == key)), F.lit(0))

    return F.coalesce(*map(found, names))


def with_cells(rows: DataFrame) -> DataFrame:
    """Rows of zipped_rows() with headers and cells, two arrays for cell(): where many fields are read, headers are brought to their plain form once a row and not once a field."""
    return rows.withColumns({"headers": F.transform(F.map_keys("fields"), same_header), "cells": F.map_values("fields")})


def cell(*names: str | Column) -> Column:
    """The same as field(), of rows of with_cells(); a name that is a Column must be a plain header."""
    key = lambda name: name if isinstance(name, Column) else F.lit("".join(name.upper().split()))
    return F.coalesce(*[F.get("cells", F.array_position("headers", key(name)) - 1) for name in names])


# executors get these functions along with the plan, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
