import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import Range, read_warc, record, records, write_warc


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def cut(data, step):
    return [r for a in range(0, len(data), step) for r in records(Range(File(data), len(data)), a, min(a + step, len(data)))]


@pytest.mark.parametrize("step", [1, 7, 100, 333, 10**6])
def test_any_cut_gives_each_record_once(step):
    page = lambda i: b"<p>" + bytes(range(256)) * i + b"\x1f\x8b\x08" * 3  # noqa: E731  magic bytes in the payload
    parts = [gzip.compress(record(str(i), f"http://e.org/{i}", page(i), "d", None, "2024-01-01T00:00:00Z"), i % 3) for i in range(6)]
    assert [b for _, b in cut(b"".join(parts), step)] == [gzip.decompress(p) for p in parts]


def test_damage_costs_one_record():
    parts = [gzip.compress(record(str(i), None, b"x" * 500, "d", None, "2024-01-01T00:00:00Z")) for i in range(3)]
    bad = parts[0] + b"junk" + parts[1][:40] + b"\x00" * 9 + parts[1][49:] + parts[2]
    assert [b"<urn:page:0>" in b or b"<urn:page:2>" in b for _, b in cut(bad, 64)] == [True, True]


def test_round_trip(spark):
    big = "é漢" * 200
    rows = [(3, "http://a.org/x y", big), (1, "http://a.org/1", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (1, "http://a.org/1", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    out = read_warc(write_warc(df), split_bytes=64).collect()
    assert len(out) == len(rows)
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in out)
    assert kinds == sorted([("<urn:page:1>", "response", None)] * 2 + [(f"<urn:page:{p}>", "revisit", "<urn:page:1>") for p in (2, 3, "null")] + [(f"<urn:page:{p}>", "response", None) for p in (4, 5, 6, 7)])
    for r in out:
        want = hashlib.sha256((big if r.http_length > 5 else "short" if r.http_length else "").encode()).hexdigest()
        assert r.payload_digest == f"sha256:{want}"
        assert r.record_type == "revisit" or (len(r.payload) == r.http_length and hashlib.sha256(r.payload).hexdigest() == want)


def test_header_injection(spark):
    df = spark.createDataFrame([(1, "http://a.org/\r\nWARC-Type: x", "hello")], "page_id long, url string, html string")
    (r,) = read_warc(write_warc(df)).collect()
    assert r.record_type == "response" and r.uri == "http://a.org/%0D%0AWARC-Type:%20x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_warc(write_warc(df)).count() == 0


def test_long_payloads_and_clashing_columns(spark):
    long = "".join(chr(33 + i * 7919 % 90) for i in range(4_000_000))
    df = spark.createDataFrame([(1, "u", long), (2, "u", "x" * 200), (3, "u", long)], "page_id long, url string, html string")
    for c in ("page", "payload", "first", "refers", "digest", "size", "n"):
        df = df.withColumn(c, F.lit("mine"))
    out = {r.record_id: r for r in read_warc(write_warc(df), split_bytes=100_000).collect()}
    assert len(out) == 3 and out["<urn:page:1>"].payload.decode() == long and out["<urn:page:2>"].record_type == "response"
    assert (out["<urn:page:3>"].record_type, out["<urn:page:3>"].refers_to, out["<urn:page:3>"].http_length) == ("revisit", "<urn:page:1>", 4_000_000)


def test_lists_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    files = write_warc(df)
    odd = files.unionByName(files).unionByName(spark.createDataFrame([(None, 10, 1), ("x", None, 1)], files.schema)).withColumn("start", F.lit("mine"))
    assert [r.record_id for r in read_warc(odd).collect()] == ["<urn:page:1>"] * 2
