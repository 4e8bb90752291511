"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark texts.

Each text is normalised in one pass over its bytes and scanned once; places in it are mapped back to
the original by counting words. The automaton is made once in each Python worker from the benchmark's words, which are counted first and sent
along if there are MAX_WORDS of them at most. The windows of a larger benchmark are joined with those of the texts by hashes instead, so
neither the driver nor a task holds the benchmark, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, saved, small_batches, spaced, word_list, worker_cache

#: Words of the benchmark that the automaton holds; its windows then take some hundred MB at most.
MAX_WORDS = 200_000
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def byte_table() -> np.ndarray:
    """What each byte becomes: A-Z lower case, word bytes themselves, all else a space."""
    t = np.full(256, 32, np.uint8)
    for a, b in ((48, 57), (97, 122), (128, 255)):
        t[a : b + 1] = np.arange(a, b + 1)
    t[65:91] = np.arange(97, 123)
    return t


def normalised(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words, one space between, as bytes, and where each text begins and ends in them."""
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    b = byte_table()[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    gap = b == 32
    first = np.zeros(len(b) + 1, bool)
    first[at[:-1]] = True
    keep = ~gap
    if len(b):
        before = np.concatenate(([True], gap[:-1])) | first[:-1]
        keep |= ~before
    ends = np.concatenate(([0], np.cumsum(keep)))[at]
    return b[keep], ends


def windows_of(words: list[str], size: int) -> set[str]:
    return {" " + " ".join(words[i : i + size]) + " " for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(items: list[tuple[str, str]], size: int):
    """Of (id, words) pairs. A window's value: the number of its words and the ids of the items that have it."""
    owners: dict[str, set[str]] = {}
    for item, line in items:
        for w in windows_of(line.split(" ") if line else [], size):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(w, (w.count(" ") - 1, tuple(sorted(ids))))
    if owners:
        a.make_automaton()
    return a if owners else None


def _word_spans(text: str) -> np.ndarray:
    """Start and end, in code points, of each word of an original text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate(([False], byte_table()[np.minimum(code, 128)] != 32, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge.reshape(-1, 2)


def scan(line: str, a) -> tuple[set[str], list[tuple[int, int]]]:
    """Items found in a normalised line, and the runs of hit words as first and one past the last."""
    items: set[str] = set()
    hits: list[tuple[int, int]] = []
    spaces = None
    padded = f" {line} "
    for end, (n, ids) in a.iter(padded):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
        last = int(np.searchsorted(spaces, end))
        items.update(ids)
        hits.append((last - n, last))
    return items, merged(hits)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def told(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Where runs of words stand in the original text."""
    at = _word_spans(text) if runs else None
    return [{"start": int(at[x][0]), "end": int(at[y - 1][1])} for x, y in runs]


def scan_udf(items: list[tuple[str, str]], size: int):
    """text -> result"""
    key = ("decontam", hashlib.sha256(repr((items, size)).encode()).hexdigest())

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = worker_cache(key, lambda: automaton(items, size))
        for texts in batches:
            flat, at = normalised(texts.fill_null(""))
            words, hit, names, spans = [], [], [], []
            for i in range(len(texts)):
                line = flat[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace").strip(" ")
                found, own = scan(line, a) if a and line else (set(), [])
                words.append(line.count(" ") + 1 if line else 0)
                hit.append(sum(y - x for x, y in own))
                names.append(sorted(found))
                spans.append(told(texts[i].as_py(), own))
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((words, hit, names, spans), KINDS)], ["n_words", "n_hit", "items", "spans"])

    return run


def _runs_told(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Text and places of windows in it (first word, number of words) -> words hit and passages."""
    hit, spans = [], []
    for text, own in zip(texts.to_pylist(), runs.to_pylist()):
        own = merged([(x["at"], x["at"] + x["n"]) for x in own or ()])
        hit.append(sum(y - x for x, y in own))
        spans.append(told(text, own))
    return pa.StructArray.from_arrays([pa.array(hit, KINDS[1]), pa.array(spans, KINDS[3])], ["n_hit", "spans"])


def _windows(words: Column, n: Column) -> Column:
    """Hashes of all runs of n words, with the place of the first."""
    one = lambda i: F.array_join(F.slice(words, i + 1, n), " ")
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("at"), n.alias("n"), F.xxhash64(one(i)).alias("h"), F.hash(one(i)).alias("h2")))


def _by_join(df: DataFrame, rows: DataFrame, size: int, text: str, keep: list[str]) -> DataFrame:
    """contaminated() for a benchmark (item, line) of any size: windows of both sides meet by their length and 96 bits of hash."""
    words = word_list(F.col("line"))
    own = F.least(F.size("_words"), F.lit(size))
    bench = rows.withColumn("_words", words).select("item", F.explode(_windows(F.col("_words"), own)).alias("w")).select("item", "w.n", "w.h", "w.h2").distinct()
    bench = saved(bench, "benchmark-windows")
    lengths = [r["n"] for r in bench.select("n").distinct().collect()]  # size values at most
    key = [F.xxhash64(text).alias("_k1"), F.hash(text, F.lit(1)).alias("_k2")]
    docs = df.select(*key, spaced(F.col(text)).alias("line")).where("line <> ''").withColumn("_words", words)
    every = F.concat(*[F.when(F.size("_words") >= n, _windows(F.col("_words"), F.lit(n))).otherwise(F.array()) for n in lengths]) if lengths else F.array().cast("array<struct<at:int,n:int,h:bigint,h2:int>>")
    hits = docs.select("_k1", "_k2", F.explode(every).alias("w")).select("_k1", "_k2", "w.*").join(bench, ["n", "h", "h2"])
    # of equal texts, and of windows that several items have, each once, before they are put together by text
    runs = hits.select("_k1", "_k2", "at", "n").distinct().groupBy("_k1", "_k2").agg(F.collect_list(F.struct("at", "n")).alias("_runs"))
    items = hits.select("_k1", "_k2", "item").distinct().groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = saved(runs.join(items, ["_k1", "_k2"]), "hits")  # its size is known, so whole texts aren't shuffled for a few
    line = spaced(F.col(text))
    n = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    out = df.select(*keep, *key, F.col(text).alias("_text"), n.cast("long").alias("n_words")).join(found, ["_k1", "_k2"], "left")
    out = out.select(*keep, "n_words", "items", F.arrow_udf(_runs_told, "n_hit long, spans array<struct<start:int,end:int>>")("_text", "_runs").alias("_told"))
    return out.select(*keep, "n_words", "_told.n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "_told.spans")


def contaminated(df: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """Adds n_words, n_hit (long), items (sorted ids as strings) and spans (code points of hit passages) to the columns in keep, or else all.

    A window is size consecutive words of an item, or all its words where it has fewer; an item without words has none. A word
    inside any occurrence of a window is hit. Null and empty texts have no words and no hits; an empty benchmark hits nothing. A null
    item id is written as null. Repeated rows give repeated results. Texts of any length are scanned whole. The columns that it adds replace columns of the same names.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in ("n_words", "n_hit", "items", "spans")]
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), spaced(F.col(item_text)).alias("line")).where("line <> ''").distinct()
    if (rows.agg(F.sum(F.size(word_list(F.col("line"))))).first()[0] or 0) > max_words:
        return _by_join(df, rows, size, text, keep)
    items = sorted((r["item"], r["line"]) for r in rows.collect())  # max_words words at most
    out = df.select(*keep, scan_udf(items, size)(F.col(text)).alias("_found"))
    return out.select(*keep, "_found.n_words", "_found.n_hit", "_found.items", "_found.spans")


by_value(__name__)
