"""Search for people by parts of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More buckets than this for every word typed: the search is too broad.
MAX_BUCKETS = 3


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]+"), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """Words of two letters or more of what was typed."""
    return [w for w in "".join(c if "a" <= c <= "z" else " " for c in query.lower()).split() if len(w) >= 2]


def search_people(df: DataFrame, name: str, query: str, limit: int = 8, key: str | None = None) -> DataFrame:
    """People of whose name every word typed starts a word: those whose last word is the last one typed first, then by name, then by key where one is given."""
    words = query_words(query)
    if not words:
        return df.limit(0)
    has = tokens(F.col(name))
    match = F.lit(True)
    for w in words:
        match = match & F.exists(has, _starts(w))
    return df.where(match).orderBy(F.desc(F.coalesce(F.element_at(has, -1) == words[-1], F.lit(False))), name, *([key] if key else [])).limit(limit)


def _starts(word: str):
    return lambda t: F.startswith(t, F.lit(word))


def buckets_for(directory: DataFrame, prefix: str) -> DataFrame:
    """Of a directory (bucket, first), the buckets that can hold words with this start: from the last that begins before it on."""
    before = directory.where(F.col("first") < prefix).agg(F.coalesce(F.max("bucket"), F.lit(0)).alias("_from"))
    return directory.join(F.broadcast(before), F.col("bucket") >= F.col("_from")).where(F.col("first") < prefix + "{").drop("_from")  # one row is broadcast


def bucket_spans(directory: DataFrame, words: list[str]) -> dict[str, tuple[int, int]]:
    """The first and last bucket that can hold words with each start: one row, whatever the directory's size. A directory without buckets has no span."""
    if not words:
        return {}
    ends = [F.max(F.when(F.col("first") < F.lit(w + x), F.col("bucket"))) for w in words for x in ("", "{")]
    row = directory.agg(F.min("bucket"), *ends).first()
    low = lambda i: row[0] if row[i] is None else row[i]
    return {} if row[0] is None else {w: (low(1 + 2 * i), row[2 + 2 * i]) for i, w in enumerate(words) if row[2 + 2 * i] is not None}


def too_broad(directory: DataFrame, query: str) -> bool:
    """Whether even the rarest word typed reaches over too many buckets."""
    words = query_words(query)
    spans = bucket_spans(directory, words)
    return bool(words) and all(w in spans and spans[w][1] - spans[w][0] >= MAX_BUCKETS for w in words)


def search_folder(spark: SparkSession, folder: str, key: str, name: str, query: str, limit: int = 8) -> DataFrame:
    """What search_people() finds (key and name), from the buckets that sinks.write_buckets() wrote, of which only those of the words typed are read.

    Each word that lies within MAX_BUCKETS buckets reads these, pruned by their folders; the keys that all such words lead to meet, and only their names are looked at for the other words. No
    word that few buckets hold: the search is too broad, which is an error; a word that no bucket can hold finds nothing.
    """
    words, directory = query_words(query), spark.read.parquet(f"{folder}/directory")
    postings = spark.read.parquet(f"{folder}/postings")
    spans = bucket_spans(directory, words)
    if not words or any(w not in spans for w in words):
        return postings.select(key, name).limit(0)
    narrow = [w for w in words if spans[w][1] - spans[w][0] < MAX_BUCKETS]
    if not narrow:
        raise ValueError(f"{query} is too broad: every word reaches over more than {MAX_BUCKETS} buckets")
    entries = lambda w: postings.where(F.col("bucket").between(*spans[w]) & F.startswith("token", F.lit(w)))
    narrow.sort(key=lambda w: (spans[w][1] - spans[w][0], -len(w)))
    found = entries(narrow[0]).select(key, name).distinct()
    for w in narrow[1:]:
        found = found.join(entries(w).select(key), key, "left_semi")
    return search_people(found, name, query, limit, key)
