"""Sinks: refresh, replace by archive, upsert, guarded documents, shards and search buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import shared_dir
from ..operators.asof import latest


def refresh(df: DataFrame, path: str) -> None:
    """Replaces the whole table."""
    df.write.mode("overwrite").parquet(path)


def replace_archives(df: DataFrame, path: str, column: str = "source_archive") -> None:
    """Replaces the rows of those archives that df has rows of; others stay, so a repeated load changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], tie: list[Column] = ()) -> DataFrame:
    """Rows of both, the new one where both have a key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc("_new"), *tie]).drop("_new")


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: list[str], parts: int = 64) -> None:
    """Replaces a table by df, laid out by a hash of its keys: part_of_<parts> is the folders' column, so a table is only ever read with as many parts as it has."""
    df.withColumn(f"part_of_{parts}", _part(keys, parts)).repartition(parts, f"part_of_{parts}").write.mode("overwrite").partitionBy(f"part_of_{parts}").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table without its layout."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith("part_of_")])


def upsert_keyed(new: DataFrame, path: str, keys: list[str], parts: int = 64, tie: list[Column] = ()) -> list[int]:
    """Puts new rows into a table of write_keyed(), over those of their keys, and returns the parts that it has written anew.

    Only parts that a new row falls into are read, merged and written: their numbers, `parts` at most, are all that comes to the driver. The merged rows are staged in the shared folder first, so
    the table isn't overwritten while it is read, and a failure before the last write leaves it as it was. Of several new rows of a key the first by tie stays.
    """
    spark, column = new.sparkSession, f"part_of_{parts}"
    new = new.withColumn(column, _part(keys, parts))
    touched = sorted(r[0] for r in new.select(column).distinct().collect())
    if not touched:
        return []
    old = spark.read.parquet(path)
    if column not in old.columns:
        raise ValueError(f"{path} isn't laid out in {parts} parts")
    staged = shared_dir(spark, "upsert")
    upsert(old.where(F.col(column).isin(touched)), new.select(*old.columns), keys, tie).write.parquet(staged)
    spark.read.parquet(staged).repartition(len(touched), column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return touched


def stamped(df: DataFrame, when: Column, column: str, value: Column) -> DataFrame:
    """A progress stamp on the rows that a condition holds for."""
    return df.withColumn(column, F.when(when, value).otherwise(F.col(column)))


def export_json(df: DataFrame, path: str) -> bool:
    """Writes JSON documents unless df is empty, so that an old export isn't lost to an empty input."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def shard(key: Column, n: int = 32) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


def write_shards(df: DataFrame, path: str, key: str, n: int = 32) -> None:
    df.withColumn("shard", shard(F.col(key), n)).write.mode("overwrite").partitionBy("shard").parquet(path)


def split_long_lists(df: DataFrame, list_column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """df with lists longer than most emptied, a flag and their sizes; and the rows with long lists."""
    long = F.size(list_column) > most
    short = df.withColumns({"own_file": long, "n_items": F.size(list_column)}).withColumn(list_column, F.when(~long, F.col(list_column)))
    return short, df.where(long)


def name_tokens(name: Column) -> Column:
    """The different words of a name: runs of a-z and 0-9, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def search_buckets(df: DataFrame, key: str, name: str, size: int = 4000) -> DataFrame:
    """token, key, name, bucket: every word of a name in order, cut into buckets of about size entries that begin at equal steps of the order.

    The different words are put in order by range partitions of their own, written once, so that all that follows sees the same partitions: a word's place is what its partition's words before it
    have and what the partitions before have, a row for each. No task gets all words, however alike they begin.
    """
    spark = df.sparkSession
    tokens = df.select(F.explode(name_tokens(F.col(name))).alias("token"), key, name)
    counts = tokens.groupBy("token").agg(F.count("*").alias("_n"))
    path = shared_dir(spark, "words")
    counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "token").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.parquet(path)
    upto = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", upto(Window.orderBy("_part"), "_all").alias("_before"))
    own = counts.withColumn("_own", upto(Window.partitionBy("_part").orderBy("token"), "_n")).join(F.broadcast(parts), "_part")  # a row for each partition
    return tokens.join(own.select("token", F.floor((F.col("_before") + F.col("_own")) / size).cast("long").alias("bucket")), "token")


def write_buckets(df: DataFrame, folder: str, key: str, name: str, size: int = 4000) -> None:
    """Search buckets as a folder each, words in order within, and their directory beside them."""
    search_buckets(df, key, name, size).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    bucket_directory(df.sparkSession.read.parquet(f"{folder}/postings")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory")


def bucket_directory(buckets: DataFrame) -> DataFrame:
    """The first token and number of entries of each bucket."""
    return buckets.groupBy("bucket").agg(F.min("token").alias("first"), F.count("*").alias("n"))


def oversized(df: DataFrame, document: Column, most_bytes: int) -> DataFrame:
    """Total size of documents, and whether it goes beyond a limit."""
    return df.agg(F.sum(F.octet_length(document)).alias("bytes")).withColumn("too_large", F.col("bytes") > most_bytes)


def pages(df: DataFrame, title: str, rows: dict[str, str]) -> DataFrame:
    """A page of HTML for each row, values escaped: the title and a list of labels with values; nulls are left out."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    items = F.concat_ws("", *[F.concat(F.lit(f"<dt>{label}</dt><dd>"), safe(c), F.lit("</dd>")) for label, c in rows.items()])
    return df.withColumn("page", F.concat(F.lit("<!doctype html><title>"), safe(title), F.lit("</title><h1>"), safe(title), F.lit("</h1><dl>"), items, F.lit("</dl>")))


def sitemap(urls: DataFrame, url: str, date: str) -> DataFrame:
    """An entry of a sitemap for each address."""
    return urls.select(F.concat(F.lit("<url><loc>"), F.replace(F.col(url), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.date_format(date, "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("entry"))
