"""Streams of filings: an addition to the batch operators, with the same rules for staleness."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.archives import ROWS, zipped_rows


def incremental_load(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Loads files that are new since the last run, then stops; which files are done is in the checkpoint."""
    rows = spark.readStream.schema(schema).format(fmt).load(source).withColumn("source_archive", F.col("_metadata.file_name"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def load_archives(spark: SparkSession, source: str, sink: str, ledger: str, checkpoint: str, pattern: str, sep: str = ",", quote: str = '"', encoding: str = "UTF-8") -> StreamingQuery:
    """Loads the rows of archives in a folder that the ledger doesn't name yet, then stops.

    A batch writes its rows to a folder of its number and load, and then, as its commit, the names of its archives to a folder of the same name in the ledger. What fails in
    between leaves rows that no ledger names: loaded() doesn't see them, and the batch, which the stream repeats under the same number, replaces them. A load with a new checkpoint numbers its
    batches anew under a name of its own, and takes what the ledger names for done.
    """
    load = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    kind = "path string, modificationTime timestamp, length long, content binary"

    def commit(batch: DataFrame, number: int) -> None:
        at = f"batch={load}-{number}"
        names = batch.select(F.col("path").alias("source_archive")).distinct()
        done = _ledger(spark, ledger)
        # what this very batch has committed before is loaded again, by the same names, so a repeated batch changes nothing
        new = names.join(done.where(F.col("batch") != at[6:]), "source_archive", "left_anti")
        rows = zipped_rows(new.withColumnRenamed("source_archive", "path"), pattern, sep, quote, encoding)
        rows.write.mode("overwrite").parquet(f"{sink}/{at}")
        new.write.mode("overwrite").parquet(f"{ledger}/{at}")

    files = spark.readStream.schema(kind).format("binaryFile").option("pathGlobFilter", "*.zip").load(source).select("path")
    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """source_archive and batch of all that is committed; nothing where no ledger is yet."""
    kind = "source_archive string, batch string"
    try:
        return spark.read.schema(kind).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def loaded(spark: SparkSession, sink: str, ledger: str) -> DataFrame:
    """Rows of archives whose batch is committed, each archive's by the batch that the ledger names."""
    rows = spark.read.schema(f"{ROWS}, batch string").parquet(sink)
    return rows.join(_ledger(spark, ledger), ["source_archive", "batch"], "left_semi")


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str, value: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window and keys; rows later than the watermark are left out."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_filings(events: DataFrame, time: str, keys: list[str], horizon: str) -> DataFrame:
    """The first row of each key within the horizon; state older than that is dropped."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def stale(date: Column, as_of: Column, months: int = 15) -> Column:
    return date < F.add_months(as_of, -months)
