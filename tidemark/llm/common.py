"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_dir

#: White space of the word rules: space and the control characters tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
#: Everything that separates words of letters and digits, once A-Z are lower case.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; timestamps stay without a zone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the session has cores, dealt out over these; one of more files stays as it is, so only small inputs are shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def saved(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The frame as written to the shared folder: its lineage is cut and a lost executor costs nothing. Texts are worth zstd, hashes aren't."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frame of saved() with a hint to broadcast it if it has so many rows at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: Column) -> Column:
    """The words of a text (runs of 0-9, a-z and everything beyond ASCII), lower case, one space between; null: empty."""
    return F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), GAP, " "), F.lit(" "))


def word_list(line: Column) -> Column:
    """The words of a line made by spaced()."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once: Arrow batches of so many texts, where the session has more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def by_value(name: str) -> None:
    """Sends the functions of this module along with the plan, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks under this key; of each kind (the key's first part) only the last, and of all kinds two.

    Workers serve one stage after another, so what an earlier stage kept is let go.
    """
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__.setdefault("kept", {})
    found = kept.pop(key[0], None)
    if found is None or found[0] != key:
        found = None
        for kind in list(kept)[:-1]:
            del kept[kind]
        gc.collect()
        pa.default_memory_pool().release_unused()
        found = (key, make())
    kept[key[0]] = found
    return found[1]


by_value(__name__)
