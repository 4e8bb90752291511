"""Folders that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is unset, a temporary folder serves if all runs on this machine, as in tests; on a cluster its executors wouldn't see each other's files, so
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
