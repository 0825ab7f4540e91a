"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names; only where that is unset, as in local tests, a temporary folder stands in."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="quarrylight-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own there; whoever writes to it removes it (sources.hadoop.Files.delete)."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of what is no longer referenced, which it else does when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
