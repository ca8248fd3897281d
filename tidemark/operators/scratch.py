"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:  # glibc only
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None
#: Bytes of files or texts that a task hands on at once, and of those that it is handed; rows may be of any size.
PIECE = 8 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where driver and executors are one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what comes after starts there, also where an executor is lost."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and pools keep what they once held."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def reachable(spark: SparkSession) -> None:
    """Puts this package on the path of a local session's Python workers; on a cluster it is installed or shipped.

    Arrow batches end at PIECE bytes, as texts and files may be of any size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([root, *path])
