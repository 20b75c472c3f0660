"""Scratch tables in the shared folder of the cluster (``spark.checkpoint.dir``), and rows dealt to as many tasks as the input asks for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Bytes of the largest input's files for a task, and what Spark says where it doesn't know a size.
A_PART, UNKNOWN = 4 << 20, 1 << 60


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own serves only where the setting is absent and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="lexmill-"))


def status(spark: SparkSession, path: str) -> str:
    """"folder", "file" or "none": what a path of any of Hadoop's file systems is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return ("folder" if fs.getFileStatus(p).isDirectory() else "file") if fs.exists(p) else "none"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once and read it back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(*frames: DataFrame, a_part: int = A_PART) -> int:
    """How many tasks to deal rows of these frames to: one for each ``a_part`` bytes of the largest table that they read, so that a task's
    rows do not grow with the input; at least Spark's own number.  Frames of the same tables get the same number."""
    most = 0
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        most = max([most, *[x for x in sizes if x < UNKNOWN]])
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // a_part))
