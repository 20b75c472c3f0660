"""Sinks: exports in several formats, partition overwrite by document, event logs, artifact manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import scratch
from pyspark.sql import types as T

FORMATS = ("jsonl", "csv", "tsv", "parquet", "sqlite")


def rendered(df: DataFrame) -> DataFrame:
    """Every column as text: null is empty, booleans true/false, nested values JSON."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)
        return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema])


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames under the union of their columns, in order of first appearance."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def filtered(df: DataFrame, page_start: int | None = None, page_end: int | None = None, signals: list[str] | None = None) -> DataFrame:
    """Rows of a page range (rows without pages pass) with any of the signals."""
    first, last = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    if page_start:
        df = df.where(last.isNull() | (last >= page_start))
    if page_end:
        df = df.where(first.isNull() | (first <= page_end))
    return df.where(F.arrays_overlap("quality_signal_codes", F.array(*map(F.lit, signals)))) if signals else df


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Write in one of FORMATS. SQLite has one writer, so it streams partition by partition through the driver
    in bounded batches; every other format is written by the executors."""
    if fmt == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt in ("csv", "tsv"):
        rendered(df).write.mode("overwrite").csv(path, header=True, sep="," if fmt == "csv" else "\t", escape='"', emptyValue="")
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "sqlite":
        import sqlite3

        flat = rendered(df)
        with sqlite3.connect(path) as db:
            db.execute("drop table if exists rows")
            db.execute(f"create table rows ({', '.join(chr(34) + c.replace(chr(34), chr(34) * 2) + chr(34) + ' text' for c in flat.columns)})")
            batch: list[tuple] = []
            for r in flat.toLocalIterator():
                batch.append(tuple(r))
                if len(batch) == 5000:
                    db.executemany(f"insert into rows values ({','.join('?' * len(flat.columns))})", batch)
                    batch = []
            db.executemany(f"insert into rows values ({','.join('?' * len(flat.columns))})", batch)
    else:
        raise ValueError(f"unknown format {fmt}; one of {', '.join(FORMATS)}")


def export_package(frames: dict[str, DataFrame], path: str, fmt: str = "jsonl") -> DataFrame:
    """Several datasets in one folder, and the manifest (dataset, rows) as a frame, written beside them."""
    for name, df in frames.items():
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"bad dataset name {name!r}")
        export(df, f"{path}/{name}", fmt)
    counts = [df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows")) for name, df in frames.items()]
    manifest = union_of(counts)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


BUCKETS = 256


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.hash("tenant_id", "doc_id"), F.lit(buckets)))


def save_by_document(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Delete-then-insert per (tenant_id, doc_id).  Documents lie in folders by a hash of their key, so their number does not make
    folders; only the folders of the documents in ``df`` are written anew, with the other documents that they hold.  Keep ``buckets`` for a path."""
    spark, key = df.sparkSession, ["tenant_id", "doc_id"]
    new = bucketed(df, buckets)
    if scratch.status(spark, path) == "folder":
        new = scratch.written(new, "saved")  # read twice, and not again while its folders are replaced
        old = spark.read.parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select(*key).distinct(), key, "left_anti")
        new = scratch.written(new.unionByName(old.select(new.columns)), "saved")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only event log with sensitive fields redacted."""
    from lexmill.operators.metrics import redact

    events.withColumn("fields", redact(F.col("fields"))).write.mode("append").json(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of ``binaryFile`` rows."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
