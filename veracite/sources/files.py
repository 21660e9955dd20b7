"""Whole files through Hadoop's file systems, whatever store they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, stem, value): one row per file of a folder; order comes from stem, never from partitions."""
    pattern = f"{path.rstrip('/')}/*{suffix}"
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    return rows.select("path", F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("stem"), "value")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written under another name and renamed, so that no reader meets half a file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} couldn't be written")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content)
