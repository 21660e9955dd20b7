"""Plumbing shared by the operators: shared work folders, written tables, bounded Arrow batches."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where none is named (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="veracite-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    # One name for Spark and for the executors' own files: a path without a scheme belongs to Hadoop's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of these columns has."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def prepare(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, and lets local Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _REPO not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_REPO, path) if x)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver's JVM
    collects its garbage: by default every half hour."""
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """A folder of written tables in the shared root. Written tables cut lineage and outlive lost executors.

    The folder goes with close(), or when the driver ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        prepare(spark)
        self.spark, self.uri = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.uri}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder, for executors that write or read whole binary files.

    Works for file:, hdfs:, s3: (s3a:), gs: and plain paths, whatever pyarrow was built with.
    """
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri[6:]
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes under a temporary name, then renames: a lost or repeated task leaves whole files only."""
    files, path = file_system(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part, compression=None) as out:
        out.write(data)
    files.move(part, path)


def read_file(uri: str) -> bytes:
    files, path = file_system(uri)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()


def texts(batch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
