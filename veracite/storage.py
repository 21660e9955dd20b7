"""Results that are kept: checkpoints and numbered rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that the cluster shares; it outlives lost executors."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="veracite-")
            atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a column that counts its rows from 0 in this order, without a window over all rows.

    The rows are range-sorted and kept; a row's number is its place in its range plus the sizes of the ranges before it.
    What reaches the driver is one count per range. Rows that tie in all of `order` are numbered as they come.
    """
    kept = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = checkpointed(kept)
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__p int, __before long")
    out = kept.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__before")


def running_sums(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df (key, order, value), in which no two rows have one key and order, with `before` and `total`: the sum of `value`
    over the rows of its key before it, and over all of them; without a window over all rows of a key.

    The rows are range-sorted and kept. Each range adds up its own rows, and the sums of the ranges, one for each key in a
    range, are added up per key: a task has a range of rows, or as many sums as there are ranges.
    """
    kept = checkpointed(df.select(key, order, F.col(value).cast("long").alias(value)).repartitionByRange(key, order).withColumn("__p", F.spark_partition_id()))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.sum(value).over(preceding(Window.partitionBy("__p", key).orderBy(order)))
    sums = kept.groupBy(F.col("__p").alias("__q"), F.col(key).alias("__key")).agg(F.sum(value).alias("__n"))
    by_key = Window.partitionBy("__key")
    sums = sums.withColumn("__ranges", F.coalesce(F.sum("__n").over(preceding(by_key.orderBy("__q"))), F.lit(0))).withColumn("total", F.sum("__n").over(by_key))
    rows = kept.withColumn("__own", F.coalesce(own, F.lit(0))).join(sums, (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__key")))
    return rows.select(key, order, value, (F.col("__ranges") + F.col("__own")).alias("before"), "total")


def first_rows(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, ranked from 1; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
