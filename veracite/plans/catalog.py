"""Tables of a folder, and the views of them that the retrieval queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as an index: the label stands for the source, label % 3 for the jurisdiction, label 9 for withdrawn ones."""
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    return e.select(
        F.col("vec_id").alias("ord"), "embedding", F.concat(F.lit("j"), (label % 3).cast("string")).alias("jurisdiction"), F.array(F.concat(F.lit("s"), label.cast("string"))).alias("source_ids"),
        F.when(label == 9, "WITHDRAWN").otherwise("in_force").alias("status"), F.array(F.concat(F.lit("c"), F.col("vec_id").cast("string"))).alias("citations"), F.concat(F.lit("body of "), F.col("vec_id").cast("string")).alias("body"), label.alias("label"),
    )


def vector_queries(index: DataFrame) -> DataFrame:
    """The stated set of questions: every vector whose id is divisible by 50."""
    return index.where(F.col("ord") % 50 == 0).select(F.col("ord").alias("query_id"), "embedding", "label")
