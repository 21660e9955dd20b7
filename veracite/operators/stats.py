"""Figures about a corpus and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot
from ..storage import first_rows


def chunk_stats(chunks: DataFrame, by: str = "source_id", tokens: str = "n_tokens") -> DataFrame:
    """(by, n, median, most, total) for each source, and for all as TOTAL; one pass by grouping sets."""
    g = chunks.groupingSets([[by], []], by).agg(F.grouping(by).alias("whole"), F.count("*").alias("n"), F.median(tokens).alias("median"), F.max(tokens).alias("most"), F.sum(tokens).alias("total"))
    return g.select(F.when(F.col("whole") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias(by), "n", "median", "most", "total")


def same_body_pairs(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of left beside the row of right with the same body (the last of them by ord): body_key, and columns as a_*, b_*."""
    key = lambda df: df.withColumn("body_key", F.sha2("body", 256))
    r = key(right).groupBy("body_key").agg(F.max_by(F.struct(*columns), "ord").alias("b"))
    j = key(left).select("body_key", F.struct(*columns).alias("a")).join(r, "body_key")
    return j.select("body_key", *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns])


def bodies_by_source(rows: DataFrame) -> DataFrame:
    """(body_key, source, last_doc, n_docs) for each body that two or more sources have, from rows (doc_id, text, source)."""
    g = rows.groupBy(F.sha2("text", 256).alias("body_key"), "source").agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"))
    g = g.withColumn("n", F.count("*").over(Window.partitionBy("body_key")))
    return g.where("n > 1").drop("n")


def bodies_elsewhere(rows: DataFrame) -> DataFrame:
    """(doc_id, other_doc, body_key): each row whose text another source has too, beside the last row of it there.

    Sources' last rows are found before anything is joined, and of a text's sources only the two with the last rows matter.
    """
    keyed = rows.select("doc_id", "source", F.sha2("text", 256).alias("body_key"))
    last = keyed.groupBy("body_key", "source").agg(F.max("doc_id").alias("last_doc"))
    two = first_rows(last, ["body_key"], [F.desc("last_doc")], 2).groupBy("body_key").agg(
        F.max(F.when(F.col("rank") == 1, F.col("source"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("last_doc"))).alias("best_doc"), F.max(F.when(F.col("rank") == 2, F.col("last_doc"))).alias("second_doc")
    )
    j = keyed.join(two.where("second_doc is not null"), "body_key")
    return j.select("doc_id", F.when(F.col("source") == F.col("best"), F.col("second_doc")).otherwise(F.col("best_doc")).alias("other_doc"), "body_key")


def shared_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that both have."""
    return left.select(column).intersect(right.select(column))


def likeness(pairs: DataFrame, a: Column, b: Column, above: float = 0.99) -> DataFrame:
    """(mean, least, most, n_above, n) of the inner products of two vector columns."""
    s = pairs.select(dot(a, b).alias("s"))
    return s.agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"), F.count_if(F.col("s") > above).alias("n_above"), F.count("*").alias("n"))


def header_check(left: DataFrame, right: DataFrame, above: float = 0.99) -> DataFrame:
    """How far headers set equal bodies apart: likeness of their vectors (variant, mean, least, most, n_above, n), with and
    without the header, over the pairs of two parts of an index (ord, body, embedding, body_embedding)."""
    pairs = same_body_pairs(left, right, ["embedding", "body_embedding"])
    variants = [("with header", "embedding"), ("no header", "body_embedding")]
    with_, without = (likeness(pairs, F.col(f"a_{c}"), F.col(f"b_{c}"), above).withColumn("variant", F.lit(v)) for v, c in variants)
    return with_.unionByName(without).select("variant", "mean", "least", "most", "n_above", "n")


def pair_pool(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (ord, columns) of both parts that are in pairs of equal bodies, each once: what a probe of both searches."""
    pairs = same_body_pairs(left, right, ["ord", *columns])
    sides = [pairs.select(*[F.col(f"{s}_{c}").alias(c) for c in ("ord", *columns)]) for s in "ab"]
    return sides[0].unionByName(sides[1]).dropDuplicates(["ord"])
