"""Chunks with one body become one chunk that carries every citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_LISTS = ["citations", "source_ids", "statuses", "jurisdictions"]


def distinct_lists(rows: DataFrame, key: str, order: str, lists: list[str]) -> DataFrame:
    """(key, first_ord, n, *lists): for each key the distinct values of each array column, by first appearance.

    Values are counted out per key before they are listed, so a key that a third of all rows share costs each task one row
    per distinct value, and no list holds more than distinct values.
    """

    def tag(c: str):
        return F.transform(F.col(c), lambda x, i: F.struct(F.lit(c).alias("kind"), x.alias("value"), i.alias("pos")))

    tagged = [tag(c) for c in lists]
    values = rows.select(key, order, F.explode(F.concat(*tagged, F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit(0).alias("pos"))))).alias("v")).select(key, order, "v.*")
    firsts = values.groupBy(key, "kind", "value").agg(F.min(F.struct(order, "pos")).alias("first"), F.count("*").alias("n"))
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("first", "value")))), lambda x: x["value"]).alias(c)
    head = F.col("kind") == ""
    return firsts.groupBy(key).agg(F.min(F.when(head, F.col(f"first.{order}"))).alias("first_ord"), F.max(F.when(head, F.col("n"))).alias("n"), *[own(c) for c in lists])


def deduplicate(chunks: DataFrame) -> DataFrame:
    """Chunks of equal body become the first of them, with the citations and sources of all; others stay as they are.

    A merged chunk's citations are ordered by scope, and its header, ids and tokens are made again. It keeps the status and
    the jurisdiction of the first; `statuses` and `jurisdictions` have those of all. Bodies are compared by SHA-256, so the
    grouping moves digests; texts move once, to meet the decisions.
    """
    c = chunks.withColumn("body_sha", F.sha2("body", 256))
    merged = distinct_lists(c, "body_sha", "ord", _LISTS).withColumnsRenamed({x: f"all_{x}" for x in _LISTS})
    m = c.join(merged.withColumnRenamed("body_sha", "sha").drop("n"), (F.col("body_sha") == F.col("sha")) & (F.col("ord") == F.col("first_ord")))
    many = F.size("all_citations") > 1
    cites = F.when(many, T.ordered_citations(F.col("all_citations"))).otherwise(F.col("all_citations"))
    first_line = F.substring_index("embed_text", "\n\n", 1)
    heading = F.trim(F.when(F.contains(first_line, F.lit("|")), F.regexp_extract(first_line, r"(?s)^(.*)\|", 1)).otherwise(first_line))
    ids = F.array_join("all_source_ids", "+")
    embedded = F.when(many, F.concat(heading, F.lit(" | "), F.array_join(cites, "; "), F.lit("\n\n"), F.col("body"))).otherwise(F.col("embed_text"))
    out = {
        "chunk_id": F.when(many, F.concat(F.lit("merged:"), ids, F.lit(":"), cites[0])).otherwise(F.col("chunk_id")), "embed_text": embedded, "source_id": F.when(many, ids).otherwise(F.col("source_id")),
        "citations": cites, "n_tokens": F.when(many, T.token_estimate(embedded)).otherwise(F.col("n_tokens")), "source_ids": F.col("all_source_ids"), "statuses": F.col("all_statuses"), "jurisdictions": F.col("all_jurisdictions"),
    }
    return m.select(*[out.get(x, F.col(x)).alias(x) for x in chunks.columns], F.col("body_sha").alias("body_key"))
