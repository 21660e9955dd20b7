"""The corpus pipeline: each stage works on all that the one before it kept, and returns the columns of documents.

Every stage reads whole texts; a null text counts as empty. Rows are judged one by one, by doc_id and text: rows that
repeat a doc_id with another text are documents of their own, and rows with equal doc_id and text share their lot. Empty
tables give empty results, and further columns of documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracite.llm.exact_dedup import exact_groups
from veracite.llm.packing import pack_documents
from veracite.llm.queries import WORD_TOKENIZER
from veracite.llm.runtime import Workspace, forget, fresh
from veracite.llm.simhash import distinct_documents
from veracite.llm.suffix_dedup import without_repeats
from veracite.llm.toxicity import scored, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the others stay as they are. A null text has the score of an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, train(docs, labels), keep=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, and those that repeat this doc_id and text. Rows without a
    doc_id stay only if no row with one has their text."""
    gone = exact_groups(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = fresh(docs.columns, "sha")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    rows = docs.withColumn(sha, F.sha2(body, 256))
    return rows.join(gone, (rows[sha] == gone["__sha"]) & rows["doc_id"].eqNullSafe(gone["__id"]), "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id stays, and
    rows that repeat it. Rows without a doc_id stay."""
    return distinct_documents(docs, 0.8, 5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the bytes covered by 50-byte strings of earlier documents; a character of which a byte
    is left stays whole, and n_chars follows. Null texts become empty. Rows that repeat a doc_id count in the order in
    which they are read, rows without one come first."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row per piece. Rows that repeat a doc_id are packed each; an empty text is one token."""
    return pack_documents(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: SQL has no fitted classifier, fingerprint links or best-fit sweep: tests/llm/test_pipeline.py holds the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again as the next one's input."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.table(docs, name)
            forget(spark)
    return docs
