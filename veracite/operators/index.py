"""The index: chunks with their vectors in one table, built so that a run that was cut off goes on where it stopped."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..sources.files import exists
from .chunk import structural
from .dedup import deduplicate
from .ingest import corpus_units

DIM = 256
MODEL = f"hashed-words-{DIM}"
Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors from signed hashes of lower-case words and word pairs. It needs no model, and no network."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        pairs = (f"{a} {b}" for a, b in zip(words, words[1:]))
        h = np.fromiter((zlib.crc32(w.encode()) for w in chain(words, pairs)), np.uint32)
        out[i] = np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def with_vectors(df: DataFrame, text: str, column: str = "embedding", encoder: Encoder = hashed_words, batch: int = 8) -> DataFrame:
    """df with the vectors of a text column; a null text counts as empty. A Python worker holds one bounded Arrow batch of
    texts, the strings of `batch` of them, and their vectors as arrays, never as lists of Python's floats."""

    reachable(df.sparkSession)

    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            if len(s):
                v = np.concatenate([np.asarray(encoder(s.slice(i, batch).fill_null("").to_pylist()), np.float32) for i in range(0, len(s), batch)])
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))

    return df.withColumn(column, F.arrow_udf(encode, "array<float>")(F.col(text)))


def fingerprints(chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """(f), one row: a SHA-256 over the model and every chunk's id, tokens and text, whatever their order: each chunk's own digest is
    cut to 60 bits twice, and the sums over all chunks are hashed. A text that changes changes it."""
    own = F.sha2(F.concat_ws("\x1f", "chunk_id", F.col("n_tokens").cast("string"), "embed_text"), 256)
    part = lambda a: F.sum(F.conv(F.substring(own, a, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return chunks.agg(F.sha2(F.concat_ws("|", F.lit(model), F.count("*").cast("string"), part(1), part(16)), 256).alias("f"))


def fingerprint(chunks: DataFrame, model: str = MODEL) -> str:
    return fingerprints(chunks, model).first().f


def build_chunks(spark: SparkSession, xml_folder: str, text_folder: str) -> DataFrame:
    return deduplicate(structural(corpus_units(spark, xml_folder, text_folder)))


def embed(chunks: DataFrame, path: str, model: str = MODEL, encoder: Encoder = hashed_words, passes: int = 1) -> DataFrame:
    """The vectors (ord, embedding, body_embedding) of chunks, kept below path by fingerprint; chunks that have them already
    are left out, so a repeated run does only what is missing. Work is dealt out by length: a batch has texts of like size.
    passes: into how many separately committed shares the missing chunks go."""
    spark = chunks.sparkSession
    folder = f"{path.rstrip('/')}/vectors/{fingerprint(chunks, model)}"
    for i in range(passes):
        left = chunks.where(F.pmod(F.xxhash64("ord"), F.lit(passes)) == i) if passes > 1 else chunks
        if exists(spark, f"{folder}/share-*/_SUCCESS"):
            done = spark.read.parquet(f"{folder}/share-*").select("ord")
            left = left.join(done, "ord", "left_anti")
            if left.isEmpty():
                continue
        dealt = left.select("ord", "n_tokens", "embed_text", "body").repartitionByRange("n_tokens", "ord").sortWithinPartitions("n_tokens")
        made = with_vectors(with_vectors(dealt, "embed_text", "embedding", encoder), "body", "body_embedding", encoder)
        n = 0
        while exists(spark, f"{folder}/share-{i}-{n}/_SUCCESS"):
            n += 1
        made.select("ord", "embedding", "body_embedding").write.mode("overwrite").parquet(f"{folder}/share-{i}-{n}")
    return spark.read.parquet(f"{folder}/share-*")


def checked_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with their vectors. A chunk without a vector, or a vector without a chunk, raises where it is read."""
    v = vectors.withColumnRenamed("ord", "v_ord")
    j = chunks.join(v, F.col("ord") == F.col("v_ord"), "full_outer")
    bad = F.when(F.col("ord").isNull(), F.concat(F.lit("index corrupt: no chunk for vector "), F.col("v_ord").cast("string"))).when(F.col("v_ord").isNull(), F.concat(F.lit("index corrupt: no vector for chunk "), "chunk_id"))
    return j.withColumn("ord", F.when(bad.isNotNull(), F.raise_error(bad).cast("long")).otherwise(F.col("ord"))).drop("v_ord")


def build(spark: SparkSession, xml_folder: str, text_folder: str, path: str, model: str = MODEL, encoder: Encoder = hashed_words) -> DataFrame:
    """Builds the index below path: chunks with their vectors, and meta."""
    chunks = build_chunks(spark, xml_folder, text_folder)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    index = checked_index(chunks, embed(chunks, path, model, encoder))
    index.write.mode("overwrite").parquet(f"{path}/index")
    size = F.max(F.size("embedding")).alias("dim")
    meta = index.agg(F.count("*").alias("n_chunks"), size).withColumn("model", F.lit(model)).withColumn("fingerprint", F.lit(fingerprint(chunks, model)))
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index below path; FileNotFoundError if it hasn't been built."""
    if not exists(spark, f"{path}/index/_SUCCESS"):
        raise FileNotFoundError(f"no index below {path}: build it first")
    return spark.read.parquet(f"{path}/index")


def meta(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(f"{path}/meta").first().asDict()
