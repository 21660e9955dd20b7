"""Exact dedup by content-defined chunk recipes.

A text (null counts as empty; each run of ASCII white space becomes one space) is cut where a rolling hash of its last
16 bytes says so. A chunk's identifier is a 128-bit digest that has been verified: every distinct content of a digest
is compared, and where two contents share one, each gets a number of its own in the identifier. A document's recipe is
the ordered list of its identifiers, so two texts are equal exactly if their recipes are. Long texts move once, as
distinct chunks; grouping, choosing and joining handle recipes only.

Ties and odd rows: of equal texts the smallest doc_id stays. A null doc_id never wins against a number; rows that repeat
the winning doc_id stay with it. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .runtime import Workspace, texts

#: Chunk sizes in bytes: least, usual (a power of two), most.
LEAST, USUAL, MOST = 512, 2048, 16384
_GEAR = np.random.RandomState(20240229).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def normalise(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] becomes one space."""
    if not text:
        return text
    white = b" \t\n\r\x0b\x0c"
    out = b" ".join(text.split())
    if not out:
        return b" "
    return b" " * (text[0] in white) + out + b" " * (text[-1] in white)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data; none for empty data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # doubles the window, to 16 bytes
        low = h[:-step] << np.uint32(step)
        h[step:] += low
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - USUAL.bit_length() + 1) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] if n > last else ends


def _digest(chunk: bytes, width: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:width]


def _chunks(data: bytes) -> Iterator[bytes]:
    last = 0
    for end in cuts(data):
        yield data[last:end]
        last = end


def recipes(docs: DataFrame, width: int = 16) -> DataFrame:
    """(doc_id, recipe, text_sha256): one row per document."""

    def run(batches):
        for b in batches:
            recipe, sha = [], []
            for t in texts(b):
                t = normalise(t)
                recipe.append(b"".join(_digest(c, width) for c in _chunks(t)))
                sha.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, recipe binary, text_sha256 string")


def chunk_rows(docs: DataFrame, width: int = 16, place: bool = False) -> DataFrame:
    """(digest, content) of every chunk; with place also doc_id, text_sha256 and seq. Repeats within a batch go once if without place."""
    kind = "digest binary, content binary" + ", doc_id long, text_sha256 string, seq long" * place

    def run(batches):
        for b in batches:
            seen: dict[bytes, bytes] = {}
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            for i, t in enumerate(texts(b)):
                t = normalise(t)
                sha = hashlib.sha256(t).hexdigest() if place else ""
                for seq, c in enumerate(_chunks(t)):
                    if place:
                        rows.append((_digest(c, width), c, ids[i], sha, seq))
                    else:
                        seen[c] = _digest(c, width)
            if place:
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["digest", "content", "doc_id", "text_sha256", "seq"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], ["digest", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def exact_groups(docs: DataFrame, width: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document. width: bytes of a digest, fewer only in tests."""
    ws = Workspace(docs.sparkSession, "exact-dedup")
    rows = ws.table(recipes(docs, width), "recipes")
    distinct = chunk_rows(docs, width).distinct()
    shared = ws.table(distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared")
    if not shared.isEmpty():  # contents that share a digest: number them, and put the numbers into the recipes
        number = F.row_number().over(W.Window.partitionBy("digest").orderBy("content"))
        named = distinct.join(shared, "digest", "left_semi").withColumn("number", number)
        placed = chunk_rows(docs, width, True).join(named, ["digest", "content"])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "number"))), lambda x: F.concat_ws(":", x["seq"], x["number"]))
        numbers = placed.groupBy("doc_id", "text_sha256").agg(F.concat_ws(",", F.array_distinct(listed)).alias("numbers"))
        numbers = ws.table(numbers.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), "numbers"), "numbers")
        rows = rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left")
        rows = rows.withColumn("recipe", F.concat("recipe", F.encode(F.coalesce(F.concat(F.lit("|"), "numbers"), F.lit("")), "utf-8")))
        rows = ws.table(rows.select("doc_id", "recipe", "text_sha256"), "numbered")
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    groups = ws.table(groups, "groups")
    # Both sides are written tables: the join deals out its own rows, and adaptive execution splits a hot recipe.
    out = rows.join(groups, "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
