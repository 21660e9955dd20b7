"""Exact nearest neighbours for batches of questions, one stage or two.

Questions are a stated set; they go to the executors in blocks of a fixed size, and each block meets every row of the
index in one scan, as a matrix product per Arrow batch. A task keeps k rows per question, so what is shuffled is
questions * tasks * k short rows, however large the index. Filters come first and reach the scan.

Scores are summed in double. Ties go to the smaller `ord`. Vectors that are null, empty or not finite take no part; a
question without a usable vector has no results. Vectors of another length than the question's aren't compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import finite
from ..session import reachable
from ..storage import checkpointed, first_rows

BLOCK = 2048
#: So many scores are made at once.
SCORES = 1 << 18
ABSTAIN_BELOW = 0.62
SEEDS, RESERVE, BEYOND = 2, 2, 40


def _blocks(queries: DataFrame, keys: list[str]) -> Iterator[tuple[list[tuple], list]]:
    """Blocks of (keys, vectors), at most BLOCK at a time on the driver."""
    held: tuple[list, list] = ([], [])
    for r in queries.select(*keys, F.col("embedding").cast("array<double>").alias("embedding")).where(finite(F.col("embedding"))).toLocalIterator():
        held[0].append(tuple(r[k] for k in keys))
        held[1].append(r.embedding)
        if len(held[0]) == BLOCK:
            yield held
            held = ([], [])
    if held[0]:
        yield held


def _scan(index: DataFrame, vectors: list, k: int, column: str) -> DataFrame:
    """(q, ord, score): each task's k best rows of each question, q its place in the block."""
    reachable(index.sparkSession)
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(v) for v in vectors}:
        at = np.array([i for i, v in enumerate(vectors) if len(v) == d])
        groups[d] = at, np.array([vectors[i] for i in at])

    def best(scores: np.ndarray, ords: np.ndarray) -> np.ndarray:
        if len(scores) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])  # ties included
        else:
            near = np.arange(len(scores))
        return near[np.lexsort((ords[near], -scores[near]))[:k]]

    n = len(vectors)  # the lists themselves aren't sent beside the arrays

    def run(batches):
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * n
        least = np.full(n, -np.inf)  # the last of k kept scores: only rows that reach it are looked at
        for b in batches:
            ords, lists = b.column(0).to_numpy(), b.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            lengths = np.diff(ends)
            for d, (at, q) in groups.items():
                rows = np.flatnonzero(lengths == d)
                if not len(rows):
                    continue
                own = ords[rows]
                v = flat[(ends[rows] - ends[0])[:, None] + np.arange(d)]
                some = max(1, SCORES // len(rows))
                for i in range(0, len(at), some):
                    scores = q[i : i + some] @ v.T
                    reach = ~(scores < least[at[i : i + some], None])
                    for x in np.flatnonzero(reach.any(axis=1)):
                        j, y = at[i + x], np.flatnonzero(reach[x])
                        s, o = np.concatenate([kept[j][0], scores[x, y]]), np.concatenate([kept[j][1], own[y]])
                        few = best(s, o)
                        kept[j] = s[few], o[few]
                        if len(few) == k:
                            least[j] = s[few[-1]]
        some = [i for i, (s, _) in enumerate(kept) if len(s)]
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, [len(kept[x][0]) for x in part]).astype(np.int32)), pa.array(np.concatenate([kept[x][1] for x in part])), pa.array(np.concatenate([kept[x][0] for x in part]))], ["q", "ord", "score"])

    rows = index.select(F.col("ord").cast("long"), F.col(column).cast("array<double>").alias("v")).where(finite(F.col("v")))
    return rows.mapInArrow(run, "q int, ord long, score double")


def nearest(index: DataFrame, queries: DataFrame, k: int, keys: list[str], column: str = "embedding", apart: str | None = None) -> DataFrame:
    """(*keys, rank, ord, score): the k rows of index (ord, embedding) with the greatest inner product, for each query.

    apart: a key whose value is an ord that isn't to be found, as when rows of the index ask.
    """
    spark, out = index.sparkSession, None
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}
    for block, vectors in _blocks(queries, keys):
        # As an Arrow table: rows of Python would be read by Python workers of their own, which then stay idle on the executors.
        columns = [pa.array(range(len(block)), pa.int32()), *(pa.array(c) for c in zip(*block))]
        names = spark.createDataFrame(pa.Table.from_arrays(columns, ["q", *keys]), "q int, " + ", ".join(f"`{c}` {kind[c]}" for c in keys))
        found = _scan(index, vectors, k + (apart is not None), column).join(F.broadcast(names), "q")  # the block's names: BLOCK rows at most
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` {kind[c]}" for c in keys) + ", rank int, ord long, score double")
    if apart:
        out = out.where(F.col(apart) != F.col("ord"))
    return first_rows(out, keys, [F.desc("score"), F.col("ord")], k).select(*keys, "rank", "ord", "score")


def filtered(index: DataFrame, jurisdiction: str | None = None, include_withdrawn: bool = True) -> DataFrame:
    """The rows that a search may find."""
    if jurisdiction is not None:
        index = index.where(F.col("jurisdiction") == jurisdiction)
    return index if include_withdrawn else index.where(F.col("status") == "in_force")


def with_rows(found: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """found with columns of the index: the found rows are few, so they go to the index where they are small enough."""
    return found.join(index.select("ord", *columns), "ord")


def search(index: DataFrame, queries: DataFrame, k: int = 5, jurisdiction: str | None = None, include_withdrawn: bool = True) -> DataFrame:
    """(query_id, rank, ord, score) for queries (query_id, embedding)."""
    return nearest(filtered(index, jurisdiction, include_withdrawn), queries, k, ["query_id"])


def two_stage(index: DataFrame, queries: DataFrame, k: int = 5, seeds: int = SEEDS, reserve: int = RESERVE, apart: str | None = None) -> DataFrame:
    """(query_id, rank, ord, score, hop): direct results, of which the last give way to hops into other sources.

    The best `seeds` direct results become queries themselves (by body_embedding where the index has it). The first hop
    takes a result of another jurisdiction, the second one of wholly other sources, each from the first seed that has one
    among its k + 40 nearest, outside all direct results. With k = 1 there are no hops, with k = 2 only the first kind. A
    hop's score is its likeness to the seed. hop: 0 direct, 1 and 2. apart: as in nearest, for the direct stage.
    """
    keys = ["query_id"] + ([apart] if apart and apart != "query_id" else [])
    direct = nearest(index, queries, k, keys, apart=apart).select("query_id", "rank", "ord", "score")
    reserve = max(0, min(reserve, k - 1))
    if not reserve:
        return direct.withColumn("hop", F.lit(0))
    direct = checkpointed(direct)
    vector = F.coalesce("body_embedding", "embedding") if "body_embedding" in index.columns else F.col("embedding")
    own = index.select("ord", "jurisdiction", "source_ids", vector.alias("embedding"))
    seed = direct.where(F.col("rank") <= seeds).select("query_id", F.col("rank").alias("seed"), "ord").join(own, "ord")
    seed = checkpointed(seed.withColumnRenamed("ord", "seed_ord"))
    hits = nearest(index.withColumn("embedding", F.col("embedding")), seed, k + BEYOND, ["query_id", "seed"])
    seen = direct.select("query_id", "ord")
    # seeds and hits are a few rows per question
    hits = hits.join(seen, ["query_id", "ord"], "left_anti").join(index.select("ord", "jurisdiction", "source_ids"), "ord")
    of = seed.select("query_id", "seed", F.col("jurisdiction").alias("seed_jurisdiction"), F.col("source_ids").alias("seed_sources"))
    hits = checkpointed(hits.join(of, ["query_id", "seed"]))

    def pick(rows: DataFrame, condition: Column, hop: int) -> DataFrame:
        first = first_rows(rows.where(condition), ["query_id"], [F.col("seed"), F.col("rank")], 1, "nth")
        return first.select("query_id", "rank", "ord", "score", F.lit(hop).alias("hop"))

    hops = pick(hits, ~F.col("jurisdiction").eqNullSafe(F.col("seed_jurisdiction")), 1)
    if reserve > 1:
        rest = hits.join(hops.select("query_id", "ord"), ["query_id", "ord"], "left_anti")
        hops = hops.union(pick(rest, ~F.arrays_overlap("source_ids", "seed_sources"), 2))
    both = direct.withColumn("hop", F.lit(0)).union(hops)
    n_hops = F.sum((F.col("hop") > 0).cast("int")).over(Window.partitionBy("query_id"))
    kept = both.withColumn("n_hops", n_hops).where((F.col("hop") > 0) | (F.col("rank") <= k - F.col("n_hops")))
    w = Window.partitionBy("query_id").orderBy("hop", "rank")
    return kept.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "ord", "score", "hop")


def abstentions(queries: DataFrame, results: DataFrame, threshold: float = ABSTAIN_BELOW) -> DataFrame:
    """(query_id, top_score, abstain): a question is declined if nothing was found or its first result scores below the threshold."""
    top = results.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    return queries.select("query_id").distinct().join(top, "query_id", "left").withColumn("abstain", F.coalesce("top_score", F.lit(float("-inf"))) < threshold)
