"""Exact top-k search by inner product with a vector-approximation file.

Components become integers floor(scale * x). The approximation file holds, for every vector, the number of the cell
(of 2^bits equal cells between the least and the greatest value of its dimension) that each component falls into, one
byte each, and where its exact vector lies: in files of their own, in as few bytes a component as the values need. For a
query q the inner product with any vector of those cells lies within e of the one with the cells' middles, where
e = sum |q_d| * half a cell's width: these are the bounds.

Queries are a stated set; they are numbered and taken in blocks of a fixed size, and each block meets every row in two
scans of the approximations:

    scan 1    keeps each query's k greatest lower bounds; the kth is a floor under the query's kth score;
    scan 2    of the vectors whose upper bound reaches the floor, exact ones are read from their file, by ranges, in the
              order of the bounds, best first, until the kth score found is above the next bound: the rest can't enter.

What is sent to the executors is one block of queries, at most BLOCK vectors; no vectors are sent to the driver but
those. Ties in score go to the smaller vec_id.

Vectors that are null, or hold null or non-finite components, take no part, as a query or a candidate; nor do rows with
a null vec_id. Vectors of another length than the query's aren't compared with it. A query isn't compared with rows of
its own vec_id; other rows that repeat a vec_id count one by one. Scores must fit 63 bits; components beyond 2^53 after
scaling raise an error. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Workspace, file_system, write_file

#: Queries in a block, rows that are bounded at a time, bytes of a file of exact vectors, and exact vectors read at once.
BLOCK, ROWS, FILE, FEW = 4096, 2048, 16 << 20, 16
_KIND = "vec_id long, dim int, cells binary, file string, at long"


def integers(rows: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(vec_id, v: array<long>) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, finite)
    # Spark may compute this before it drops the other rows, so it raises for finite components only.
    whole = F.transform(v, lambda x: F.when(finite(x) & (F.abs(x) * scale > 2.0**53), F.raise_error(F.lit("a scaled component doesn't fit 53 bits")).cast("long")).otherwise(F.floor(x * F.lit(float(scale)))))
    return rows.where(good).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


class Grid:
    """The cells of each dimension: least value and width, for every length of vectors; kind: of exact components."""

    def __init__(self, ranges: dict[int, tuple[np.ndarray, np.ndarray]], bits: int):
        most = max((int(max(abs(low).max(), abs(high).max())) for low, high in ranges.values()), default=0)
        self.kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        self.low = {d: low.astype(np.float64) for d, (low, _) in ranges.items()}
        self.width = {d: np.maximum((high - low).astype(np.float64) / (1 << bits), 1.0) for d, (low, high) in ranges.items()}
        self.cells = 1 << bits

    def encode(self, v: np.ndarray) -> np.ndarray:
        d = v.shape[1]
        return np.clip((v - self.low[d]) // self.width[d], 0, self.cells - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        d = cells.shape[1]
        return self.low[d] + (cells + 0.5) * self.width[d]

    def error(self, q: np.ndarray) -> np.ndarray:
        """How far a score may lie from the middles' one: half a cell for each dimension, and what floats lose."""
        d = q.shape[1]
        size = np.abs(q) @ (np.abs(self.low[d]) + self.cells * self.width[d])
        return np.abs(q) @ (self.width[d] / 2) + 1.0 + size * 1e-12


def _dims(batch: pa.RecordBatch, i: int = 0):
    """(rows, dimension) of each length of vectors in a batch of _KIND."""
    dims = batch.column(1).to_numpy()
    for d in np.unique(dims[dims > 0]):
        yield np.flatnonzero(dims == d), int(d)


def _matrix(column: pa.Array, rows: np.ndarray, kind: str) -> np.ndarray:
    parts = [x.as_py() for x in column.take(pa.array(rows))]
    return np.frombuffer(b"".join(parts), kind).reshape(len(rows), -1)


def _exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, v.shape[1])
    if most < 1 << 52:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return v @ q
    return np.array([sum(a * b for a, b in zip(map(int, row), map(int, q))) for row in v], np.int64)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greater scores first, then smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def approximations(vectors: DataFrame, ws: Workspace, bits: int) -> tuple[DataFrame, Grid]:
    """The written approximation file of (vec_id, v), and its grid."""
    placed = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("d", "x"))
    found: dict[int, dict] = {}
    for r in placed.groupBy("dim", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():  # one row for each length and dimension
        found.setdefault(r.dim, {})[r.d] = (r.low, r.high)
    grid = Grid({n: (np.array([x[i][0] for i in range(n)]), np.array([x[i][1] for i in range(n)])) for n, x in found.items()}, bits)

    folder = f"{ws.uri}/exact"

    def encode(batches):
        held, size, name = [], 0, f"{folder}/{uuid.uuid4().hex}"

        def rows(out: list):
            ids, dims, cells, places = zip(*out)
            cols = [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.binary()), pa.array([name] * len(out)), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "cells", "file", "at"])

        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(1)
            dims = np.array([len(x) for x in lists], np.int64)
            out = []
            for d in np.unique(dims[dims > 0]).tolist():
                some = np.flatnonzero(dims == d)
                v = np.stack([lists[int(i)].values.to_numpy() for i in some])
                for i, c, x in zip(some.tolist(), grid.encode(v), v.astype(grid.kind)):
                    out.append((ids[i], d, c.tobytes(), size))
                    held.append(x.tobytes())
                    size += len(held[-1])
            if out:
                yield rows(out)
            if size >= FILE:
                write_file(name, b"".join(held))
                held, size, name = [], 0, f"{folder}/{uuid.uuid4().hex}"
        if held:
            write_file(name, b"".join(held))

    return ws.table(vectors.mapInArrow(encode, _KIND), "approximations"), grid


class Exact:
    """Exact vectors, read by ranges from their files; the file in use stays open."""

    def __init__(self, kind: str):
        self.kind, self.name, self.file = kind, None, None

    def __call__(self, names: list[str], places: np.ndarray, dim: int) -> np.ndarray:
        out = []
        for name, at in zip(names, places.tolist()):
            if name != self.name:
                self.close()
                files, path = file_system(name)
                self.name, self.file = name, files.open_input_file(path)
            out.append(self.file.read_at(dim * np.dtype(self.kind).itemsize, at))
        return np.frombuffer(b"".join(out), self.kind).reshape(len(out), dim).astype(np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def _floors(file: DataFrame, grid: Grid, ids: np.ndarray, by_dim: dict, k: int) -> np.ndarray:
    """Scan 1: a floor under each query's kth score, or -inf."""
    n = len(ids)

    def scan(batches):
        best = np.full((n, k), -np.inf)
        for b in batches:
            vec = b.column(0).to_numpy()
            for rows, d in _dims(b):
                if d not in by_dim:
                    continue
                at, q = by_dim[d]
                qf, e = q.astype(np.float64), grid.error(q)
                for i in range(0, len(rows), ROWS):
                    part = rows[i : i + ROWS]
                    mid = grid.middles(_matrix(b.column(2), part, np.uint8))
                    for j in range(0, len(at), 256):
                        own = at[j : j + 256]
                        low = qf[j : j + 256] @ mid.T - e[j : j + 256, None]
                        low[ids[own][:, None] == vec[part][None, :]] = -np.inf
                        both = np.concatenate([best[own], low], 1)
                        best[own] = -np.partition(-both, k - 1, 1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["best"])

    # A sum over the partitions, k numbers for each query of the block: they are merged pairwise on the executors first.
    rows = file.select("vec_id", "dim", "cells").mapInArrow(scan, "best binary")

    def merge(batches):
        best = np.full((n, k), -np.inf)
        for b in batches:
            for x in b.column(0).to_pylist():
                both = np.concatenate([best, np.frombuffer(x, np.float64).reshape(n, k)], 1)
                best = -np.partition(-both, k - 1, 1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["best"])

    last = rows.repartition(max(1, min(16, rows.sparkSession.sparkContext.defaultParallelism))).mapInArrow(merge, "best binary").collect()
    best = np.full((n, k), -np.inf)
    for r in last:
        both = np.concatenate([best, np.frombuffer(bytes(r.best), np.float64).reshape(n, k)], 1)
        best = -np.partition(-both, k - 1, 1)[:, :k]
    return best.min(1)


def _winners(file: DataFrame, grid: Grid, ids: np.ndarray, by_dim: dict, floors: np.ndarray, k: int) -> DataFrame:
    """Scan 2: (query_id, vec_id, score), at most k rows for each query and partition."""

    def scan(batches):
        scores = [np.zeros(0, np.int64) for _ in ids]
        found = [np.zeros(0, np.int64) for _ in ids]
        read = Exact(grid.kind)
        for b in batches:
            vec, files, places = b.column(0).to_numpy(), b.column(3), b.column(4).to_numpy()
            for rows, d in _dims(b):
                if d not in by_dim:
                    continue
                at, q = by_dim[d]
                qf, e = q.astype(np.float64), grid.error(q)
                for i in range(0, len(rows), ROWS):
                    part = rows[i : i + ROWS]
                    mid = grid.middles(_matrix(b.column(2), part, np.uint8))
                    for j in range(0, len(at), 256):
                        own = at[j : j + 256]
                        high = qf[j : j + 256] @ mid.T + e[j : j + 256, None]
                        reach = (high >= floors[own][:, None]) & (ids[own][:, None] != vec[part][None, :])
                        for r in np.flatnonzero(reach.any(1)).tolist():
                            x, cols = int(own[r]), np.flatnonzero(reach[r])
                            cols = cols[np.argsort(-high[r, cols], kind="stable")]
                            for a in range(0, len(cols), FEW):  # in the order of the bounds, a few at a time
                                few = cols[a : a + FEW]
                                if len(scores[x]) >= k and scores[x][-1] > high[r, few[0]]:
                                    break
                                few = few[np.argsort(places[part[few]], kind="stable")]
                                exact = read(files.take(pa.array(part[few])).to_pylist(), places[part[few]], d)
                                s = np.concatenate([scores[x], _exact_scores(q[j + r], exact)])
                                v = np.concatenate([found[x], vec[part[few]]])
                                keep = _top(s, v, k)
                                scores[x], found[x] = s[keep], v[keep]
        read.close()
        full = [i for i in range(len(ids)) if len(scores[i])]
        for i in range(0, len(full), 2000):
            some = full[i : i + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], [len(scores[x]) for x in some])), pa.array(np.concatenate([found[x] for x in some])), pa.array(np.concatenate([scores[x] for x in some]))], ["query_id", "vec_id", "score"])

    return file.mapInArrow(scan, "query_id long, vec_id long, score long")


def _queries(vectors: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(number, vec_id, v) of the queries, numbered in order of vec_id, and how many there are. Each is a query once."""
    rows = vectors.distinct().repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("at", F.monotonically_increasing_id())
    rows = ws.table(rows, "placed")
    part = F.shiftright("at", 33)
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):  # one row for each partition
        before.append((p, total))
        total += n
    if not total:
        return rows, 0
    starts = rows.sparkSession.createDataFrame(before, "p long, before long")
    numbered = rows.withColumn("p", part).join(starts, "p").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"), "vec_id", "v")
    return ws.table(numbered, "queries"), total


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256, bits: int = 6, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on vec_id that states the queries."""
    ws = Workspace(vectors.sparkSession, "top-k")
    whole = integers(vectors, id_column, vector_column, scale)
    file, grid = approximations(whole, ws, bits)
    asked, total = _queries(whole.where(is_query), ws)
    any_found = False
    for block in range(0, total, BLOCK):
        rows = asked.where((F.col("number") >= block) & (F.col("number") < block + BLOCK)).collect()  # a block
        rows.sort(key=lambda r: r.number)
        ids = np.array([r.vec_id for r in rows], np.int64)
        dims = np.array([len(r.v) for r in rows])
        by_dim = {d: (np.flatnonzero(dims == d), np.array([rows[i].v for i in np.flatnonzero(dims == d)], np.int64)) for d in np.unique(dims).tolist() if d > 0}
        if by_dim:
            floors = _floors(file, grid, ids, by_dim, k)
            ws.table(_winners(file, grid, ids, by_dim, floors, k), f"winners/block={block}")
            any_found = True
    if not any_found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = vectors.sparkSession.read.schema("query_id long, vec_id long, score long, block long").parquet(f"{ws.uri}/winners")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
