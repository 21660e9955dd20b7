"""Bulk-synchronous best-fit packing of token sequences.

Documents become pieces of at most `size` tokens (only longer ones are cut). Best-fit decreasing then runs in bulk:
pieces are range-sorted by length, and so are the gaps of the sequences; in each round the pieces of the next length
are matched, all at once, to the smallest gaps that hold them (the successor), conflicts over a gap are resolved by
rank in the sorted order, the gaps are updated, and what found no gap opens new sequences. Pieces of one length differ
only in rank, and so do gaps of one width, so a round needs no more than counts: the sweep runs over at most `size`
length classes, whatever the number of documents, and yields a plan of a few thousand runs ("ranks r0.. of this length
go into sequences b.. at this offset"). Applying the plan is distributed: each piece gets its rank from its place in
the sorted ranges and finds its run by binary search. It makes the same sequences as best-fit decreasing one by one.

Null text counts as empty: its one token is the end id. Rows that repeat a doc_id are packed each. Ties go by doc_id,
then piece. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, texts
from .tokenization import END, encoder


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        enc, last = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), texts(b)):
                data = enc.encode(t) + last
                view = memoryview(data)
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = view[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], size: int = 4096) -> tuple[np.ndarray, int]:
    """The plan for so many pieces of each length: runs (length, r0, r1, b0, each, offset), sorted, and the number of sequences.

    Rank r in [r0, r1) goes to sequence b0 + (r - r0) // each, at offset + (r - r0) % each * length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # width: (first sequence, how many)
    widths: list[int] = []
    runs, opened = [], 0

    def put(width: int, first: int, n: int) -> None:
        if n and width:
            if width not in gaps:
                gaps[width] = []
                bisect.insort(widths, width)
            gaps[width].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens")
        while left:
            at = bisect.bisect_left(widths, length)
            if at == len(widths):  # no successor: new sequences
                width, have = size, max(1, left // (size // length))
                first, opened = opened, opened + have
            else:
                width = widths[at]
                first, have = gaps[width].pop()
                if not gaps[width]:
                    del gaps[width], widths[at]
            each = width // length
            use = min(have, left // each)
            if use:
                put(width, first + use, have - use)
            else:  # fewer pieces than one gap takes
                each, use = left, 1
                put(width, first + 1, have - 1)
            runs.append((length, rank, rank + use * each, first, each, size - width))
            put(width - each * length, first, use)
            rank += use * each
            left -= use * each
    return np.array(sorted(runs), np.int64).reshape(-1, 6), opened


def pack(rows: DataFrame, ws: Workspace, size: int = 4096) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def place(batches):
        before, held = -1, 0
        for b in batches:
            n = b.column(3).to_numpy()
            if not len(n):
                continue
            new = np.flatnonzero(np.concatenate([[n[0] != before], n[1:] != n[:-1]]))
            first = np.zeros(len(n), np.int64)
            first[new] = new
            first = np.maximum.accumulate(first)
            nth = np.arange(len(n)) - first
            if not len(new) or new[0] > 0:
                nth[: new[0] if len(new) else len(n)] += held
            held = int(nth[-1]) + 1
            before = n[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth)], [*names, "part", "nth"])

    # The ranges: sorted by length, a hot length goes on by doc_id. part and nth: a piece's place in its range and length.
    dealt = rows.select(*names).repartitionByRange(F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    dealt = ws.table(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(place, types + ", part int, nth long"), "ranges")
    # One row for each range and length in it: at most ranges + size of them.
    found = sorted(tuple(r) for r in dealt.groupBy("length", "part").count().collect())
    totals: dict[int, int] = {}
    base = []
    for length, part, n in found:
        base.append((length, part, totals.get(length, 0)))
        totals[length] = totals.get(length, 0) + n
    plan, _ = sweep(totals, size)
    base = np.array(base, np.int64).reshape(-1, 3)

    def key(a, b):  # pairs as one sorted integer
        return a * (1 << 48) + b

    keys, run_keys = key(base[:, 0], base[:, 1]), key(plan[:, 0], plan[:, 1])

    def assign(batches):
        for b in batches:
            length, part, nth = b.column(3).to_numpy(), b.column(5).to_numpy().astype(np.int64), b.column(6).to_numpy()
            rank = base[np.searchsorted(keys, key(length, part)), 2] + nth if len(length) else nth
            run = plan[np.searchsorted(run_keys, key(length, rank), "right") - 1] if len(length) else plan[:0]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(assign, types + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.table(pieces(docs, tokenizer, size), "pieces"), ws, size)
