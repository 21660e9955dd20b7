"""SimHash near-dedup with multi-index hashing.

A text (null counts as empty) is lower-cased for A-Z and split at ASCII white space; its shingles of w words, repeats
included, are hashed with XXH64 (seed 42), and a fingerprint bit is 1 if it is set in more than half of the hashes.
Without words the fingerprint is zero and is linked like any other.

near_duplicates: equal fingerprints are merged first, so copies cost nothing further. Two fingerprints link at 2 or fewer
differing bits. The index has a table for each of two segments of 32 bits, keyed by the segment's number and value. Of
two bits that differ, one segment has one at most, so the small ball of radius 1 around each segment's value is
enumerated: a fingerprint is posted under its own value and under every value with one more bit set, and any pair that
links meets under a value of one of the tables. Those that meet are verified by their complete distance.

similar_documents: links two texts if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Candidates come from fingerprints of 256 bits over distinct shingles, whose differing bits estimate the similarity. Their
tables hold segments of so many bits that a bucket has about one row, whatever the corpus (more bits for more texts); both
sides are posted under the ball of radius 1. There are as many tables (segments of several permutations of the bits) as
let a pair of exactly that similarity meet with probability 1 - MISS. Pairs of up to mean + 3 deviations of differing
bits make clusters, and within a cluster the exact shingle sets decide every link.

Buckets and clusters. Rows that meet are searched breadth first, each against those not yet reached, which finds all that
links connect and costs little more than the length where most are alike. A group of more than LARGE rows is never held
by one task: its rows are dealt out in parts, and all are compared with one of them; those that it doesn't reach are then
compared, in blocks, with all rows of the group, part by part. Pairs that this leaves out are connected by the first.

doc_id null: the row gets its fingerprint, no links and a null component_id. Rows that repeat a doc_id each keep their
own text's component. An empty table gives an empty result. Other columns are ignored (near_duplicates) or kept
(similar_documents, distinct_documents), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .runtime import Workspace, fresh, texts

BLOCK = 1 << 15
#: Rows of a group that one task holds, bytes of their sets, and buckets that are compared by shifted arrays.
LARGE, HELD, SMALL = 4000, 32 << 20, 6


def fingerprint(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(words)))), len(w) - words + 1
    hash64 = xxhash.xxh64_intdigest
    h = np.fromiter((hash64(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        bits = np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# Groups of rows (key, node, fp, ...): links between the rows of a key that are near.

#: near(payload, one row, other rows) -> which of them link. payload: what was read from a batch.
Near = Callable[[dict, int, np.ndarray], np.ndarray]


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def within(most: int) -> Near:
    return lambda x, at, others: np.bitwise_count(x["fp"][others] ^ x["fp"][at]).sum(1) <= most


def alike(most: int, similarity: float) -> Near:
    """Links by the Jaccard similarity of sets, which are compared where fingerprints are within `most` bits."""

    def near(x, at, others):
        out = np.bitwise_count(x["fp"][others] ^ x["fp"][at]).sum(1) <= most
        some = others[out]
        if len(some):
            own, sets = x["sets"][at], [x["sets"][i] for i in some.tolist()]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            out[out] = both >= similarity * (len(own) + sizes - both) - 1e-9
        return out

    return near


def _payload(batch: pa.RecordBatch) -> dict:
    x = {"fp": _prints(batch.column(batch.schema.get_field_index("fp")))}
    at = batch.schema.get_field_index("set")
    if at >= 0:
        x["sets"] = [np.frombuffer(s, "<u8") for s in batch.column(at).to_pylist()]
    return x


def tree(x: dict, rows: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever rows are reached from each other by steps between near ones."""
    a, b = [], []
    left = rows
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            hit = near(x, at, left)
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), at))
                b.append(found)
                reached += found.tolist()
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_links(key: np.ndarray, x: dict, near: Near, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted keys; most: the bits that near allows, if it is only they that decide."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    small = SMALL if most is not None else 1
    large = np.repeat(size > small, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(1, small):
        i = np.flatnonzero((key[t:] == key[:-t]) & ~large[t:])
        i = i[np.bitwise_count(x["fp"][i] ^ x["fp"][i + t]).sum(1) <= most]
        a.append(i)
        b.append(i + t)
    for start, n in zip(edges[:-1][size > small].tolist(), size[size > small].tolist()):
        p, q = tree(x, np.arange(start, start + n), near)
        a.append(p)
        b.append(q)
    return np.concatenate(a), np.concatenate(b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes: each one to the least it reaches. Like texts meet in many buckets; this keeps one
    link for each, and mostly the same one whatever the buckets."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            far = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[label[far]], nodes[far]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b)], ["a", "b"])


def _by_bucket(batches, take):
    """take(key, batch) over sorted batches, whole buckets at a time."""
    held: list[pa.RecordBatch] = []
    n = size = 0

    def whole(last: bool):
        nonlocal held, n, size
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t.column(0).to_numpy()
        end = len(key) if last else int(np.searchsorted(key, key[-1]))
        held, n, size = [t.slice(end)], len(key) - end, 0
        if end:
            yield take(key[:end], t.slice(0, end))

    for b in batches:
        if b.num_rows:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if (n >= BLOCK * 4 or size >= HELD) and held[0].column(0)[0].as_py() != b.column(0)[b.num_rows - 1].as_py():
                yield from whole(False)
    if n:
        yield from whole(True)


def _small_links(rows: DataFrame, near: Near, most: int | None) -> DataFrame:
    """(a, b) of groups that a task can hold."""

    def run(batches):
        def take(key, batch):
            node = batch.column(1).to_numpy()
            a, b = bucket_links(key, _payload(batch), near, most)
            return _pairs(*forest(node[a], node[b]))

        yield from _by_bucket(batches, take)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _weight(sets: bool):
    """What a group's rows are of what a task may hold."""
    rows = F.count("*") / LARGE
    return F.greatest(rows, F.sum(F.octet_length("set").cast("long")) / HELD) if sets else rows


def _large_links(ws: Workspace, name: str, rows: DataFrame, near: Near) -> DataFrame:
    """(a, b) of groups that no task can hold."""
    payload = [c for c in rows.columns if c not in ("key", "node")]
    weight = _weight("set" in payload)
    sizes = ws.table(rows.groupBy("key").agg(weight.alias("n"), F.min("node").alias("least")), f"{name}-sizes")
    parts = F.ceil("n").cast("int")

    def compare(pivots: DataFrame, step: str) -> DataFrame:
        """(key, a, b): a pivot and a row of its group that are near."""
        counted = ws.table(pivots.groupBy("key").agg(weight.alias("p")), f"{name}-{step}-pivots")
        blocks = F.ceil("p").cast("int")
        shape = sizes.join(counted, "key").select("key", parts.alias("parts"), blocks.alias("blocks"))
        deal = lambda own, other: [F.pmod(F.xxhash64("node"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))]
        part, block = deal("parts", "blocks")
        one = rows.join(shape, "key").select("key", part.alias("part"), block.alias("block"), F.lit(False).alias("pivot"), "node", *payload)
        block, part = deal("blocks", "parts")
        two = pivots.join(shape, "key").select("key", block.alias("block"), part.alias("part"), F.lit(True).alias("pivot"), "node", *payload)

        def cross(table: pa.Table) -> pa.Table:
            batch = table.combine_chunks().to_batches()[0]
            pivot, node, x = np.array(batch.column(3).to_pylist(), bool), batch.column(4).to_numpy(), _payload(batch)
            others, a, b = np.flatnonzero(~pivot), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in np.flatnonzero(pivot).tolist():
                found = others[near(x, at, others)]
                a.append(np.full(len(found), node[at]))
                b.append(node[found])
            a, b = np.concatenate(a), np.concatenate(b)
            if step == "rest":  # the group's links are as good as those that connect the same nodes
                a, b = forest(a, b)
            return pa.table({"key": pa.array(np.full(len(a), batch.column(0)[0].as_py())), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

        both = one.unionByName(two).select("key", "part", "block", "pivot", "node", *payload)
        return both.groupBy("key", "part", "block").applyInArrow(cross, "key long, a long, b long")

    first = rows.join(sizes.select("key", F.col("least").alias("node")), ["key", "node"]).select(*rows.columns)
    star = ws.table(compare(ws.table(first, f"{name}-first"), "first"), f"{name}-star")
    rest = rows.join(star.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
    rest = ws.table(rest, f"{name}-rest")
    return star.select("a", "b").where("a <> b").union(compare(rest, "rest").select("a", "b").where("a <> b"))


def group_links(ws: Workspace, name: str, rows: DataFrame, hot: DataFrame, near: Near, most: int | None = None) -> DataFrame:
    """(a, b): links that connect what near connects within each key of rows (key, node, fp, ...). hot: keys (key) that may
    have more rows than a task should hold."""
    if hot.isEmpty():
        return _small_links(rows, near, most)
    # The hot keys are few; whether they are broadcast is left to Spark, by their size.
    large = ws.table(rows.join(hot, "key", "left_semi"), f"{name}-large")
    return _small_links(rows.join(hot, "key", "left_anti"), near, most).union(_large_links(ws, name, large, near))


def _thinned(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same: tasks name different least texts for one that many buckets hold."""

    def run(batches):
        for b in batches:
            yield _pairs(*forest(b.column(0).to_numpy(), b.column(1).to_numpy()))

    links = links.distinct().repartition("b").sortWithinPartitions("b", "a")
    return links.mapInArrow(run, "a long, b long").distinct()


# Links at a distance.

HALF = 32


def _half_keys(fp: np.ndarray, ball: bool) -> np.ndarray:
    """Keys of a fingerprint in both tables, one row for each; with ball also those with one more bit set, -1 where it is set already."""
    out = []
    for s in range(2):
        value = (fp >> np.uint64(HALF * s)).astype(np.int64) & ((1 << HALF) - 1)
        masks = 1 << np.arange(HALF, dtype=np.int64)
        keys = value[:, None] | (np.concatenate([[0], masks]) if ball else np.zeros(1, np.int64))
        if ball:
            keys[:, 1:][(value[:, None] & masks) != 0] = -1
        out.append(np.where(keys < 0, keys, keys | s << HALF))
    return np.concatenate(out, 1)


def _posted(keys_of, ball: bool):
    def run(batches):
        for b in batches:
            node, column = b.column(0).to_numpy(), b.column(1)
            for i in range(0, len(node), 1000):
                fp = _prints(column.slice(i, 1000))
                keys = keys_of(fp, ball)
                own = np.repeat(np.arange(len(fp)), keys.shape[1])
                keys = keys.reshape(-1)
                own, keys = own[keys >= 0], keys[keys >= 0]
                cols = [pa.array(keys), pa.array(node[i : i + 1000][own]), pa.array(fp[:, 0].view(np.int64)[own])]
                yield pa.RecordBatch.from_arrays(cols, ["key", "node", "fp"])

    return run


def _hot(ws: Workspace, name: str, nodes: DataFrame, keys_of, bits: int) -> DataFrame:
    """(key): values that more than LARGE / 4 fingerprints have, and those of the ball around them."""
    own = nodes.select("node", "fp").mapInArrow(_posted(keys_of, False), "key long, node long, fp long")
    many = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE // 4)
    ball = F.explode(F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)]))
    return ws.table(many.select(ball.alias("key")).distinct(), f"{name}-hot")


def links(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect what fingerprints of 2 or fewer differing bits connect, from nodes (node, fp), distinct in both."""
    keys_of = lambda fp, ball: _half_keys(fp[:, 0], ball)
    posted = nodes.select("node", "fp").mapInArrow(_posted(keys_of, True), "key long, node long, fp long")
    return _thinned(group_links(ws, "links", posted, _hot(ws, "links", nodes, keys_of, HALF), within(2), 2))


def _numbered(ws: Workspace, groups: DataFrame) -> DataFrame:
    """groups (least, ...) with a number for each (node), in the order of least; numbers are kept, as the table is written."""
    groups = groups.repartitionByRange("least").sortWithinPartitions("least")
    return ws.table(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.table(fingerprints(docs, words), "prints")
    nodes = _numbered(ws, prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(ws, ws.table(links(ws, nodes), "links"))
    named = labels.join(nodes.select(F.col("node").alias("label"), F.col("least").alias("component")), "label").select("node", "component")
    joined = nodes.join(ws.table(named, "named"), "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "least").alias("component"))
    joined = ws.table(joined, "components")
    out = prints.join(joined, prints["fp"] == joined["of"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


# Links by similarity.

#: Bits of the wide fingerprint, how far two may differ in the 64 bits compared first, and how often a pair of just the
#: asked similarity may meet in no table.
WIDE, FIRST, MISS = 256, 20, 0.01


def limit_of(similarity: float) -> int:
    """Differing bits of WIDE that two texts of such a Jaccard similarity hardly ever exceed: the mean and three deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * share + 3 * np.sqrt(WIDE * share * (1 - share)))


def tables_of(similarity: float, texts: int) -> np.ndarray:
    """The fingerprint's bits that each table's segments have, one row for a table."""
    bits = 16
    while texts * (bits + 1) > 1 << bits and bits < 38:
        bits += 1
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    meet = sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(3))
    count = math.ceil(math.log(MISS) / math.log(1 - meet))
    rng, out = np.random.RandomState(7), []
    while len(out) < count:
        order = rng.permutation(WIDE)
        out += [order[i : i + bits] for i in range(0, WIDE - bits + 1, bits)]
    return np.array(out[:count])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, one at least."""
    w = text.lower().split()
    shingles = set(map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) >= words else {b" ".join(w)}
    hash64 = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter(map(hash64, shingles), np.uint64, len(shingles)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDE bits over the hashes of a shingle set, each of which is mixed to as many."""
    ones = np.zeros(WIDE, np.int64)
    seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    for i in range(0, len(hashes), BLOCK // 4):
        x = hashes[i : i + BLOCK // 4, None] + seeds
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _table_keys(tables: np.ndarray):
    """Keys of fingerprints in all tables; with ball also those of one bit changed."""
    count, size = tables.shape
    masks = np.concatenate([[0], 1 << np.arange(size)]).astype(np.int64)

    def keys_of(fp: np.ndarray, ball: bool) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")[:, tables.reshape(-1)].reshape(len(fp), count, size)
        value = bits.astype(np.int64) @ (1 << np.arange(size)) | np.arange(count) << 40
        return (value[:, :, None] ^ masks).reshape(len(fp), -1) if ball else value

    return keys_of


def _clusters(ws: Workspace, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, label): clusters of fingerprints within the limit of each other, of those that have such a neighbour."""
    tables = tables_of(similarity, nodes.count())
    keys_of = _table_keys(tables)
    hot = _hot(ws, "clusters", nodes, keys_of, tables.shape[1])
    posted = nodes.select("node", "fp").mapInArrow(_posted(keys_of, True), "key long, node long, fp long")
    most, near, first = limit_of(similarity), within(limit_of(similarity)), within(FIRST)

    def candidates(batches):
        def take(key, batch):
            hit = np.unique(np.concatenate(bucket_links(key, _payload(batch), first, FIRST)))
            return pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(batch.column(1).to_numpy()[hit])], ["key", "node"])

        yield from _by_bucket(batches, take)

    small = posted if hot.isEmpty() else posted.join(hot, "key", "left_anti")
    found = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(candidates, "key long, node long")
    found = ws.table(found, "candidates")
    out = _small_links(found.join(nodes.select("node", "fp"), "node").select("key", "node", "fp"), near, most)
    if not hot.isEmpty():
        large = ws.table(posted.join(hot, "key", "left_semi").select("key", "node").join(nodes.select("node", "fp"), "node").select("key", "node", "fp"), "large")
        out = out.union(_large_links(ws, "clusters", large, near))
    return components(ws, ws.table(_thinned(out), "candidate-links"), "candidates")


def _with_components(docs: DataFrame, similarity: float, words: int) -> tuple[DataFrame, str, str]:
    """docs with their component's least doc_id and whether the row stays, and the names of these two columns."""
    ws = Workspace(docs.sparkSession, "similar")
    names = docs.columns
    digest, fp, component, stays = (fresh(names, x) for x in ("digest", "fp", "component_id", "stays"))

    def prints(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in texts(b)]
            new = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([wide_fingerprint(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, digest, fp])

    kinds = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    rows = ws.table(docs.mapInArrow(prints, T.StructType([*kinds, T.StructField(digest, T.BinaryType()), T.StructField(fp, T.BinaryType())])), "rows")
    ids = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.col(digest).alias("digest"), F.col(fp).alias("fp"))
    nodes = _numbered(ws, ids.groupBy("digest", "fp").agg(F.min("doc_id").alias("least")))
    clusters = _clusters(ws, nodes, similarity)

    # The sets of those in clusters, from one text of each class.
    known = ws.table(nodes.join(clusters, "node").select("node", "fp", F.col("label").alias("key"), "digest", "least"), "clustered")

    def sets(batches):
        for b in batches:
            own = [shingle_set(t, words).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.binary())], ["key", "node", "fp", "set"])

    one = ids.select(F.col("doc_id").alias("least"), "digest", "text").join(known, ["least", "digest"]).select("key", "node", "fp", "text")
    held = ws.table(one.mapInArrow(sets, "key long, node long, fp binary, set binary").dropDuplicates(["key", "node"]), "sets")
    hot = ws.table(held.groupBy("key").agg(_weight(True).alias("n")).where(F.col("n") > 1).select("key"), "hot-clusters")
    found = _thinned(group_links(ws, "alike", held, hot, alike(limit_of(similarity), similarity)))
    labels = components(ws, ws.table(found, "alike-links"), "alike")
    named = labels.join(nodes.select(F.col("node").alias("label"), F.col("least").alias("component")), "label").select("node", "component", (F.col("label") == F.col("node")).alias("head"))
    joined = nodes.join(ws.table(named, "named"), "node", "left")
    joined = ws.table(joined.select(F.col("digest").alias("__of"), F.coalesce("component", "least").alias("__component"), F.coalesce("head", F.lit(True)).alias("__head")), "components")
    out = rows.join(joined, rows[digest] == joined["__of"], "left")
    id_ = rows["doc_id"]
    of = F.when(id_.isNotNull(), joined["__component"])
    return out.select(*[rows[c] for c in names], of.alias(component), (id_.isNull() | (joined["__head"] & (id_ == joined["__component"]))).alias(stays)), component, stays


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, component_id): one row per document, with the smallest doc_id that is reached by links of such similarity."""
    out, component, _ = _with_components(docs.select("doc_id", "text"), similarity, words)
    return out.select("doc_id", F.col(component).alias("component_id"))


def distinct_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """docs, all columns, without the rows that such links connect to a row of a smaller doc_id. Of rows with equal shingles
    and doc_id each stays, and so does a row without a doc_id."""
    out, _, stays = _with_components(docs, similarity, words)
    return out.where(F.col(stays)).select(*docs.columns)
