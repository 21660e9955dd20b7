"""Suffix-array dedup by bucket-pointer refinement: removes bytes covered by a 50-byte string that an earlier document has.

Suffixes (here: all byte offsets from which 50 bytes of the same document follow) are put into buckets by their first
bytes, and buckets are refined by the bucket identifiers of later offsets until they tell 50-byte strings apart:

    8 bytes    the initial bucket is the bytes themselves, mixed;
    24 bytes   from the 8-byte identifiers at offsets 0, 8, 16;
    50 bytes   from the least 24-byte identifier among offsets 0 to 26, then from what follows it.

Identifiers are computed once for every offset, and what later rounds need of them is written beside the text: runs of
offsets that share their least 24-byte identifier, which is the pointer to their common bucket. Each round updates only
buckets that the one before left open, by that pointer; a bucket that one document has to itself is finished.

    round 1    one pointer for each run: has another document got it? Else the run is finished.
    round 2    the pointer and the run's whole content: if an earlier document has the run, all its strings are covered;
               if all runs of the bucket are alike, they are finished.
    round 3    the single 50-byte strings of the runs left over.

Documents are range-sorted by doc_id and packed into chunks; a long document is a chunk of its own, handled in slices.
A slice sends its distinct identifiers, sorted, as one blob for each shard of the identifier space that it has any in; a
shard merges the blobs and answers with two bits per identifier: does an earlier chunk have it, and is its bucket open?
Order within a chunk is settled in the chunk. So a passage that a third of all documents hold is one identifier per
slice, no pairs of documents are made, and chunks that are lost are computed again. A round-1 identifier has 32 bits
beside those of its shard: a chance match only costs a refinement. Those of rounds 2 and 3 are the pointer and 96 bits of
all the bytes they name (XXH3 over a run, two mixed 64-bit chains over a string); only strings of one bucket can share
one, with a probability of about the sum of n * n / 2^97 over buckets of n strings: 6e-14 for 10^13 strings in
buckets of a thousand.

Null text counts as empty. Texts shorter than 50 bytes stay whole. Repeated doc_ids, and null ones, which come first:
rows are ordered by doc_id and then as read, and a later row counts as having the greater id. An empty table gives an
empty result. Overlapping matches all count, and strings are judged on the input, not on what is left. Other columns may
have any names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Workspace, forget, fresh, read_file, texts, write_file

LENGTH, GRAM = 50, 24
#: Bytes of several documents in a chunk, and windows in a slice; identifiers for which there is a shard, and the least
#: number of shards; chunks whose answers share a file; windows of a run, to guess how many identifiers round 3 has.
CHUNK, KEYS, SHARDS, GROUP, USUAL_RUN = 1 << 20, 300_000, 48, 64, 32
#: Bytes of a run: its distance from the one before, its length less one, and its pointer of 56 bits.
RUN = 15
_K = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def _words(data: bytes, a: int, n: int) -> np.ndarray:
    """The 8 bytes from each of the n offsets from a as integers; zeros follow the data."""
    buf = data[a : a + n + 7]
    buf += bytes(n + 7 - len(buf))
    return np.ndarray((n,), "<u8", buf, strides=(1,))


def runs_of(data: bytes, a: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, bucket) of the runs among the windows a, a + 1, ... of data: those that follow each other and share
    their least 24-byte identifier. valid: which windows lie within a document; first and last count from a."""
    n = len(valid)
    b8 = _mix(_words(data, a, n + LENGTH - 8).astype(np.uint64))
    b24 = b8[:-16] * _K[0]
    b24 += b8[8:-8] * _K[1]
    b24 += b8[16:]
    del b8
    b24 ^= b24 >> np.uint64(31)
    b24 *= _K[2]
    least = b24
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    span = LENGTH - GRAM + 1  # 24-byte strings in a window
    least = np.minimum(least[:n], least[span - 16 :][:n])
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last), _mix(least[first] + _K[1]) & np.uint64((1 << 56) - 1)


def run_names(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """96-bit identifiers of data[start:end], as two columns."""
    digest = xxhash.xxh3_128_digest
    out = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), "<u8").reshape(-1, 2).copy()
    out[:, 1] &= np.uint64(0xFFFFFFFF)
    return out


def window_names(data: bytes, a: int, n: int, at: np.ndarray) -> np.ndarray:
    """96-bit identifiers of the 50-byte strings at some (at) of the n windows from a, as two columns."""
    words = _words(data, a, n + LENGTH - 8)
    x, y = np.full(len(at), _K[3]), np.full(len(at), _K[4])
    for i, k in enumerate((0, 8, 16, 24, 32, 40, LENGTH - 8)):
        w = words[at + k]
        x = (x ^ w) * _K[i]
        x ^= x >> np.uint64(32)
        y = (y + w) * _K[6 - i]
        y ^= y >> np.uint64(29)
    return np.stack([_mix(x), _mix(y) & np.uint64(0xFFFFFFFF)], 1)


@dataclass
class Slice:
    """Runs of one slice of a chunk: first and last window (from base), pointer, and document within the chunk."""

    number: int
    part: int
    base: int
    n: int
    first: np.ndarray
    last: np.ndarray
    bucket: np.ndarray
    doc: np.ndarray


def pack_runs(data: bytes, lengths: list[int]) -> list[bytes]:
    """The runs of a chunk, for each slice."""
    n, at = len(data), 0
    valid = np.zeros(n, bool)
    for k in lengths:
        valid[at : max(at, at + k - LENGTH + 1)] = True
        at += k
    out = []
    for a in range(0, n, CHUNK):
        first, last, bucket = runs_of(data, a, valid[a : a + CHUNK])
        gaps = first - np.concatenate([[0], last[:-1]])  # mostly 1, which takes no room once compressed
        high = (bucket >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        out.append(gaps.astype("<u4").tobytes() + (last - first).astype("<u4").tobytes() + bucket.astype("<u4").tobytes() + high.tobytes())
    return out


def slices(number: int, lengths: np.ndarray, runs: list[bytes]) -> Iterator[Slice]:
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    for part, blob in enumerate(runs):
        n, base = len(blob) // RUN, part * CHUNK
        span = np.frombuffer(blob, "<u4", n, 4 * n).astype(np.int64)
        last = np.cumsum(np.frombuffer(blob, "<u4", n) + span)
        first = last - span
        high = np.zeros((n, 4), np.uint8)
        high[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, 12 * n).reshape(-1, 3)
        bucket = (high.view("<u4")[:, 0].astype(np.uint64) << np.uint64(32)) | np.frombuffer(blob, "<u4", n, 8 * n)
        if n:
            yield Slice(number, part, base, min(CHUNK, total - base), first, last, bucket, np.searchsorted(starts, first + base, "right") - 1)


def route(bucket: np.ndarray, shards: int) -> np.ndarray:
    """A pointer's place: its shard, then 32 bits."""
    return ((((bucket >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(24)) << np.uint64(32)) | (bucket & np.uint64(0xFFFFFFFF))


class Keys:
    """What a slice has in a round: items (route, name or none, document), their distinct keys, and what others say of them.

    Without names a key is a route, else a route and a name.
    """

    def __init__(self, routes: np.ndarray, names: np.ndarray | None, doc: np.ndarray):
        order = np.argsort(routes, kind="stable") if names is None else np.lexsort((names[:, 1], names[:, 0], routes))
        new = np.ones(len(order), bool)
        ranked = routes[order]
        new[1:] = ranked[1:] != ranked[:-1]
        if names is not None:
            names = names[order]
            new[1:] |= (names[1:] != names[:-1]).any(1)
            names = names[new]
        self.names, self.route, self.doc = names, ranked[new], doc
        self.of = np.empty(len(order), np.int64)  # the key of each item
        self.of[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.first = np.minimum.reduceat(doc[order], starts) if len(starts) else starts
        last = np.maximum.reduceat(doc[order], starts) if len(starts) else starts
        self.below = np.zeros(len(starts), bool)
        self.many = self.first != last if names is None else np.zeros(len(starts), bool)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(shard, keys) for each shard that has any."""
        shard = (self.route >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(shard[a]), self.route[a:b].astype("<u4").tobytes() + (b"" if self.names is None else self.names[a:b, 0].tobytes() + self.names[a:b, 1].astype("<u4").tobytes())

    def told(self, bits: bytes | None) -> "Keys":
        n = len(self.route)
        if n:
            flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: 2 * n].reshape(-1, 2).astype(bool)
            self.below |= flags[:, 0]
            self.many |= flags[:, 1]
        return self

    def earlier(self) -> np.ndarray:
        """Which items an earlier document has too."""
        return self.below[self.of] | (self.first[self.of] < self.doc)

    def open(self) -> np.ndarray:
        """Without names: which items other documents have. With names: which items' routes have more than one name."""
        return self.many[self.of]


@functools.lru_cache(4)
def _answers_of(uri: str, group: int) -> dict[tuple[int, int], bytes]:
    t = pa.ipc.open_stream(read_file(f"{uri}/{group}")).read_all()
    return dict(zip(zip(t["number"].to_pylist(), t["part"].to_pylist()), t["bits"].to_pylist()))


def refined(s: Slice, data: bytes | None, answered: list[tuple[str, int]], shards: int) -> tuple[Keys, list]:
    """The keys of the round that follows those answered (folder and shards of each), and the covered spans (starts, ends)
    known so far, from the chunk's start."""
    told = lambda keys, k: keys.told(_answers_of(answered[k][0], s.number // GROUP).get((s.number, s.part)) if len(keys.route) else None)
    counts = [n for _, n in answered] + [shards]
    keys = Keys(route(s.bucket, counts[0]), None, s.doc)
    if len(answered) == 0:
        return keys, []
    runs = np.flatnonzero(told(keys, 0).open())
    starts, ends = s.base + s.first[runs], s.base + s.last[runs] + LENGTH
    keys = Keys(route(s.bucket[runs], counts[1]), run_names(data, starts, ends), s.doc[runs])
    if len(answered) == 1:
        return keys, []
    earlier, open_ = told(keys, 1).earlier(), keys.open()
    spans = [(starts[earlier], ends[earlier])]
    rest = runs[open_ & ~earlier]
    n = s.last[rest] - s.first[rest] + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - s.first[rest], n)
    keys = Keys(np.repeat(route(s.bucket[rest], counts[2]), n), window_names(data, s.base, s.n, at), np.repeat(s.doc[rest], n))
    if len(answered) == 2:
        return keys, []
    at = s.base + at[told(keys, 2).earlier()]
    return keys, [*spans, (at, at + LENGTH)]


def answers(requests: DataFrame, uri: str, wide: bool) -> int:
    """Writes two bits for each key of each slice, in order: does a chunk of a smaller number have it; and does another
    chunk have it (keys without names) or has its route more than one name (keys with names). Gives how many keys stay open."""

    def merge(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        counts = [len(b) // (16 if wide else 4) for b in blobs]
        owner = np.repeat(table["number"].to_numpy(), counts)
        place = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, counts)])
        names = np.stack([np.concatenate([np.frombuffer(b, "<u8", n, 4 * n) for b, n in zip(blobs, counts)]), np.concatenate([np.frombuffer(b, "<u4", n, 12 * n).astype(np.uint64) for b, n in zip(blobs, counts)])], 1) if wide else None
        del blobs
        order = np.lexsort((owner, names[:, 1], names[:, 0], place) if wide else (owner, place))
        owner, place = owner[order], place[order]
        bucket = np.ones(len(order), bool)
        bucket[1:] = place[1:] != place[:-1]
        key = bucket.copy()
        if wide:
            names = names[order]
            key[1:] |= (names[1:] != names[:-1]).any(1)
        starts = np.flatnonzero(key)
        of = np.cumsum(key) - 1
        flags = np.zeros((len(order), 2), np.uint8)
        flags[order, 0] = owner[starts][of] < owner
        if wide:
            kinds = np.add.reduceat(key.astype(np.int64), np.flatnonzero(bucket))
            flags[order, 1] = kinds[np.cumsum(bucket) - 1] > 1
        else:
            flags[order, 1] = (owner[starts] != owner[np.append(starts[1:], len(owner)) - 1])[of]
        cut = np.cumsum([0, *counts]).tolist()
        bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"number": table["number"], "part": table["part"], "shard": table["shard"], "n": pa.array(counts, pa.int64()), "bits": pa.array(bits, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["number"].to_pylist(), table["part"].to_pylist(), table["shard"].to_pylist(), table["n"].to_pylist(), table["bits"].to_pylist()))
        own: dict[tuple[int, int], list] = {}
        left = 0
        for number, part, _, n, bits in rows:
            flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: 2 * n]
            left += int(np.count_nonzero(flags[1::2] & (flags[::2] == 0) if wide else flags[1::2]))
            own.setdefault((number, part), []).append(flags)
        packed = [np.packbits(np.concatenate(x)).tobytes() for x in own.values()]
        out = pa.table({"number": pa.array([k[0] for k in own], pa.int64()), "part": pa.array([k[1] for k in own], pa.int32()), "bits": pa.array(packed, pa.binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema) as w:
            w.write_table(out)
        write_file(f"{uri}/{rows[0][0] // GROUP}", sink.getvalue().to_pybytes())
        return pa.table({"left": pa.array([left], pa.int64())})

    told = requests.groupBy("shard").applyInArrow(merge, "number long, part int, shard int, n long, bits binary")
    return told.groupBy(F.expr(f"number div {GROUP}")).applyInArrow(gather, "left long").agg(F.sum("left")).first()[0] or 0


def _batch_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


_CHUNKS = pa.schema([("number", pa.int64()), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()), ("rest", pa.binary()), ("runs", pa.list_(pa.binary()))])


def _packed(docs: DataFrame) -> DataFrame:
    """(number, lengths, data, rest, runs): documents in order of doc_id, packed into chunks; numbers ascend with doc_id.
    A chunk has several documents of CHUNK bytes at most, or one. rest: the other columns."""

    def run(batches):
        first, made, rows, data, held = TaskContext.get().partitionId() << 24, 0, [], [], 0

        def flush():
            nonlocal made, rows, data, held
            rest = pa.Table.from_batches(rows).combine_chunks().to_batches()
            lengths, whole = [len(t) for t in data], b"".join(data)
            row = {"number": first + made, "lengths": lengths, "data": whole, "rest": _batch_bytes(rest[0]), "runs": pack_runs(whole, lengths)}
            made, rows, data, held = made + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

        for b in batches:
            own, a = b.select([c for c in b.schema.names if c != "text"]), 0
            for i, t in enumerate(texts(b)):
                if data and held + len(t) > CHUNK:
                    if i > a:
                        rows.append(own.slice(a, i - a))
                    a = i
                    yield flush()
                data.append(t)
                held += len(t)
            if a < b.num_rows:
                rows.append(own.slice(a))
        if data:
            yield flush()

    nth = fresh(docs.columns, "nth")
    dealt = docs.withColumn(nth, F.monotonically_increasing_id()).repartitionByRange("doc_id", nth).sortWithinPartitions("doc_id", nth).drop(nth)
    return dealt.mapInArrow(run, "number long, lengths array<long>, data binary, rest binary, runs array<binary>")


def whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """UTF-8 data without the characters whose bytes are all gone."""
    if not len(data):
        return b""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    first = first if len(first) and not first[0] else np.concatenate([[0], first])
    out = np.logical_and.reduceat(gone, first)
    return data[~np.repeat(out, np.diff(np.append(first, len(data))))].tobytes()


def _judged(docs: DataFrame, schema, columns) -> DataFrame:
    """What columns(rest of the columns, text, which bytes go) makes of the documents of a chunk: a record batch of schema."""
    ws = Workspace(docs.sparkSession, "suffix-dedup")
    chunks = ws.table(_packed(docs), "chunks", "zstd")
    count = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x).cast("long"))
    left = (chunks.agg(F.sum(count(F.col("runs")))).first()[0] or 0) // RUN
    forget(docs.sparkSession)
    answered: list[tuple[str, int]] = []
    for k in range(3):
        shards = max(SHARDS, -(-left // KEYS))

        def ask(batches, answered=tuple(answered), shards=shards):
            for b in batches:
                for i in range(b.num_rows):
                    data = b.column(3)[i].as_py() if answered else None
                    for s in slices(b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(), b.column(2)[i].as_py()):
                        found = list(refined(s, data, list(answered), shards)[0].blobs())
                        if found:
                            n = len(found)
                            cols = [pa.array([s.number] * n, pa.int64()), pa.array([s.part] * n, pa.int32()), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())]
                            yield pa.RecordBatch.from_arrays(cols, ["number", "part", "shard", "keys"])

        asked = chunks.select("number", "lengths", "runs", *["data"] * (k > 0))
        uri = f"{ws.uri}/round{k + 1}"
        left = answers(asked.mapInArrow(ask, "number long, part int, shard int, keys binary"), uri, k > 0) * (USUAL_RUN if k else 1)
        answered.append((uri, shards))
        forget(docs.sparkSession)

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                number, lengths, runs, data, rest = (b.column(c)[i] for c in range(5))
                number, lengths, runs, data = number.as_py(), lengths.values.to_numpy(), runs.as_py(), data.as_py()
                edges = np.zeros(len(data) + 1, np.int32)
                for s in slices(number, lengths, runs):
                    for starts, ends in refined(s, data, answered, 1)[1]:
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, ends, -1)
                gone = np.cumsum(edges[:-1]) > 0
                own = pa.ipc.open_stream(rest.as_py()).read_all().combine_chunks().to_batches()[0]
                ends = np.cumsum(lengths)
                for a in range(0, len(ends), 500):
                    e = ends[a : a + 500].tolist()
                    at = [int(ends[a - 1]) if a else 0, *e]
                    yield columns(own.slice(a, len(e)), [(data[x:y], gone[x:y]) for x, y in zip(at[:-1], at[1:])])

    return chunks.select("number", "lengths", "runs", "data", "rest").mapInArrow(cut, schema)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def columns(own, judged):
        removed = [int(np.count_nonzero(g)) for _, g in judged]
        spans = [int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0 for (_, g), n in zip(judged, removed)]
        digests = [hashlib.sha256(_kept(t, g)).hexdigest() for t, g in judged]
        new = [pa.array([len(t) for t, _ in judged], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays([own.column(0), *new], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _judged(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text that is left; a character stays whole if some byte of it is left. n_chars, where there is such a
    column, follows in rows whose text is cut. Null texts that nothing is cut from become empty."""
    kinds = docs.schema
    n_chars = next((f for f in kinds if f.name == "n_chars" and isinstance(f.dataType, T.LongType)), None)

    def columns(own, judged):
        left = [whole_characters(np.frombuffer(t, np.uint8), g).decode() if g.any() else t.decode() for t, g in judged]
        by_name = dict(zip(own.schema.names, own.columns)) | {"text": pa.array(left, pa.string())}
        if n_chars:
            by_name["n_chars"] = pa.array([len(x) if g.any() else n for x, (_, g), n in zip(left, judged, by_name["n_chars"].to_pylist())], pa.int64())
        return pa.RecordBatch.from_arrays([by_name[c] for c in docs_columns], docs_columns)

    docs_columns = docs.columns
    return _judged(docs, T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds]), columns)
