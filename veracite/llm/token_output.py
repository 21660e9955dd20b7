"""Token-id shards with a minimal perfect hash index.

Documents are dealt out in ranges of doc_id and sorted; each task writes its range as shards: a .bin file of raw
little-endian ids (16 bits each where the vocabulary fits, else 32) and a .idx file. The index holds the rows in order
(doc_id, offset) and a minimal perfect hash from doc_ids to rows with a stored 32-bit fingerprint. A keyed read finds its
shard by the ranges in the manifest, then reads the index's head, one bucket, one slot, one row and one range of the
payload, whatever the shard's size; a key that isn't there is refused by the fingerprint, and with certainty once the
row's doc_id is compared. Reading all documents goes through the same hash, many keys at a time. Files get their names by
renaming; the manifest, a table with one row per shard, is committed last, and stays on the executors.

Null text counts as empty. Order: doc_id ascending, null first; rows that repeat a doc_id follow in input order, and a
keyed read gives all of them. Null doc_ids are in the payload but have no key. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Workspace, file_system, read_file, texts, write_file
from .tokenization import END, encoder

MAGIC = b"VCTOK1\0\0"
_HEAD = struct.Struct("<8sIIQQQ")  # magic, bytes per id, seed, rows, keys, buckets
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them well."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: hash, then displace, with the single keys put where room is left."""

    def __init__(self, shift: np.ndarray, n: int):
        self.shift, self.n = shift, n

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        buckets = max(1, -(-n // 4))
        shift = np.zeros(buckets, np.int32)
        if not n:
            return cls(shift, 0)
        h = mix(keys)
        of = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=buckets)
        first = np.concatenate([[0], np.cumsum(counts)])
        free = np.ones(n, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            k = counts[b]
            if k < 2:
                break
            own, d = h[order[first[b] : first[b + 1]]], 1
            while True:
                tries = np.arange(d, d + 32, dtype=np.uint64)
                slots = (mix(own[:, None] + tries * _GOLD) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(0)
                if k > 1 and good.any():
                    s = np.sort(slots[:, good], 0)
                    apart = (s[1:] != s[:-1]).all(0)
                    if apart.any():
                        at = np.flatnonzero(good)[np.argmax(apart)]
                        shift[b] = d + at
                        free[slots[:, at]] = False
                        break
                d += 32
        single = np.flatnonzero(counts == 1)
        shift[single] = -1 - np.flatnonzero(free)[: len(single)]
        return cls(shift, n)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; that of a key which isn't in the set is any slot."""
        return self.slot(keys, (mix(keys) % np.uint64(len(self.shift))).astype(np.int64))

    def slot(self, keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        h = mix(keys)
        d = self.shift[buckets].astype(np.int64)
        moved = (mix(h + np.maximum(d, 0).astype(np.uint64) * _GOLD) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(d < 0, -1 - d, moved)


def _print32(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + _GOLD) >> np.uint64(32)).astype("<u4")


def _index(ids: list, counts: list[int], width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype("<u8")
    known = np.array([x is not None for x in ids], bool)
    numbers = np.array([x or 0 for x in ids], "<i8")
    keys, rows = np.unique(numbers[known], return_index=True)
    rows = np.flatnonzero(known)[rows]
    ph = PerfectHash.build(keys.view(np.uint64))
    slots = ph(keys.view(np.uint64)) if len(keys) else np.zeros(0, np.int64)
    prints, at = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slots], at[slots] = _print32(keys.view(np.uint64)), rows
    head = _HEAD.pack(MAGIC, width, 0, len(ids), len(keys), len(ph.shift))
    return head + numbers.tobytes() + known.astype("u1").tobytes() + offsets.tobytes() + ph.shift.astype("<i4").tobytes() + prints.tobytes() + at.tobytes()


class ShardIndex:
    """A read .idx file."""

    def __init__(self, data: bytes):
        magic, self.width, _, n, k, b = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not an index of token shards")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.ids, self.known, self.offsets = take("<i8", n), take("u1", n).astype(bool), take("<u8", n + 1)
        self.hash, self.prints, self.rows = PerfectHash(take("<i4", b), k), take("<u4", k), take("<u4", k)

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each doc_id, -1 for those that aren't there."""
        if not len(self.rows):
            return np.full(len(keys), -1)
        x = keys.astype("<i8").view(np.uint64)
        slots = self.hash(x)
        rows = self.rows[slots].astype(np.int64)
        return np.where((self.prints[slots] == _print32(x)) & (self.ids[rows] == keys), rows, -1)

    def places(self) -> np.ndarray:
        """The row of every document in order, found by its key; null doc_ids, which have none, come first."""
        keys = self.ids[self.known]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.arange(len(keys))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))  # rows that repeat a doc_id follow its first one
        found = self.locate(keys)
        if (found < 0).any():
            raise ValueError("the index doesn't find its own keys")
        return np.concatenate([np.flatnonzero(~self.known), found + nth])


class KeyedReader:
    """Reads single entries of an .idx file by ranges."""

    def __init__(self, file):
        self.file = file
        magic, self.width, _, self.n, self.k, self.b = _HEAD.unpack(file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not an index of token shards")
        self.known = _HEAD.size + 8 * self.n
        self.offsets = self.known + self.n
        self.shift = self.offsets + 8 * (self.n + 1)
        self.prints = self.shift + 4 * self.b
        self.rows = self.prints + 4 * self.k

    def _at(self, start: int, kind: str, i: int, count: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(size * count, start + size * i), kind)

    def find(self, key: int) -> list[tuple[int, int]]:
        """Ranges (start, end), in ids, of the rows of a doc_id."""
        if not self.k:
            return []
        x = np.array([key], "<i8").view(np.uint64)
        bucket = int(mix(x)[0] % np.uint64(self.b))
        slot = int(PerfectHash(self._at(self.shift, "<i4", bucket), self.k).slot(x, np.zeros(1, np.int64))[0])
        if self._at(self.prints, "<u4", slot)[0] != _print32(x)[0]:
            return []
        row, out = int(self._at(self.rows, "<u4", slot)[0]), []
        while row < self.n and self._at(_HEAD.size, "<i8", row)[0] == key and self._at(self.known, "u1", row)[0]:
            out.append(tuple(self._at(self.offsets, "<u8", row, 2).tolist()))
            row += 1
        return out


def write_shards(docs: DataFrame, tokenizer: str, uri: str, roll: int = 32 << 20) -> None:
    """Writes the shards of docs (doc_id, text) below uri, then their manifest. roll: bytes of payload that end a shard."""

    def run(batches):
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, payload, held = [], [], [], 0

        def flush():
            nonlocal made, ids, counts, payload, held
            name = f"shard-{part:06d}-{made:04d}"
            data = b"".join(payload)
            write_file(f"{uri}/{name}.bin", data)
            write_file(f"{uri}/{name}.idx", _index(ids, counts, width))
            known = [x for x in ids if x is not None]
            row = {"name": name, "part": part, "rows": len(ids), "tokens": sum(counts), "bytes": len(data), "crc32": zlib.crc32(data), "least": known[0] if known else None, "most": known[-1] if known else None}
            made, ids, counts, payload, held = made + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), texts(b)):
                x = np.append(np.frombuffer(enc.encode(t), "<u4"), np.uint32(END)).astype(f"<u{width}")
                ids.append(doc)
                counts.append(len(x))
                payload.append(x.tobytes())
                held += x.nbytes
                if held >= roll:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("nth")).repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    rows.select("doc_id", "text").mapInArrow(run, _MANIFEST_KIND).write.mode("overwrite").parquet(f"{uri}/manifest")


_MANIFEST_KIND = "name string, part int, rows long, tokens long, bytes long, crc32 long, least long, most long"
_MANIFEST = pa.schema([("name", pa.string()), ("part", pa.int32()), ("rows", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])


class TokenStore:
    """Written shards."""

    def __init__(self, spark, uri: str):
        self.spark, self.uri = spark, uri

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, uri: str | None = None, roll: int = 32 << 20) -> "TokenStore":
        uri = uri or f"{Workspace(docs.sparkSession, 'token-output').uri}/shards"
        write_shards(docs, tokenizer, uri, roll)
        return cls(docs.sparkSession, uri)

    @property
    def manifest(self) -> DataFrame:
        """One row per shard; names ascend with doc_id."""
        return self.spark.read.schema(_MANIFEST_KIND).parquet(f"{self.uri}/manifest")

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the rows of a doc_id: no row, one, or more where it is repeated."""
        out = []
        for m in self.manifest.where((F.col("least") <= doc_id) & (F.col("most") >= doc_id)).orderBy("name").collect():
            files, path = file_system(f"{self.uri}/{m['name']}")
            with files.open_input_file(f"{path}.idx") as index, files.open_input_file(f"{path}.bin") as payload:
                reader = KeyedReader(index)
                w = reader.width
                out += [np.frombuffer(payload.read_at((b - a) * w, a * w), f"<u{w}") for a, b in reader.find(doc_id)]
        return out

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, shard), one row per document, from the files."""
        uri = self.uri
        # Ids before a shard: those of the tasks before its own (a window over one row for each), then those of its task.
        m = self.manifest
        upto = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tasks = m.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", upto(Window.orderBy("part")).alias("before"))
        own = m.select("part", "name", "crc32", upto(Window.partitionBy("part").orderBy("name")).alias("within"))

        def run(batches):
            for b in batches:
                for name, base, crc in zip(*(b.column(i).to_pylist() for i in range(3))):
                    index, data = ShardIndex(read_file(f"{uri}/{name}.idx")), read_file(f"{uri}/{name}.bin")
                    if zlib.crc32(data) != crc:
                        raise ValueError(f"{name}: the payload isn't what was written")
                    ids, offsets, places = np.frombuffer(data, f"<u{index.width}"), index.offsets.astype(np.int64), index.places()
                    for i in range(0, len(places), 4096):
                        rows = places[i : i + 4096]
                        starts, ends = offsets[rows], offsets[rows + 1]
                        crcs = [zlib.crc32(ids[a:c].astype("<u4")) for a, c in zip(starts.tolist(), ends.tolist())]
                        cols = [pa.array(index.ids[rows], mask=~index.known[rows]), pa.array(base + starts), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([name] * len(rows))]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

        table = own.join(tasks, "part").select("name", (F.col("before") + F.col("within")).alias("base"), "crc32").repartition(max(1, m.count()), "name")
        return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
