"""A deterministic sharded WARC writer, and a reader.

Records are range-sorted by page_id; each task writes its range as files of gzip members, one record each, and rolls to
the next file once the compressed size reaches `roll`. Headers, lengths and digests are made anew from the payload.
Files get their names by renaming; the manifest, a table with one row per file, is committed last, so what a lost or
repeated task leaves is never read. It is written and read on the executors.

Of records with equal payloads of at least `least` bytes, the one with the greatest page_id is written as a response,
the others as revisits that refer to it; shorter ones are all responses. Payloads are equal if SHA-256, SHA-1 and length
are. Digests decide who refers to whom, grouped before anything is joined; the payloads themselves move once, into the
ranges, where the decisions meet them, and revisits' payloads aren't written.

Null html counts as empty, a null url as an empty one. Rows that repeat a page_id: the payload of the greatest page_id
may then have several responses, to which the others refer alike. A null page_id is the least, and gets no header of its
own; revisits of a payload that only null ones have don't exist, all of them are responses. An empty table gives no
files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, read_file, write_file

LEAST = 1000
ROLL = 16 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response, or a revisit without the payload."""
    sha1 = hashlib.sha1(payload).digest()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url)]
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode())]
    headers += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers_to is not None:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _urn(refers_to))]
    return _member(headers, block)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a file ends within a record")
            part = view[at : at + (1 << 16)]
            out.append(d.decompress(part))
            at += len(part)
        at -= len(d.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """The headers of a record (lower-case names), its block and, for responses, its payload; digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if len(rest) != len(block) + 4 or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != out["warc-block-digest"]:
        raise ValueError("a record isn't what was written")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
    out["payload"] = payload if out["warc-type"] == "response" else None
    if out["payload"] is not None and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["warc-payload-digest"]:
        raise ValueError("a payload isn't what was written")
    return out


def _number(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def decisions(pages: DataFrame, ws: Workspace, least: int = LEAST) -> DataFrame:
    """(page_id, sha256, refers_to) of the revisits, one row for each page_id and payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.sha1(html).alias("sha1"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).alias("n"))
    rows = ws.table(rows.where(F.col("n") >= least), "digests")
    key = ["sha256", "sha1", "n"]
    groups = rows.groupBy(*key).agg(F.max("page_id").alias("best"), F.count("*").alias("copies"))
    groups = ws.table(groups.where("copies > 1 and best is not null").drop("copies"), "groups")
    # Two written tables: adaptive execution splits a payload that many pages have. page_ids that repeat a payload give
    # equal rows, which is harmless: the writer looks up, it doesn't join.
    found = rows.join(groups, key).where(~F.col("page_id").eqNullSafe(F.col("best")))
    return ws.table(found.select("page_id", "sha256", F.col("best").alias("refers_to")), "decisions")


def write(pages: DataFrame, uri: str | None = None, least: int = LEAST, roll: int = ROLL, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes pages (page_id, url, html) as WARC files below uri, which it gives."""
    ws = Workspace(pages.sparkSession, "warc")
    uri = uri or f"{ws.uri}/files"
    told = decisions(pages, ws, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha256", "refers_to", F.lit(0).alias("kind"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    both = told.union(rows).withColumn("nth", F.monotonically_increasing_id())

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        first = last = None
        size = count = 0
        current: int | None = None
        refers: dict[str, int] = {}

        def flush():
            nonlocal made, held, size, count, first
            name = f"part-{part:06d}-{made:04d}.warc.gz"
            data = b"".join(held)
            write_file(f"{uri}/{name}", data)
            row = {"name": name, "records": count, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "least": first, "most": last}
            made, held, size, count, first = made + 1, [], 0, 0, None
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for b in batches:
            for page_id, url, html, sha, to, kind in zip(*(b.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    if current != page_id or not refers:
                        current, refers = page_id, {}
                    refers[sha] = to
                    continue
                if current != page_id:
                    current, refers = page_id, {}
                payload = html.encode()
                target = refers.get(hashlib.sha256(payload).hexdigest()) if refers else None
                held.append(record(page_id, url, payload, target, date))
                size += len(held[-1])
                count += 1
                first, last = (page_id if first is None else first), page_id
                if size >= roll:
                    yield flush()
        if held:
            yield flush()

    # Decisions come before the rows of their page_id, and in the same range: the ranges go by page_id alone.
    dealt = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "nth")
    done = dealt.select("page_id", "url", "html", "sha256", "refers_to", "kind").mapInArrow(run, "name string, records long, bytes long, sha256 string, least long, most long")
    done.write.mode("overwrite").parquet(f"{uri}/manifest")
    return uri


def manifest(spark, uri: str) -> DataFrame:
    """(name, records, bytes, sha256, least, most), one row per file."""
    return spark.read.schema("name string, records long, bytes long, sha256 string, least long, most long").parquet(f"{uri}/manifest")


_MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("least", pa.int64()), ("most", pa.int64())])


def read(spark, uri: str, with_payload: bool = False) -> DataFrame:
    """One row per record, from the files of the manifest: page_id, payload_bytes, payload_digest, record_type, refers_to, url; with_payload: html, null in revisits."""

    def run(batches):
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = read_file(f"{uri}/{name}")
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} isn't what the manifest says")
                rows: list[tuple] = []
                for m in members(data):
                    r = parse(m)
                    digest = base64.b32decode(r["warc-payload-digest"].partition(":")[2]).hex()
                    to = _number(r["warc-refers-to"]) if "warc-refers-to" in r else None
                    html = r["payload"].decode() if with_payload and r["payload"] is not None else None
                    rows.append((_number(r["warc-record-id"]), r["payload_bytes"], digest, r["warc-type"], to, r["warc-target-uri"], html))
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()][: 6 + with_payload]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"][: 6 + with_payload]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = manifest(spark, uri).select("name", "sha256")
    files = files.repartition(max(1, files.count()), "name")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", html string" * with_payload)
