"""Manifests and the fetchers that follow them.

A manifest names the sources of a corpus. Fetching is driver I/O on a few dozen documents; the outcome of each source is a
row, so one that fails doesn't stop the rest. The transport is a parameter, which also keeps tests off the network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .markup import html_to_text, pdf_to_text

FETCH_STATUS = "id string, ok boolean, bytes long, error string, path string"


@dataclass
class Response:
    status: int
    content: bytes


def http_get(url: str, timeout: float = 90) -> Response:
    request = urllib.request.Request(url, headers={"User-Agent": "veracite/0.1 (research)"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Response(r.status, r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read())


def manifest(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The sources of a manifest file (with its date as ecfr_date), all or those of one kind, in order."""
    raw = spark.read.schema(f"ecfr_date string, sources array<struct<{', '.join(x.replace(' ', ':', 1) for x in schemas.SOURCE.split(', '))}>>").json(path, multiLine=True)
    rows = raw.select("ecfr_date", F.posexplode("sources").alias("ord", "s")).select("ord", "ecfr_date", "s.*")
    return rows.where(F.col("kind") == kind) if kind else rows


def part_url(date: Column, title: Column, part: Column) -> Column:
    """Where a part of the federal code is published, as of a date."""
    return F.format_string("https://www.ecfr.gov/api/versioner/v1/full/%s/title-%d.xml?part=%s", date, title, part)


def get_with_retry(url: str, get: Callable[[str], Response] = http_get, attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> Response | None:
    """A request that is repeated while the server answers 202 (still rendering), each time after a longer wait."""
    last = None
    for i in range(attempts):
        last = get(url)
        if last.status != 202:
            break
        wait(3 * (i + 1))
    return last


def _failure(r: Response | None) -> str | None:
    if r is None:
        return "no response"
    if r.status != 200:
        return f"HTTP {r.status}: {r.content[:200].decode('utf-8', 'replace').strip()}"
    return None if r.content else "empty body"


def fetch(spark: SparkSession, sources: DataFrame, folder: str, get: Callable[[str], Response] = http_get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Fetches every source of a manifest into folder: XML as it is, HTML and PDF as text beside a .meta.json; gives FETCH_STATUS rows."""
    from ..sources.files import write_bytes

    url = F.when(F.col("kind") == "ecfr", part_url(F.col("ecfr_date"), F.col("title"), F.col("part"))).otherwise(F.col("url"))
    done = []
    for r in sources.withColumn("url", url).orderBy("ord").collect():  # one row per source of a manifest
        try:
            answer = get(r.url) if r.kind == "ecfr" else get_with_retry(r.url, get, wait=wait)
        except Exception as e:  # noqa: BLE001 - whatever a transport raises becomes that source's row
            done.append((r.id, False, None, f"{type(e).__name__}: {e}", None))
            continue
        if error := _failure(answer):
            done.append((r.id, False, None, error, None))
            continue
        if r.kind == "ecfr":
            data, path = answer.content, f"{folder}/{r.id}.xml"
        else:
            try:
                data = (pdf_to_text if r.kind == "pdf" else html_to_text)(answer.content).encode()
            except Exception as e:  # noqa: BLE001 - extraction libraries raise broadly
                done.append((r.id, False, None, f"extract: {type(e).__name__}", None))
                continue
            path = f"{folder}/{r.id}.txt"
            meta = {k: v for k, v in r.asDict().items() if v is not None and k not in ("ord", "ecfr_date")}
            write_bytes(spark, f"{folder}/{r.id}.meta.json", json.dumps(meta, indent=2).encode())
        write_bytes(spark, path, data)
        done.append((r.id, True, len(data), None, path))
        wait(0.5)
    return spark.createDataFrame(done, FETCH_STATUS)


def fetch_summary(status: DataFrame) -> DataFrame:
    """(n, n_ok, unresolved): counts and the ids that failed."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("id")))), ", ")
    return status.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), failed.alias("unresolved"))
