"""Top-k search and WARC archives against SQL and brute force."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veracite.llm import queries, topk_search, warc
from veracite.llm.runtime import read_file

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name, table, d=SMALL):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{d}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, d)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str)


def test_op2_matches_sql(spark):
    same_as_sql(spark, "op2_topk_search", "embeddings")


def brute(rows, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            v.setdefault(i, []).append([math.floor(256 * y) for y in x])
    out = []
    for q in sorted(v):
        if q % 50:
            continue
        for qv in {tuple(x) for x in v[q]}:
            found = sorted((-sum(a * b for a, b in zip(qv, x)), i) for i, xs in v.items() for x in xs if i != q and len(x) == len(qv) and qv)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,bits", [(4096, 6), (3, 2)])
def test_topk_odd_vectors(spark, monkeypatch, block, bits):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [float(rng.randrange(-2, 3)) for _ in range(8)]) for i in range(300, 500)]  # ties
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (701, [3.0, 1.0]), (750, []), (800, [1e6] * 8), (801, [-1e6] * 8), (3, [9.0] * 8)]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk_search.top_k(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0, 5, bits=bits)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") >= 0).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = np.random.RandomState(3)
    v = rng.randint(-300, 300, (200, 16)).astype(np.int64)
    grid = topk_search.Grid({16: (v.min(0), v.max(0))}, 3)
    mid, exact = v.astype(float) @ grid.middles(grid.encode(v)).T, v @ v.T
    assert (np.abs(mid - exact) <= grid.error(v.astype(float))[:, None]).all()


def test_op7_matches_sql(spark):
    same_as_sql(spark, "op7_warc", "pages")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, kind string")


def test_warc_revisits_and_rolls(spark):
    rng = random.Random(1)
    big = ["é" * 700, "a" * 1000, "b" * 999, "c\r\n\r\nd" * 400]
    rows = [(i, f"http://x/{i} é", rng.choice(big + [None, "", "short"])) for i in range(200)]
    uri = warc.write(pages(spark, rows), roll=3000)
    manifest = [r.asDict() for r in warc.manifest(spark, uri).orderBy("name").collect()]
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == 200
    got = {r.page_id: r for r in warc.read(spark, uri, with_payload=True).collect()}
    for i, u, h in rows:
        h = h or ""
        same = [j for j, _, g in rows if (g or "") == h]
        again = len(h.encode()) >= 1000 and i != max(same)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", max(same)) if again else ("response", None))
        assert got[i].payload_bytes == len(h.encode()) and got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest()
        assert got[i].html == (None if again else h)
    first = [read_file(f"{uri}/{m['name']}") for m in manifest]
    uri2 = warc.write(pages(spark, rows), roll=3000)
    manifest2 = [r.asDict() for r in warc.manifest(spark, uri2).orderBy("name").collect()]
    assert manifest2 == manifest and [read_file(f"{uri2}/{m['name']}") for m in manifest2] == first


def test_warc_odd_rows(spark):
    uri = warc.write(pages(spark, []))
    assert warc.manifest(spark, uri).count() == 0 and warc.read(spark, uri).count() == 0
    h = "z" * 1500
    uri = warc.write(pages(spark, [(None, None, h), (None, "u", "y" * 1200), (None, "v", "y" * 1200), (5, "w", h), (5, "w", h), (2, "w", h)]))
    got = sorted(((r.page_id if r.page_id is not None else -1), r.record_type, r.refers_to or 0) for r in warc.read(spark, uri).collect())
    assert got == [(-1, "response", 0), (-1, "response", 0), (-1, "revisit", 5), (2, "revisit", 5), (5, "response", 0), (5, "response", 0)]
