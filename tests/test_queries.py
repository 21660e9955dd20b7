"""Every registered query against its SQL, on whole tables."""

import math

import duckdb
import pytest

from veracite import plans

D, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def rows(names, table):
    return sorted((tuple(plain(v) for v in r) for r in table), key=lambda r: [(v is not None, str(v)) for v in r])


def test_all_but_the_encoder_have_sql():
    assert plans.queries().keys() - plans.oracle_sql().keys() == {"embed_text"} and not plans.oracle_sql().keys() - plans.queries().keys()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    equal(spark, name, D)


@pytest.mark.parametrize("name", ["advice_filter", "near_dup_pairs", "shared_bodies", "ligature_repair", "part_units", "labelled_blocks", "index_fingerprint", "header_check", "pair_pool_probe", "benchmark_overlap"])
def test_query_equals_sql_on_more_rows(spark, name):
    assert equal(spark, name, LARGER)


def equal(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, folder)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    found = got.select(*names).collect()
    assert rows(names, found) == rows(names, want.select(", ".join(f'"{n}"' for n in names)).fetchall())
    return found


def test_embed_text(spark):
    got = plans.queries()["embed_text"](spark, D).collect()
    assert len(got) == 200 and all(r.dim == 256 and r.norm in (0, 1) for r in got)


def test_equal_bodies_of_any_sources(spark, tmp_path):
    rows = [(1, "a", "src7"), (2, "a", "src9"), (3, "a", "src9"), (4, "b", "src0"), (5, "c", "src1"), (6, "c", "src1")]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["equal_bodies"](spark, str(tmp_path)).collect()
    assert sorted((r.source, r.last_doc, r.n_docs) for r in got) == [("src7", 1, 1), ("src9", 3, 2)]
