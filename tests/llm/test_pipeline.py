"""The stages of the pipeline against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_dedup import brute_removed, families, jaccard
from veracite.llm import toxicity

KINDS = "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, n_removed string, component_id double, sha string, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "r", 0.5, "h", True) for i, t in rows], KINDS)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[1:]])
def test_empty_table(spark, stage):
    assert stage(spark, frame(spark, []), "").count() == 0


def test_exact_stage(spark):
    rows = [(3, "a"), (5, "a"), (5, "unique text"), (7, "a "), (8, "a\n"), (None, "a"), (None, "b"), (None, "b"), (9, None), (10, ""), (2, "twice"), (2, "twice")]
    docs = frame(spark, rows)
    out = pipeline.exact_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert left(out) == sorted([(3, "a"), (5, "unique text"), (7, "a "), (None, "b"), (None, "b"), (9, None), (2, "twice"), (2, "twice")], key=str)


def test_near_stage(spark):
    rows = [*families(random.Random(5), 20), (5000, None), (5001, ""), (None, "x y z")]
    rows += [(6000, rows[0][1] + " more"), (rows[3][0], "some other text of this id")]
    comp, n = list(range(len(rows))), len(rows)
    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    stay = [min((rows[j][0], j) for j in range(n) if comp[j] == comp[i])[1] == i if rows[i][0] is not None else True for i in range(n)]
    out = pipeline.near_dedup(spark, frame(spark, rows), "")
    assert out.dtypes == frame(spark, rows).dtypes
    assert left(out) == sorted((r for r, s in zip(rows, stay) if s), key=str) and not all(stay)


def test_suffix_stage(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh é") for _ in range(200))
    rows = [(i, "".join(rng.choice("xyzö") for _ in range(rng.randrange(60))) + shared[rng.randrange(100) :][: rng.randrange(40, 120)] + "é" * (i % 3)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, shared)]
    docs = frame(spark, rows)
    out = pipeline.suffix_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    want, text = brute_removed(rows), dict(rows)
    for r in out.collect():
        assert (r.text == (text[r.doc_id] or "")) == (want[r.doc_id][1] == 0), r.doc_id
        assert r.n_chars == len(r.text) and len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1]) in (0, 1, 2)


def test_toxicity_stage_keeps_what_the_model_keeps(spark, tmp_path):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice("wind river house green table walk seven paper".split()) for _ in range(30))
    rows = [(i, clean() + (" vile slur vile slur" if i % 5 == 0 else "")) for i in range(400)] + [(None, clean()), (401, None), (402, ""), (5, clean())]
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    out = pipeline.toxicity(spark, docs, str(tmp_path))
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert out.dtypes == docs.dtypes
    assert left(out) == sorted(((i, t) for i, t in rows if model.score((t or "").encode()) < toxicity.THRESHOLD), key=str)
    assert left(out) == sorted((r for r in rows if "vile" not in (r[1] or "")), key=str)


def test_packing_stage(spark):
    out = pipeline.packing(spark, frame(spark, [(1, "a b c"), (1, "a b c"), (None, None), (2, "")]), "").collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4


def test_whole_pipeline(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({r.doc_id for r in rows}) > 100
