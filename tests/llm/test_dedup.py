"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from veracite.llm import exact_dedup, queries, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, recipe string, node string, number string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "r", "n", "1") for i, t in rows], SCHEMA)


def sample(seed=5, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "Ä", "été", "and", "re", "long", "x\ty", "z\n"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = text(60)
    rows = [(7, None), (3, ""), (12, " "), (13, "\t\n "), (14, "a b"), (15, "a \x0b b"), (16, " a b"), (17, "a b")]
    for i in range(20, 20 + n):
        kind = rng.random()
        t = text(rng.choice([1, 5, 40, 200]))
        rows.append((i, t + shared[rng.randrange(50) :] + text(9) if kind < 0.4 else rows[-1][1] if kind < 0.5 else t))
    rows += [(100, text(4000)), (101, text(3000) + shared), (102, shared * 3), (103, "q" * 500), (104, "q" * 300)]
    rng.shuffle(rows)
    return rows


def test_exact_matches_brute_force(spark):
    rows = sample()
    for width in (16, 1):  # one byte of digest: nearly every chunk shares its digest with others
        got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, rows), width).collect()}
        body = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in rows}
        groups = {}
        for i, b in body.items():
            groups.setdefault(b, []).append(i)
        for i, b in body.items():
            g = groups[b]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(g), len(g), i == min(g)), (width, i)
            assert got[i].text_sha256 == hashlib.sha256(b.encode()).hexdigest()


def test_exact_odd_rows(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    got = exact_dedup.exact_groups(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]


def test_cuts_cover_and_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    ends = exact_dedup.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert max(b - a for a, b in zip([0, *ends], ends)) <= exact_dedup.MOST
    shifted = exact_dedup.cuts(b"12345" + data)
    assert len({e + 5 for e in ends} & set(shifted)) > len(ends) * 0.9
    assert exact_dedup.cuts(b"") == [] and exact_dedup.cuts(b"a") == [1]


def test_op1_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.sql(f"select {cols} from ({queries.oracle_sql()['op1_exact_dedup']}) order by 1").fetchall()
    assert [tuple(r) for r in queries.op1_exact_dedup(spark, d).select(*cols.split(", ")).orderBy("doc_id").collect()] == want


def brute_fingerprint(text):
    w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints):
    ids, comp = sorted(prints), {i: i for i in prints}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    again = True
    return comp


@pytest.mark.parametrize("large", [4000, 8])
def test_simhash_matches_brute_force(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rows = sample(8)
    rng = random.Random(4)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    for i in range(200, 260):  # near copies of a long text
        w = (base * 30)[:500]
        w[rng.randrange(500)] = "edit"
        rows.append((i, " ".join(w)))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in got.items()}
    assert comp == {i: r.component_id for i, r in got.items()}
    assert len({comp[i] for i in range(200, 260)}) < 30


@pytest.mark.parametrize("large", [4000, 20])
def test_simhash_chains_of_fingerprints(spark, large, monkeypatch):
    """Links over many steps, sign bits included, by nodes made directly."""
    from veracite.llm.graph import components
    from veracite.llm.runtime import Workspace

    monkeypatch.setattr(simhash, "LARGE", large)
    rng, prints, x = random.Random(2), {}, 0
    for i in range(70):
        prints[1000 - i] = x
        for b in rng.sample(range(64), 2):
            x ^= 1 << b
    for i in range(300):  # many that share a segment's value
        prints[2000 + i] = rng.getrandbits(6) << 40 | 0xABCD
    prints = dict({v: k for k, v in prints.items()}.items())
    prints = {k: v for v, k in prints.items()}
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp long")
    ws = Workspace(spark, "test")
    got = {r.node: r.label for r in components(ws, simhash.links(ws, nodes)).collect()}
    want = brute_components(prints)
    assert {i: got.get(i, i) for i in prints} == want


def test_simhash_odd_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(None, "a"), (4, None), (9, ""), (9, "b c d e"), (9, "b c d e")])).collect()
    found = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in got)
    assert found[0] == (0, f"{xxhash.xxh64_intdigest(b'a', 42):016x}", None)
    assert found[1] == (4, "0" * 16, 4) and found[2] == (9, "0" * 16, 4) and len(found) == 5


def brute_removed(rows):
    docs = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: x[0])
    first, out = {}, {}
    for i, b in docs:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 3000, 150])
def test_suffix_dedup_matches_brute_force(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    rows = sample(11)
    long = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    for i in range(300, 330):  # spans of all lengths around the least one
        a, n = rng.randrange(2000), rng.choice([48, 49, 50, 51, 60, 77, 300])
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + long[a : a + n] + "".join(rng.choice("xyz") for _ in range(rng.randrange(30)))))
    rows.append((299, long))
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SHARDS", 5)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removed(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("chunk", [1 << 20, 4000, 97])
def test_suffix_dedup_of_periodic_texts(spark, chunk, monkeypatch):
    """Runs whose least identifier recurs have a middle that their ends don't tell."""
    rng = random.Random(chunk)
    g = "tqsmfeingsxyzbpvmwulmqfr"
    middles = ["ab1", "ab2", "cd3", "zz9", "", "q"]
    rows = [(1, "".join(g + m for m in ("ab1", "ab2", "cd3", "ab2", "ab1"))), (2, "".join(g + m for m in ("ab1", "ab2", "zz9", "ab2", "ab1")))]
    for i in range(3, 1000):
        unit = rng.choice([g, "-", "=-", "| a ", g[: rng.randrange(1, 24)]])
        k = rng.randrange(1, 3 + 130 // len(unit))
        rows.append((i, "".join(unit + (rng.choice(middles) if rng.random() < 0.2 else "") for _ in range(k))))
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SHARDS", 5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_removed(rows) and got[2][1] == 132


def test_suffix_odd_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    t = "0123456789" * 6
    got = suffix_dedup.remove_repeats(frame(spark, [(None, t), (1, t), (1, t), (0, None)])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got) == [(-1, 0), (0, 0), (1, 60), (1, 60)]


def test_letters_that_are_cut_stay_in_the_text(spark):
    shared = "une phrase assez longue pour que les deux textes la partagent ici "
    rows = [(1, shared + "\u00e9t\u00e9"), (2, shared + "\u00e8re nouvelle"), (3, ""), (4, shared)]
    rows = [(i, t, -1, "x", 2.5) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_removed string, nth double")
    out = suffix_dedup.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == rows[0][1] and got[2].text == "\u00e8re nouvelle" and got[3].text == got[4].text == ""
    assert (got[1].n_chars, got[2].n_chars, got[3].n_chars, got[4].n_chars) == (-1, 12, -1, 0)
    assert {(r.n_removed, r.nth) for r in got.values()} == {("x", 2.5)}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}[2] == len(shared) + 1


def test_bucket_links_connect_like_brute_force():
    import numpy as np

    rng = np.random.RandomState(4)
    for small in (6, 40):
        key = np.sort(rng.randint(0, 3, small * 3))
        base = rng.randint(0, 2**62, 4)
        fp = np.array([[base[rng.randint(4)] ^ (1 << rng.randint(62)) ^ (1 << rng.randint(62))] for _ in key], np.uint64)
        a, b = simhash.bucket_links(key, {"fp": fp}, simhash.within(3), 3)
        comp = list(range(len(key)))

        def find(i, comp):
            while comp[i] != i:
                i = comp[i]
            return i

        want = list(range(len(key)))
        for i, j in zip(a.tolist(), b.tolist()):
            assert key[i] == key[j] and bin(int(fp[i, 0] ^ fp[j, 0])).count("1") <= 3
            comp[max(find(i, comp), find(j, comp))] = min(find(i, comp), find(j, comp))
        for i in range(len(key)):
            for j in range(i):
                if key[i] == key[j] and bin(int(fp[i, 0] ^ fp[j, 0])).count("1") <= 3:
                    want[max(find(i, want), find(j, want))] = min(find(i, want), find(j, want))
        assert [find(i, comp) for i in range(len(key))] == [find(i, want) for i in range(len(key))]


def jaccard(x, y):
    sets = []
    for t in (x, y):
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def families(rng, count=40):
    """Texts with one to three edits in some, whose similarities lie around 0.8."""
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(count):
        base = new(rng.choice([60, 90, 300, 900]))
        for c in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(c and max(1, len(w) // rng.choice([150, 60, 40, 30]))):
                w[rng.randrange(len(w))] = "edit"
            rows.append((1 + len(rows), " ".join(w)))
    return rows + [(900 + i, " ".join(new(200))) for i in range(60)]


@pytest.mark.parametrize("large", [4000, 3])
def test_similar_documents(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "LARGE", large)
    rows = families(random.Random(9))
    comp = {i: i for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            if i < j and comp[i] != comp[j] and jaccard(x, y) >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {k: new if c == old else c for k, c in comp.items()}
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (None, rows[0][1]), (1, rows[0][1])]
    got = {}
    for r in simhash.similar_documents(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert got[None] == [None] and len(got[1]) == 2 and got[2000] == got[2001] == [2000] and got[2002] == got[2003] == [2002]
    assert {i: got[i] for i in comp if i > 1} == {i: [c] for i, c in comp.items() if i > 1}
    assert len(set(comp.values())) < len(comp) - 20
    assert simhash.similar_documents(frame(spark, [])).count() == 0


def test_distinct_documents_keeps_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1, "a", None), (3, text + " end", 2, "b", 1.5), (5, "another text", 3, "c", None), (None, text, 4, "d", None), (None, text, 5, "e", None), (9, None, 6, "f", None), (10, "", 7, "g", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, fp string, component_id double")
    out = simhash.distinct_documents(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(r.digest for r in out.collect()) == [2, 3, 4, 5, 6]
