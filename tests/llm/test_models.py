"""Toxicity and LM scores: held-out accuracy and brute force."""

import math
import random
import tracemalloc

import numpy as np

from veracite.llm import pseudo_lm, queries, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, score string, predicted int")


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, MIDDLE).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == toxicity.held_out(i) for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    hit = sum(p and t for p, t in held)
    precision, recall = hit / max(1, sum(p for p, _ in held)), hit / max(1, sum(t for _, t in held))
    assert len(held) > 800 and precision > 0.85 and recall > 0.85, (precision, recall)


def test_labels_of_held_out_rows_do_not_matter(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = labels.collect()
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.toxic if toxicity.held_out(r.doc_id) else r.toxic) for r in rows], "doc_id long, toxic int")
    one = toxicity.train(d, labels)
    two = toxicity.train(d, flipped)
    assert one.weights == two.weights and one.bias == two.bias


def test_risk_stays_non_negative_and_finds_hidden_positives():
    rng = random.Random(5)
    clean = [{b"w%d" % rng.randrange(300) for _ in range(40)} for _ in range(3000)]
    bad = lambda: {b"w%d" % rng.randrange(300) for _ in range(40)} | {b"bad%d" % rng.randrange(3)}
    unlabelled = clean[:1800] + [bad() for _ in range(200)]
    model = toxicity.fit([bad() for _ in range(400)], unlabelled, 0.1)
    z = lambda s: 1 / (1 + math.exp(-model.bias - sum(model.weights.get(x, 0) for x in s)))
    assert sum(z(bad()) >= 0.3 for _ in range(200)) > 190
    assert sum(z(s) >= 0.3 for s in clean[2000:]) < 20


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (5, 0), (6, 1)], "doc_id long, toxic int")
    rows = [(1, "bad bad"), (None, "x"), (3, None), (4, ""), (5, "good " * 5000), (6, "bad"), (6, "bad")]
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    none = labels.where("toxic = 9")
    assert {r.predicted for r in toxicity.toxicity(docs(spark, rows), none).collect()} == {0}
    assert toxicity.scored(docs(spark, rows), toxicity.Model({b"bad": 9.0}, -3.0), keep=True).count() == 4


def brute_log_probability(model, line, at):
    """Of one place, by a softmax over all ids in double precision."""
    m = {k: x.astype(float) for k, x in model.items()}
    h = np.tanh(m["b"] + sum(m["e"][line[at + s]] * m["d"][i] for i, s in enumerate(pseudo_lm.SIDES)))
    classes, size = m["wb"].shape
    z = h @ m["c"] + m["cb"]
    z = z - math.log(np.exp(z).sum())
    every = []
    for g in range(classes):
        own = h @ m["w"][g] + m["wb"][g]
        every += list(z[g] + own - math.log(np.exp(own).sum()))
    assert abs(sum(map(math.exp, every)) - 1) < 1e-9
    return every[line[at]]


def test_scores_match_brute_force(spark, monkeypatch):
    """Every score from all ids' probabilities, across cuts of long documents, and rare words by their spelling."""
    monkeypatch.setattr(pseudo_lm, "STEP", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["der", "die", "Das", "und", "x%d" % rng.randrange(90)]) for _ in range(rng.choice([1, 3, 40, 300])))) for i in range(40)]
    words, model = pseudo_lm.train(docs(spark, rows), pseudo_lm.Workspace(spark, "test"))
    got = {r.doc_id: r for r in pseudo_lm.score(docs(spark, rows), words, model).collect()}
    for i, t in rows:
        w = t.lower().encode().split()
        line = [words.size] * 2 + [words.ids.get(x, x[0]) for x in w] + [words.size] * 2
        want = sum(brute_log_probability(model, line, at) for at in range(2, len(line) - 2))
        for x in w:
            if x not in words.ids:
                want += sum(words.chain[a][b] for a, b in zip(x, [*x[1:], 256]))
        assert got[i].n_tokens == len(w) and abs(got[i].log_likelihood - want) < 1e-3 * (1 + abs(want)), i
    assert np.allclose(np.exp(words.chain).sum(1), 1)


def test_step_follows_the_gradient():
    rng = np.random.RandomState(1)
    size = pseudo_lm.whole(30)
    model = pseudo_lm.start(np.ones(size))
    line = np.concatenate([[size] * 2, rng.randint(0, size, 12), [size] * 2])
    at = np.arange(2, 14)
    loss = lambda m: -sum(brute_log_probability(m, line, i) for i in at)
    after = {k: x.astype(np.float64).copy() for k, x in model.items()}
    past = {k: np.zeros_like(x) for k, x in after.items()}
    pseudo_lm.step(after, past, line, at, 1e-6)
    for k in model:  # the step is against the gradient, divided by sqrt(square + 1)
        for place in [tuple(rng.randint(0, n) for n in model[k].shape) for _ in range(6)]:
            up, down = ({n: x.astype(np.float64).copy() for n, x in model.items()} for _ in range(2))
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            g = (loss(up) - loss(down)) / 2e-5
            assert abs((model[k][place] - after[k][place]) / 1e-6 - g / math.sqrt(g * g + 1)) < 2e-2, k


def plain_step(model, past, line, at, rate=0.1):
    """A step by whole matrices of probabilities, place by place of the formulas."""
    classes, size = model["wb"].shape
    y, e = line[at], model["e"][line]
    h = np.tanh(model["b"] + sum(e[at + s] * model["d"][i] for i, s in enumerate(pseudo_lm.SIDES)))
    group, place, g = y // size, y % size, {k: np.zeros_like(x) for k, x in model.items()}

    def softmax(h, c, b, own):
        p = np.exp(h @ c + b)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(h)), own] -= 1
        return h.T @ p, p.sum(0), p @ c.T

    g["c"], g["cb"], dh = softmax(h, model["c"], model["cb"], group)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(classes + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]):
        o = order[ends[k] : ends[k + 1]]
        g["w"][k], g["wb"][k], more = softmax(h[o], model["w"][k], model["wb"][k], place[o])
        dh[o] += more
    dh *= 1 - h * h
    g["b"] = dh.sum(0)
    around = np.zeros_like(e)
    for i, s in enumerate(pseudo_lm.SIDES):
        g["d"][i] = (e[at + s] * dh).sum(0)
        around[at + s] += dh * model["d"][i]
    order = np.argsort(line, kind="stable")
    first = np.flatnonzero(np.diff(line[order], prepend=-1))
    g["e"][line[order][first]] = np.add.reduceat(around[order], first, 0)
    for k in model:
        past[k] += g[k] * g[k]
        model[k] -= rate * g[k] / np.sqrt(past[k] + 1)


def test_steps_equal_plain_ones_and_hold_few_probabilities(monkeypatch):
    """In blocks that don't divide the places, with padding and classes that don't occur; memory stays below a whole matrix
    of probabilities."""
    rng = np.random.RandomState(2)
    size = pseudo_lm.whole(150)
    line = rng.randint(0, size // 2, 400)
    line[rng.randint(0, 400, 60)] = size
    line[[0, 1, -2, -1]] = size, 3, 5, size
    at = 2 + np.flatnonzero(line[2:-2] != size)
    monkeypatch.setattr(pseudo_lm, "BLOCK", 7)
    one, two = (pseudo_lm.start(np.arange(size)) for _ in range(2))
    one_past, two_past = ({k: np.zeros_like(x) for k, x in m.items()} for m in (one, two))
    for _ in range(5):
        pseudo_lm.step(one, one_past, line, at)
        plain_step(two, two_past, line, at)
        assert all(np.allclose(one[k], two[k], atol=1e-4) for k in one)
    got = pseudo_lm.log_probabilities(one, line, at)
    assert np.allclose(got, [brute_log_probability(one, line, i) for i in at], atol=1e-4)

    monkeypatch.undo()
    size = pseudo_lm.whole(300 * 300)
    model, line = pseudo_lm.start(np.ones(size)), rng.randint(0, size, 65_540)
    tracemalloc.start()
    pseudo_lm.log_probabilities(model, line, np.arange(2, len(line) - 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 65_536 * 300 * 4, most


def test_model_beats_counts_and_knows_word_order(spark):
    """At any number of partitions the same model; 0.4 nats a word above the counts of ids, and order counts."""
    d = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id % 3 = 0")
    ws = pseudo_lm.Workspace(spark, "test")
    words, model = pseudo_lm.train(d, ws)
    again = pseudo_lm.train(d.repartition(7, "lang", "n_chars"), pseudo_lm.Workspace(spark, "test"))[1]
    assert all((model[k] == again[k]).all() for k in model)
    _, counts, _ = pseudo_lm.vocabulary(d, ws)
    log = np.log((counts + 0.5) / (counts + 0.5).sum())
    rng, n, own, mixed, unigram = random.Random(3), 0, 0.0, 0.0, 0.0
    for r in d.where("n_chars > 2000").limit(150).collect():
        w = r.text.split()
        for kind, text in (("own", r.text), ("mixed", " ".join(rng.sample(w, len(w))))):
            for line, _, _ in pseudo_lm.lines(words, [text.encode()], 10_000):
                for part, at, _ in pseudo_lm.windows(line, words.size, 10_000):
                    total = float(pseudo_lm.log_probabilities(model, part, at).sum())
                    if kind == "own":
                        own, n, unigram = own + total, n + len(at), unigram + float(log[part[at]].sum())
                    else:
                        mixed += total
    assert own / n > unigram / n + 0.4 and own / n > mixed / n + 0.05, (own / n, mixed / n, unigram / n)


def test_vocabulary_follows_the_corpus_and_no_words_share_a_probability(spark):
    ws = pseudo_lm.Workspace(spark, "test")
    sizes = [len(pseudo_lm.vocabulary(spark.read.parquet(f"{d}/documents.parquet"), ws)[0].ids) for d in (SMALL, MIDDLE)]
    assert sizes[1] > 1.5 * sizes[0] > 1000, sizes
    rows = [(i, " ".join(["the"] * 20 + [w])) for i, w in enumerate(["xqzvk", "thenthe", "zzkqx", "abthe"])]
    got = pseudo_lm.pseudo_likelihood(docs(spark, rows * 8)).collect()
    assert len({r.log_likelihood for r in got}) == 4


def test_probabilities_of_any_number_of_ids_add_to_one():
    for n in (1, 2, 3, 600, 931):
        size = pseudo_lm.whole(n)
        model = pseudo_lm.start(np.arange(size))
        line = np.full(5, size)
        assert size >= n and pseudo_lm.unpack(pseudo_lm.pack(model), size)["w"].shape == model["w"].shape
        total = 0.0
        for i in range(size):
            line[2] = i
            total += math.exp(pseudo_lm.log_probabilities(model, line, np.array([2]))[0])
        assert abs(total - 1) < 1e-3


def test_lm_odd_rows(spark):
    got = pseudo_lm.pseudo_likelihood(docs(spark, [(1, None), (None, "a b c"), (3, ""), (3, "a b"), (3, "a b")])).collect()
    assert len(got) == 5 and all(math.isfinite(r.log_likelihood) for r in got)
    assert [r.log_likelihood for r in got if not r.n_tokens] == [0.0, 0.0]
    assert pseudo_lm.pseudo_likelihood(docs(spark, [])).count() == 0
    assert pseudo_lm.pseudo_likelihood(docs(spark, [(1, None)])).first().per_token == 0
