"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample, documents whatever their label are the unlabelled sample, and the
class prior p is the share of toxic rows among the labels that may be learnt from. A linear classifier f over binary
features (words and their first 4, 5 and 6 bytes, each as: occurs; is dense, that is occurs twice at least and once in
every 128 words) is trained in numpy on the non-negative risk

    p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]),   l(z) = log(1 + exp(-z)),

whose second part stands for the risk on true negatives and is kept from going below zero: where it does, the step goes
up that part instead. With the logistic loss, sigmoid(f) estimates P(toxic | text); the bias is set at last so that the
mean of it over the unlabelled sample is p.

Fitting takes samples bounded by `positives` and `unlabelled` documents, chosen by a hash of doc_id; the prior counts
all labels that may be learnt from, and scoring reads every whole text. Labels of rows whose crc32(doc_id as text)
mod 4 is 2 are never learnt from. Neither labels nor lang, source or doc_id enter a score.

Null text counts as empty and gets the score of the bias alone. Rows with a null doc_id are scored and have no labels.
A document with several label rows counts as toxic if one of them says so. Without positive examples every score is 0.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, texts

#: Most documents of each sample that a fit takes, and most features it keeps.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 6000
THRESHOLD = 0.3
#: Bytes of the stems; words for each of which something dense occurs at least once; and what a feature must have: so many
#: positive documents, a share of them that is so many times that of the unlabelled ones, and such a chi-square of the two.
STEMS, SPREAD, LEAST, LIFT, APART = (4, 5, 6), 128, 3, 2.0, 20
_SPLIT = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def _places(text: bytes) -> tuple[Counter, float]:
    """How often each word occurs, and the least count at which something is dense."""
    counts = Counter(text.translate(_SPLIT).split())
    return counts, max(2, counts.total() / SPREAD)


def features(text: bytes) -> set[bytes]:
    """Words, stems (4:, 5: or 6: in front), and those that are dense (+ in front)."""
    counts, dense = _places(text)
    for n in STEMS:
        stems: Counter = Counter()
        for w, k in list(counts.items()):
            if len(w) > n and w[1:2] != b":":
                stems[b"%d:" % n + w[:n]] += k
        counts.update(stems)
    return counts.keys() | {b"+" + x for x, k in counts.items() if k >= dense}


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


class Model:
    """weights: feature -> weight."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.plain: dict[int, dict[bytes, tuple[float, float]]] = {n: {} for n in (0, *STEMS)}  # weights of once and dense
        for x in {x.removeprefix(b"+") for x in weights}:
            n = int(x[:1]) if x[1:2] == b":" else 0
            self.plain[n][x[2:] if n else x] = weights.get(x, 0.0), weights.get(b"+" + x, 0.0)

    def score(self, text: bytes) -> float:
        counts, dense = _places(text)
        z = self.bias
        for n, known in self.plain.items():
            if n:
                own: Counter = Counter()
                for w in counts:
                    if w[:n] in known and len(w) > n:
                        own[w[:n]] += counts[w]
            else:
                own = Counter({w: counts[w] for w in counts.keys() & known.keys()})
            for x in sorted(own):
                once, often = known[x]
                z += once + often * (own[x] >= dense)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def choose(counts: list[tuple[bytes, int, int]], n_p: int, n_u: int) -> list[bytes]:
    """The features that set the samples apart, best first, from (feature, positive documents, unlabelled documents)."""

    def apart(a: int, b: int) -> float:  # chi-square of the two shares
        both = (a + b) / (n_p + n_u)
        return (a / n_p - b / n_u) ** 2 / (both * (1 - both) + 1e-9) * n_p * n_u / (n_p + n_u)

    found = [(apart(a, b), x) for x, a, b in counts if a >= LEAST and a / n_p > LIFT * b / n_u]
    return [x for d, x in sorted(found, key=lambda f: (-f[0], f[1])) if d > APART][:FEATURES]


def descend(positive: list[list[int]], unlabelled: list[list[int]], chosen: list[bytes], prior: float, rounds: int = 300) -> Model:
    """Descends the non-negative risk (Adam, whole samples) over documents given by the places of their chosen features."""
    n_p, n_u, k = len(positive), len(unlabelled), len(chosen)
    if not n_p or not n_u:
        return Model({}, -60.0)

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    (rp, cp), (ru, cu) = flat(positive), flat(unlabelled)
    w = np.zeros(k + 1)
    w[k] = math.log(prior / (1 - prior)) if 0 < prior < 1 else -3.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def back(g, r, c, n):  # mean over n documents
        out = np.empty(k + 1)
        out[:k] = np.bincount(c, g[r], k) / n
        out[k] = g.mean()
        return out

    for t in range(1, rounds + 1):
        zp = np.bincount(rp, w[cp], n_p) + w[k]
        zu = np.bincount(ru, w[cu], n_u) + w[k]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = back(sigmoid(zu), ru, cu, n_u) - prior * back(sigmoid(zp), rp, cp, n_p)
        if negative >= 0:
            g = prior * back(sigmoid(zp) - 1, rp, cp, n_p) + g_negative
        else:
            g = -g_negative
        g[:k] += 1e-4 * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({x: float(w[i]) for i, x in enumerate(chosen)}, anchored(np.bincount(ru, w[cu], n_u), prior))


def anchored(z: np.ndarray, prior: float) -> float:
    """The bias at which the mean score of the unlabelled sample is the class prior, as where the risk is least; small
    samples, in which the non-negative part is held, leave it elsewhere."""
    low, high = -60.0, 60.0
    for _ in range(100):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(z + middle, -60, 60)))).mean() < prior:
            low = middle
        else:
            high = middle
    return low


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], prior: float) -> Model:
    """A model from samples in memory."""
    if not positive or not unlabelled:
        return Model({}, -60.0)
    in_p, in_u = Counter(x for s in positive for x in s), Counter(x for s in unlabelled for x in s)
    chosen = choose([(x, n, in_u[x]) for x, n in in_p.items()], len(positive), len(unlabelled))
    at = {x: i for i, x in enumerate(chosen)}
    rows = [[sorted(at[x] for x in s if x in at) for s in sample] for sample in (positive, unlabelled)]
    return descend(rows[0], rows[1], chosen, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Features are counted on the executors; the driver gets the counts of those that could be chosen, and the sampled
    documents as lists of places among the chosen ones.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    may = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    own = labels.where(may & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = own.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -60.0)
    n_docs = docs.where(may).count()
    parts = 1 << 20

    def share(most: int, of: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < min(parts, math.ceil(parts * most / max(1, of)))

    def digests(batches):
        for b in batches:
            found = [b"\n".join(sorted(features(t))) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(found, pa.binary()), pa.array([hashlib.sha256(x).digest() for x in found], pa.binary())], ["kind", "found", "digest"])

    toxic = own.where((F.col("toxic") > 0) & share(int(positives * 0.9), n_toxic)).select("doc_id")
    taken = [docs.where(may).join(toxic, "doc_id", "left_semi"), docs.where(may & share(int(unlabelled * 0.9), n_docs))]
    taken = [d.select("doc_id", "text", F.lit(i).alias("kind")) for i, d in enumerate(taken)]
    # Copies count once.
    sample = taken[0].union(taken[1]).mapInArrow(digests, "kind int, found binary, digest binary").dropDuplicates(["kind", "digest"])
    sample = ws.table(sample, "sample")
    sizes = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(0, 0), sizes.get(1, 0)
    if not n_p or not n_u:
        return Model({}, -60.0)

    def counted(batches):
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for kind, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in found.split(b"\n") if found else ():
                    seen.setdefault(x, [0, 0])[kind] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["x", "p", "u"])

    counts = sample.select("kind", "found").mapInArrow(counted, "x binary, p long, u long").groupBy("x").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.pow(F.col("p") / n_p - F.col("u") / n_u, 2) / (both * (1 - both) + 1e-9) * (n_p * n_u / (n_p + n_u))
    could = counts.where((F.col("p") >= LEAST) & (F.col("p") / n_p > F.lit(LIFT) * F.col("u") / n_u)).withColumn("apart", apart)
    could = could.where(F.col("apart") > APART - 1).orderBy(F.desc("apart"), "x").limit(FEATURES)  # of a bounded sample; choose() decides
    chosen = choose([(bytes(r.x), r.p, r.u) for r in could.collect()], n_p, n_u)
    at = {x: i for i, x in enumerate(chosen)}

    def places(batches):
        for b in batches:
            rows = [[at[x] for x in found.split(b"\n") if x in at] if found else [] for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.int32()))], ["kind", "digest", "places"])

    listed = sample.mapInArrow(places, "kind int, digest binary, places array<int>").orderBy("kind", "digest").collect()
    return descend([sorted(r.places) for r in listed if r.kind == 0], [sorted(r.places) for r in listed if r.kind == 1], chosen, n_toxic / n)


def scored(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted); with keep the rows that are not rejected, all columns as they are."""
    if keep:
        at = docs.columns.index("text")

        def run(batches):
            for b in batches:
                good = [model.score(t) < THRESHOLD for t in texts(b)]
                yield b.filter(pa.array(good, pa.bool_()))

        assert at >= 0
        return docs.mapInArrow(run, docs.schema)

    def run(batches):
        for b in batches:
            s = [model.score(t) for t in texts(b)]
            out = [pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scored(docs, train(docs, labels))
