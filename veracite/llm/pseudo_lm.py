"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every word from the words on both sides, never from itself; the log
probabilities of a document's words, each given its two left and two right neighbours, are summed to its score.

    words     lower-cased for A-Z, split at ASCII white space. Each word counted sqrt(all words) / RARE times or more over
              all documents has an id of its own, so the vocabulary grows with the corpus, about as the root of it. The
              network knows any other word by its first byte; the rest of its bytes then have the probabilities of a chain
              of bytes, counted over all such words of the corpus, that ends the word. So each word has a probability of
              its own, nothing is hashed, and the probabilities of all words add to 1 (less what the chain gives to
              spellings of words that have ids). Places beyond a document's ends have the padding id.
    network   an embedding for each neighbour's id, weighed for its place, summed; tanh; softmax over classes of ids, then
              over the ids of the class, so that a word costs two short softmaxes and the probabilities of all ids add to
              1. Classes are as many as the root of the ids. The biases start from the counts of all ids.
    training  in numpy, by steps over STEP words, each parameter's rate falling with its own gradients so far. Every
              document is trained on: documents are dealt to shards of about SHARD words by a hash of doc_id and text, in
              that order, whatever the partitions of the input; a task trains a copy on a shard, and the copies are
              averaged, weighed by words, in a tree of fan-in FAN, so no task and not the driver holds more than
              FAN copies. Word counts and copies are gathered from the whole corpus and grow with it. With more rounds,
              each starts from the average of the one before.

Null text counts as empty; a document without words has score 0, per_token 0. Rows with null or repeated doc_ids are
scored each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import ctypes
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, texts

#: Width of the network; words in a step; what divides the root of all words to the least count of a word with its own id;
#: words of a shard; copies averaged at once; places whose probabilities are held at once, which fit a core's cache.
WIDTH, STEP, RARE, SHARD, FAN, BLOCK = 16, 16384, 16, 4_000_000, 4, 512
SIDES = (-2, -1, 1, 2)
Model = dict[str, np.ndarray]


def class_size(ids: int) -> int:
    """Of a model of so many ids, which fill whole classes."""
    size = math.isqrt(ids)
    return size if ids % size == 0 else size + 1


def whole(ids: int) -> int:
    """The ids that fill whole classes: the least square or product of neighbours that holds so many."""
    size = math.isqrt(max(ids, 1) - 1) + 1
    return size * (size - 1) if size > 1 and size * (size - 1) >= ids else size * size


def shapes(ids: int) -> dict[str, tuple[int, ...]]:
    """Of the arrays of a model of so many ids; the last embedding is the padding's."""
    size = class_size(ids)
    return {"e": (ids + 1, WIDTH), "d": (len(SIDES), WIDTH), "b": (WIDTH,), "c": (WIDTH, ids // size), "cb": (ids // size,), "w": (ids // size, WIDTH, size), "wb": (ids // size, size)}


def start(counts: np.ndarray, seed: int = 11) -> Model:
    """A model before training, from the counts of all ids."""
    rng = np.random.RandomState(seed)
    model = {k: (rng.standard_normal(s) * 0.1 * (k in ("e", "c", "w"))).astype(np.float32) for k, s in shapes(len(counts)).items()}
    model["d"] += np.array([1 / abs(s) ** 0.5 for s in SIDES], np.float32)[:, None]
    n = (counts + 0.5).reshape(model["wb"].shape)
    model["cb"] = np.log(n.sum(1) / n.sum()).astype(np.float32)
    model["wb"] = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
    return model


def pack(model: Model) -> bytes:
    return b"".join(x.astype("<f4").tobytes() for x in model.values())


def unpack(data: bytes, ids: int) -> Model:
    out, at = {}, 0
    for k, s in shapes(ids).items():
        n = int(np.prod(s))
        out[k] = np.frombuffer(data, "<f4", n, at).reshape(s).copy()
        at += 4 * n
    return out


def _hidden(model: Model, e: np.ndarray) -> np.ndarray:
    """Of each place of a line but two at both ends, from the embeddings of its ids."""
    n = len(e) - 4
    h = model["b"] + e[:n] * model["d"][0]
    for i, s in enumerate(SIDES[1:], 1):
        h += e[2 + s : 2 + s + n] * model["d"][i]
    return np.tanh(h, out=h)


def _outputs(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of classes, and of the ids of each class, for powers of 2, which are quicker than those of e. The biases are one more
    row, for states that end with a 1."""
    c, w = np.concatenate([model["c"], model["cb"][None]]), np.concatenate([model["w"], model["wb"][:, None]], 1)
    c *= math.log2(math.e)
    w *= math.log2(math.e)
    return c, w


def _by_id(h: np.ndarray, y: np.ndarray, at: np.ndarray, classes: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of places by the ids there; in it the ids and the states, which end with a 1; and (class, start, end) of
    the classes that occur."""
    order = np.argsort(y.astype(np.uint16 if classes * size < 1 << 16 else np.int64), kind="stable")
    y, states = y.take(order), np.ones((len(y), WIDTH + 1), h.dtype)
    states[:, :WIDTH] = h.take((at - 2).take(order), 0)
    ends = np.searchsorted(y, np.arange(classes + 1) * size).tolist()
    return order, y, states, [(g, ends[g], ends[g + 1]) for g in range(classes) if ends[g] < ends[g + 1]]


def _powers(states: np.ndarray, outputs: np.ndarray, room: np.ndarray):
    """(start, end, powers of 2 of the outputs) for some of these states at a time, which fit a core's cache."""
    n, width = len(states), outputs.shape[1]
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        z = np.matmul(states[a:b], outputs, out=room[: (b - a) * width].reshape(b - a, width))
        yield a, b, np.exp2(z, out=z)


def log_probabilities(model: Model, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the ids at these places of a line, given the ids around them."""
    classes, size = model["wb"].shape
    h = _hidden(model, model["e"].take(line, 0))
    order, y, states, present = _by_id(h, line.take(at), at, classes, size)
    c, w = _outputs(model)
    own = (w.transpose(0, 2, 1) + c.T[:, None]).reshape(classes * size, WIDTH + 1)
    ranked = np.einsum("ij,ij->i", states, own.take(y, 0))
    sums, most = np.empty((2, len(y)), h.dtype), max(classes, size)
    ones, room = np.ones(most, h.dtype), np.empty(BLOCK * most, h.dtype)
    for a, b, p in _powers(states, c, room):
        np.matmul(p, ones[:classes], out=sums[0, a:b])
    for g, begin, end in present:
        for a, b, p in _powers(states[begin:end], w[g], room):
            np.matmul(p, ones[:size], out=sums[1, begin + a : begin + b])
    ranked -= np.log2(sums).sum(0)
    out = np.empty_like(ranked)
    out[order] = ranked * math.log(2)
    return out


def _descend(model: Model, past: Model, name: str, gradient: np.ndarray, rate: float, part=slice(None)) -> None:
    """A step of some parameters by rates that fall with the squares of their gradients so far."""
    x = gradient * gradient
    if isinstance(part, slice):
        past[name] += x
        np.add(past[name], 1, out=x)
    else:
        x += past[name].take(part, 0)
        past[name][part] = x
        x += 1
    np.sqrt(x, out=x)
    np.divide(gradient, x, out=x)
    x *= rate
    model[name][part] -= x


def _pull(states: np.ndarray, outputs: np.ndarray, back: np.ndarray, pull: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The gradient for the outputs of the logarithms of the sums over these states' outputs; adds that for the states to
    `pull`. back: the outputs without biases, and ones, whose product is the sum."""
    total = 0
    for a, b, p in _powers(states, outputs, room):
        r = p @ back
        inverse = 1 / r[:, WIDTH:]
        r *= inverse
        pull[a:b] += r
        total += (states[a:b] * inverse).T @ p
    return total


def step(model: Model, past: Model, line: np.ndarray, at: np.ndarray, rate: float = 0.1) -> None:
    """One step down the negative log probability of the ids at these places of a line; past: squares of gradients so far."""
    classes, size = model["wb"].shape
    ids, n = classes * size, len(line) - 4
    e = model["e"].take(line, 0)
    h = _hidden(model, e)
    order, y, states, present = _by_id(h, line.take(at), at, classes, size)
    c, w = _outputs(model)
    # The gradients of the sums, less what belongs to the ids that are there, which needs no products.
    back = np.ones((classes, size, WIDTH + 1), h.dtype)
    back[:, :, :WIDTH] = model["w"].transpose(0, 2, 1)
    back_c = np.ones((classes, WIDTH + 1), h.dtype)
    back_c[:, :WIDTH] = model["c"].T
    pull = np.zeros((len(y) + 1, WIDTH + 1), h.dtype)
    np.negative((back + back_c[:, None]).reshape(ids, WIDTH + 1).take(y, 0), out=pull[:-1])
    room = np.empty(BLOCK * max(classes, size), h.dtype)
    gc, gw = _pull(states, c, back_c, pull, room), np.zeros_like(w)
    for g, a, b in present:
        gw[g] = _pull(states[a:b], w[g], back[g], pull[a:b], room)
    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    ranked = y[first]
    own = np.add.reduceat(states, first, 0)
    gw[ranked // size, :, ranked % size] -= own
    gc[:, [g for g, _, _ in present]] -= np.add.reduceat(own, np.searchsorted(first, [a for _, a, _ in present]), 0).T
    _descend(model, past, "c", gc[:WIDTH], rate)
    _descend(model, past, "cb", gc[WIDTH], rate)
    _descend(model, past, "w", gw[:, :WIDTH], rate)
    _descend(model, past, "wb", gw[:, WIDTH], rate)
    # Back to the line's order; places that aren't predicted take the row of zeros at the end.
    back_at = np.full(n, -1)
    back_at[(at - 2).take(order)] = np.arange(len(y))
    pull[-1] = 0
    dh = np.ascontiguousarray(pull[:, :WIDTH]).take(back_at, 0)
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    _descend(model, past, "b", dh.sum(0), rate)
    # What each place of the line does to the places around it, gathered by id.
    ge, gd = np.zeros((len(line), WIDTH), dh.dtype), []
    for i, s in enumerate(SIDES):
        gd.append(np.einsum("ij,ij->j", e[2 + s : 2 + s + n], dh))
        ge[2 + s : 2 + s + n] += np.multiply(dh, model["d"][i], out=h)
    _descend(model, past, "d", np.stack(gd), rate)
    order = np.argsort(line.astype(np.uint16 if ids < 65_535 else np.int64), kind="stable")
    ranked = line.take(order)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    _descend(model, past, "e", np.add.reduceat(ge.take(order, 0), first, 0), rate, ranked[first])


def keep_memory() -> None:
    """Lets glibc keep up to 64 MB of freed memory for the next step: what goes back to the system is mapped and cleared anew."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


class Words:
    """Texts to ids: 256 first bytes of rare words, then the words with an id of their own. chain: log probabilities of
    a rare word's next byte (256: its end), given the one before."""

    def __init__(self, frequent: list[bytes], chain: np.ndarray):
        self.ids = {w: 256 + i for i, w in enumerate(frequent)}
        self.chain = chain
        #: All ids, with unused ones that fill the last class; also the padding's.
        self.size = whole(256 + len(self.ids))
        # The chain over words with a space after each: no word holds one, so it stands for the end.
        self.spaced = chain[:, :256].astype(np.float32)
        self.spaced[:, 32] = chain[:, 256]
        self.spaced[32] = 0

    def __call__(self, text: bytes) -> tuple[np.ndarray, float]:
        """A text's ids, and the log probability of its rare words' spellings."""
        words = text.lower().split()
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(ids < 0)
        if not len(rare):
            return ids, 0.0
        data = np.frombuffer(b" ".join([words[i] for i in rare.tolist()]) + b" ", np.uint8)
        ends = np.flatnonzero(data == 32)
        ids[rare] = data[np.concatenate([[0], ends[:-1] + 1])]
        return ids, float(self.spaced[data[:-1], data[1:]].sum(dtype=np.float64))


def lines(words: Words, documents, most: int):
    """(line, document of each place, spellings): whole documents with two padding ids around each, about `most` words at a
    time. spellings: (document, log probability of its rare words' spellings)."""
    pad, none = np.full(2, words.size, np.int64), np.full(2, -1)
    held, owner, spelled, size = [pad], [none], [], 0
    for i, text in enumerate(documents):
        ids, s = words(text)
        if len(ids):
            held += [ids, pad]
            owner += [np.full(len(ids), i), none]
            spelled.append((i, s))
            size += len(ids)
        if size >= most:
            yield np.concatenate(held), np.concatenate(owner), spelled
            held, owner, spelled, size = [pad], [none], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(owner), spelled


def windows(line: np.ndarray, padding: int, most: int):
    """(part of a line, its places to predict, their places in the line): each place once, with two places on both sides."""
    for a in range(2, len(line) - 2, most):
        part = line[a - 2 : min(a + most, len(line) - 2) + 2]
        at = 2 + np.flatnonzero(part[2:-2] != padding)
        if len(at):
            yield part, at, at + a - 2


def vocabulary(docs: DataFrame, ws: Workspace) -> tuple[Words, np.ndarray, int]:
    """The ids of words, by the words of all documents; how often each id occurs; and how many words there are."""

    def count(batches):
        for b in batches:
            c = Counter()
            for t in texts(b):
                c.update(t.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    counted = ws.table(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.isqrt(total) // RARE)
    found = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()  # RARE * sqrt(total) of them at most

    def bigrams(batches):  # of rare words: each byte and the next, or the end
        own = np.zeros(256 * 257, np.int64)
        first = np.zeros(256, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(w, np.uint8).astype(np.int64)
                np.add.at(own, x * 257 + np.append(x[1:], 256), n)
                first[x[0]] += n
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["at", "n"])
        at = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(first[at])], ["at", "n"])

    chain, heads = np.ones(256 * 257), np.zeros(256, np.int64)
    rare = counted.where(F.col("n") < least).mapInArrow(bigrams, "at long, n long")
    for r in rare.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 256 * 258 of them at most
        if r["at"] < 0:
            heads[-1 - r["at"]] = r.n
        else:
            chain[r["at"]] += r.n
    chain = chain.reshape(256, 257)
    words = Words([bytes(r.word) for r in found], np.log(chain / chain.sum(1, keepdims=True)))
    counts = np.zeros(words.size, np.int64)
    counts[:256] = heads
    counts[256 : 256 + len(found)] = [r.n for r in found]
    return words, counts, total


def train(docs: DataFrame, ws: Workspace, rounds: int = 1) -> tuple[Words, Model]:
    """The ids of words and a model trained on every document, `rounds` times."""
    words, counts, total = vocabulary(docs, ws)
    model = start(counts)
    shards = max(1, round(total / SHARD))
    dealt = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.octet_length("text") > 0)
    dealt = dealt.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "text")
    if rounds > 1:
        dealt = ws.table(dealt, "dealt")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
    for k in range(rounds):

        def run(batches, packed=pack(model)):
            own = past = shard = None
            seen = 0
            keep_memory()

            def out():
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([pack(own)], pa.binary())], ["part", "n", "model"])

            for b in batches:
                shards_, all_texts = b.column(0).to_numpy(), texts(b)
                cuts = [0, *(np.flatnonzero(shards_[1:] != shards_[:-1]) + 1).tolist(), len(shards_)]
                for a, e in zip(cuts[:-1], cuts[1:]):
                    if a == e:
                        continue
                    if shard != int(shards_[a]):
                        if seen:
                            yield out()
                        shard, seen, own = int(shards_[a]), 0, unpack(packed, words.size)
                        past = {name: np.zeros_like(x) for name, x in own.items()}
                    for line, _, _ in lines(words, all_texts[a:e], STEP):
                        for part, at, _ in windows(line, words.size, STEP):
                            step(own, past, part, at)
                            seen += len(at)
            if seen:
                yield out()

        def mean(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), range(table.num_rows)))
            words_ = sum(n for _, n, _ in rows)
            out = sum(np.frombuffer(table["model"][i].as_buffer(), "<f4") * np.float64(n / words_) for _, n, i in rows)
            return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "n": pa.array([words_], pa.int64()), "model": pa.array([out.astype("<f4").tobytes()], pa.binary())})

        kind, level = "part long, n long, model binary", 0
        copies = ws.table(dealt.mapInArrow(run, kind), f"copies{k}")
        while (most := copies.agg(F.max("part")).first()[0]) is not None and (most > 0 or level == 0):
            level += 1
            copies = ws.table(copies.groupBy(F.expr(f"part div {FAN}")).applyInArrow(mean, kind), f"copies{k}-{level}")
        if most is None:  # no words
            break
        model = unpack(bytes(copies.first().model), words.size)
    return words, model


def score(docs: DataFrame, words: Words, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token)."""

    def run(batches):
        keep_memory()
        for b in batches:
            documents = texts(b)
            total, count = np.zeros(len(documents)), np.zeros(len(documents), np.int64)
            for line, owner, spelled in lines(words, documents, STEP):
                for part, at, places in windows(line, words.size, STEP):
                    p = log_probabilities(model, part, at).astype(np.float64)
                    total += np.bincount(owner[places], p, len(documents))
                    count += np.bincount(owner[places], minlength=len(documents))
                for i, s in spelled:
                    total[i] += s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(total), pa.array(total / np.maximum(count, 1))], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, per_token double")


def pseudo_likelihood(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood, per_token."""
    words, model = train(docs, Workspace(docs.sparkSession, "pseudo-lm"), rounds)
    return score(docs, words, model)
