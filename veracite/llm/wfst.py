"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a .model file, composed with each input while it is read, and the encoding is the
shortest path of the result in the tropical semiring: weights add along a path (ONE = 0), the least path wins (ZERO = inf).

    Normaliser      one state for each place in a rule's source, whose arcs read characters; a rule's last arc writes its
                    target, the longest rule wins. Spaces become U+2581; where the model says so, one is put in front and
                    runs are cut to one.
    Pieces          reads the characters of a piece, writes its id. Of a unigram model: one state, an arc's weight is the
                    negative score. Of a byte-pair model: the state is the piece read last, and the arc from a to b
                    weighs ONE if merging the characters of a b ends in just a and b, else ZERO.
    ByteFallback    reads a character that no piece consists of and writes its bytes' pieces, or the unknown id, at a
                    weight beyond that of any piece (unigram) or weighed like a piece (byte pairs).

Byte-pair encoding merges the best-scored neighbours first, and the pieces of a text are final exactly if each two
neighbours are final by themselves: as long as no merge has crossed a border, the merges beside it run in the same
order as in the two pieces alone. So one path has finite weight, and it is the encoding. Arcs are made when the
composition first asks for them, and their weights are kept, a bounded number. Since a prefix of an input has one finite
path too, at most one state for each position is reached, and arcs into a position are tried until one is finite.

Where two characters stand beside each other in no piece, no arc crosses, so byte-pair inputs are cut there and composed
part by part; words and parts are kept with their outputs, a bounded number in two generations. Unigram inputs are
composed whole, as sums of single-precision weights depend on what stands before. Decoding follows the transducers
backwards: ids to characters, runs of byte pieces to characters (U+FFFD for each byte that is part of none), U+2581 to a
space; the first piece loses the one in front.

Null text counts as empty and has no ids. Ties between unigram paths go to the longer last piece. Models with
user-defined pieces, and ones that put spaces at the end of words, raise an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: bytes of length-delimited fields, else integers."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, int.from_bytes(data[i : i + n], "little")
            i += n


ONE, ZERO = 0.0, float("inf")


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double-array trie of sources, then their targets, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    targets = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules, open_ = {}, [(offset(units[0]), b"")]
    while open_:
        at, key = open_.pop()
        for c in range(1, 256):
            unit = units[at ^ c] if at ^ c < len(units) else 0
            if unit & 0x800000FF == c:
                below, name = at ^ c ^ offset(unit), key + bytes([c])
                if unit >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    rules[name.decode()] = targets[start : targets.index(b"\0", start)].decode()
                open_.append((below, name))
    return rules


class Normaliser:
    """Rules, and what becomes of spaces."""

    def __init__(self, rules: dict[str, str], dummy: bool, trim: bool, escape: bool):
        self.dummy, self.trim, self.escape = dummy, trim, escape
        self.arcs: list[dict[str, int]] = [{}]  # of each state: character -> next state
        self.writes: dict[int, str] = {}  # of states where a source ends
        for source, target in rules.items():
            state = 0
            for c in source:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                state = self.arcs[state][c]
            self.writes[state] = target
        first = "".join(map(re.escape, self.arcs[0]))
        self.any = re.compile(f"[{first}]").search if first else lambda text: None

    def rewritten(self, text: str) -> str:
        """The composition of the rules with a text."""
        if not self.any(text):
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            state, i, best, end = 0, at, None, at + 1
            while i < n and (state := self.arcs[state].get(text[i], -1)) > 0:
                i += 1
                if state in self.writes:
                    best, end = self.writes[state], i
            out.append(text[at] if best is None else best)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy:
            text = " " + text
        if self.escape:
            text = text.replace(" ", SPACE)
        return text.rstrip(SPACE if self.escape else " ") if self.trim else text


class Transducer:
    """encode(text) and decode(ids), equal to the sentencepiece library's."""

    def __init__(self, model: bytes, limit: int = 300_000):
        self.pieces: list[tuple[str, float, int]] = []
        rules, dummy, trim, escape, self.unigram, fallback = {}, True, True, True, True, False
        for number, value in _fields(model):
            f = dict(_fields(value)) if isinstance(value, bytes) else {}
            if number == 1:
                score = struct.unpack("<f", f.get(2, 0).to_bytes(4, "little"))[0]
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                kind, fallback = f.get(3, 1), bool(f.get(35, 0))
                if kind not in (1, 2) or f.get(24):
                    raise ValueError("only unigram and byte-pair models with spaces before words are compiled")
                self.unigram = kind == 1
            elif number == 3:
                rules = charsmap_rules(f.get(2, b""))
                dummy, trim, escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces aren't compiled")
        self.normalise = Normaliser(rules, dummy, trim, escape)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE} if fallback else {}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.trie: dict = {}  # of the pieces, reversed for byte pairs; None: a piece ends here
        for p in self.ids:
            node = self.trie
            for c in p if self.unigram else reversed(p):
                node = node.setdefault(c, {})
            node[None] = p
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours that some piece has
        self.far = np.float32(min(self.scores.values(), default=0.0)) - np.float32(10)
        self.spells = [p.replace(SPACE, " ") if escape else p for p, _, _ in self.pieces]
        self.odd = np.array([kind in (BYTE, CONTROL, UNKNOWN) for _, _, kind in self.pieces])
        self.limit = limit
        self.young: dict[str, bytes] = {}  # outputs of words
        self.old: dict[str, bytes] = {}
        self.young_parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.weights: dict[tuple[str, str], float] = {}

    # The transducer of pieces, and its composition with an input.

    def merged(self, text: str) -> list[str]:
        """The symbols that merging ends in: the best score first, then the leftmost."""
        symbols, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def weight(self, a: str, b: str) -> float:
        """Of a byte-pair model's arc from state a (empty: the start) that reads piece b."""
        key = (a, b)
        known = self.weights.get(key)
        if known is None:
            if len(self.weights) >= 4 * self.limit:
                self.weights.clear()
            known = self.weights[key] = ONE if self.merged(a + b) == ([a, b] if a else [b]) else ZERO
        return known

    def merge_path(self, text: str) -> list[str]:
        """The pieces of the shortest path through a byte-pair model's composition with text."""
        state = [""] * (len(text) + 1)  # that is reached at each position, at weight ONE
        weights, trie = self.weights, self.trie
        for end in range(1, len(text) + 1):
            node, found = trie, []
            for i in range(end - 1, -1, -1):
                node = node.get(text[i])
                if node is None:
                    break
                if None in node:
                    found.append((i, node[None]))
            if not found or found[0][0] != end - 1:  # the fallback's arc
                found.insert(0, (end - 1, text[end - 1]))
            for i, p in reversed(found):  # the longest first
                w = weights.get((state[i], p))
                if w == ONE or w is None and self.weight(state[i], p) == ONE:
                    state[end] = p
                    break
        out, end = [], len(text)
        while end:
            out.append(state[end])
            end -= len(state[end])
        return out[::-1]

    def score_path(self, text: str) -> list[str]:
        """The pieces of the shortest path through a unigram model's composition with text."""
        n = len(text)
        best: list[np.float32 | None] = [np.float32(0)] + [None] * n  # the negative weight of the best path to each position
        back = [0] * (n + 1)
        for at in range(n):
            here, node, single = best[at], self.trie, False
            for i in range(at, n):
                node = node.get(text[i])
                if node is None:
                    break
                if None in node:
                    w = here + np.float32(self.scores[node[None]])
                    single |= i == at
                    if best[i + 1] is None or w > best[i + 1]:
                        best[i + 1], back[i + 1] = w, at
            if not single:
                w = here + self.far
                if best[at + 1] is None or w > best[at + 1]:
                    best[at + 1], back[at + 1] = w, at
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def _output(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        unknown = False
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in p.encode()]
            elif not unknown:  # a run of unknown characters is one id
                ids.append(self.unknown)
            unknown = i is None
        return np.array(ids, "<u4").tobytes()

    def _parts(self, word: str) -> list[str]:
        """A word, cut where no arc crosses."""
        beside, cuts = self.beside, [0]
        cuts += [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in beside]
        cuts.append(len(word))
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _part(self, part: str) -> bytes:
        known = self.young_parts.get(part)
        if known is None:
            known = self.old_parts.get(part) or self._output(self.merge_path(part))
            if len(part) <= 64:
                if len(self.young_parts) >= self.limit:
                    self.old_parts, self.young_parts = self.young_parts, {}
                self.young_parts[part] = known
        return known

    def _word(self, word: str) -> bytes:
        known = self.old.get(word) or b"".join(map(self._part, self._parts(word)))
        if len(word) <= 64:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian 32-bit integers."""
        text = self.normalise(text)
        if not text:
            return b""
        if self.unigram:
            return self._output(self.score_path(text))
        if not self.byte:  # runs of unknown characters are one id, wherever they are cut
            return self._output(sum((self.merge_path(p) for p in self._parts(text)), []))
        if not self.by_word:
            return b"".join(map(self._part, self._parts(text)))
        words = text.split(SPACE)
        # words[0] is what stands before the first space; an empty word is a space that the next one follows
        out, get, spaces = [], self.young.get, 0
        if words[0]:
            out.append(get(words[0]) or self._word(words[0]))
        for w in words[1:]:
            spaces += 1
            if w:
                w = SPACE * spaces + w
                spaces = 0
                out.append(get(w) or self._word(w))
        if spaces:
            out.append(get(SPACE * spaces) or self._word(SPACE * spaces))
        return b"".join(out)

    @functools.cached_property
    def by_word(self) -> bool:
        """Whether no piece holds a space after another character."""
        return self.normalise.escape and not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        spells, out, first = self.spells, [], self.normalise.dummy
        odd = np.flatnonzero(self.odd[ids])
        if not len(odd):
            text = "".join(map(spells.__getitem__, ids.tolist()))
            return text[1:] if first and self.pieces[int(ids[0])][0].startswith(SPACE) else text
        raw = bytearray()

        def spell() -> None:
            i = 0
            while i < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    i += 1
            raw.clear()

        def plain(some: list[int]) -> None:
            nonlocal first
            if some:
                spell()
                text = "".join(map(spells.__getitem__, some))
                out.append(text[1:] if first and self.pieces[some[0]][0].startswith(SPACE) else text)
                first = False

        numbers, at = ids.tolist(), 0
        for k in odd.tolist():
            plain(numbers[at:k])
            at = k + 1
            p, _, kind = self.pieces[numbers[k]]
            if kind == BYTE:
                raw.append(int(p[3:5], 16))
                first = False
                continue
            spell()
            if kind == UNKNOWN:
                out.append(" \u2047 ")
                first = False
        plain(numbers[at:])
        spell()
        return "".join(out)


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip), and ids with with_ids. model: path of the .model file.

    ids_crc32: of the ids as little-endian 32-bit integers. round_trip: whether decoding gives the text again, which is
    so unless the text holds U+2581 itself.
    """
    prepare(docs.sparkSession)

    def run(batches):
        t = transducer(model)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                data = t.encode(text)
                ids = np.frombuffer(data, "<u4")
                back = t.decode(ids)
                rows.append((len(ids), zlib.crc32(data), hashlib.sha256(back.encode()).hexdigest(), back == text, ids.astype(np.int32) if with_ids else None))
            cols = list(zip(*rows)) or [()] * 5
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *out, *([pa.array(cols[4], pa.list_(pa.int32()))] if with_ids else [])], names)

    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
