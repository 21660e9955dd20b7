"""Token shards, packing and the transducer against the libraries they must equal."""

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veracite.llm import packing, token_output
from veracite.llm.queries import PIECE_MODEL, WORD_TOKENIZER
from veracite.llm.tokenization import WordEncoder
from veracite.llm.wfst import Normaliser, Transducer, charsmap_rules, encoded

ODD = ["", " ", "a", "Don't  DON'T\tx\n", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "ΑΣ ΑΣΑ İi ß 東京", "É́ é ́x \x1c\x85\xa0", "a\x00b 12 ,. ,..", "▁a ▁▁b", "😀😀" * 50, "aaaa" * 900]


def corpus(seed=3, n=80):
    rng = random.Random(seed)
    alphabet = "abcdefghij klmnoprst ué,. \n漢'"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 60, 900])))) for i in range(n)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "".join(rng.choice(alphabet) for _ in range(40_000)))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, piece string, start int")


def ids_of(text, tok=Tokenizer.from_file(WORD_TOKENIZER)):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_letters_and_marks_equal_the_library():
    """All letters with combining marks, of which some compose only in one case, and all characters up to U+0250 in context."""
    enc = WordEncoder(WORD_TOKENIZER)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    words = [a + chr(m) for a in letters for m in range(0x300, 0x370)]
    words += [f for c in range(0x21, 0x250) if not chr(c).isspace() for f in (chr(c), f"A{chr(c)}'S", f"x{chr(c)}'ll9{chr(c)}{chr(c)}", f"'re{chr(c).upper()}.\'t")]
    words += ["J\u030c", "H\u0331", "''re", "don't", "DON'T", "'Sx", "\u0130X", "\u0149", "\u01c5", "12ab34", "\u0178\u0178"]
    for w in words:
        assert np.frombuffer(enc.encode(w.encode()), "<u4").tolist() == enc.tokenizer.encode(w, add_special_tokens=False).ids, ascii(w)
    text = " ".join(words)
    assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [400_000, 50])
def test_cached_words_equal_the_library(limit):
    enc = WordEncoder(WORD_TOKENIZER, limit)
    for _, t in corpus():
        assert enc.encode((t or "").encode()) == ids_of(t)[:-1].tobytes()
    assert len(enc.words.young) <= max(limit, 6000)


def test_token_store(spark):
    rows = corpus()
    store = token_output.TokenStore.write(frame(spark, rows), WORD_TOKENIZER, roll=5000)
    got = sorted(map(tuple, store.read().select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for i, t in sorted(rows):
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    again = token_output.TokenStore(spark, store.uri)
    for i, t in rows[:20]:
        (found,) = again.get(i)
        assert found.astype("<u4").tobytes() == ids_of(t).tobytes()
    assert again.get(555) == [] and again.get(-1) == [] and again.get(max(i for i, _ in rows) + 1) == []
    assert store.manifest.count() > 3


def test_keyed_reads_do_not_grow_with_the_shard():
    class Counting:
        def __init__(self, data):
            self.data, self.calls, self.bytes = data, 0, 0

        def read_at(self, n, at):
            self.calls, self.bytes = self.calls + 1, self.bytes + n
            return self.data[at : at + n]

    for n in (10, 20_000):
        ids = [None, *range(3, 3 + 7 * n, 7)]
        data = token_output._index(ids, [2] * len(ids), 2)
        for key in (3, 3 + 7 * (n // 2), 3 + 7 * (n - 1)):
            file = Counting(data)
            assert token_output.KeyedReader(file).find(key) == [(2 * ids.index(key), 2 * ids.index(key) + 2)]
            assert file.calls <= 9 and file.bytes < 120
        assert token_output.KeyedReader(Counting(data)).find(4) == []
        index = token_output.ShardIndex(data)
        assert index.places().tolist() == list(range(len(ids))) and index.locate(np.array([4, 3])).tolist() == [-1, 1]


def test_token_store_odd_rows(spark):
    empty = token_output.TokenStore.write(frame(spark, []), WORD_TOKENIZER)
    assert empty.manifest.count() == 0 and empty.read().count() == 0
    store = token_output.TokenStore.write(frame(spark, [(None, "a b"), (5, "c"), (5, "c"), (5, "d e"), (7, None)]), WORD_TOKENIZER)
    got = store.read().orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5, 7] and [r.n_tokens for r in got] == [3, 2, 2, 3, 1]
    assert len(store.get(5)) == 3 and len(store.get(7)) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.RandomState(n).randint(0, 2**62, n).astype(np.uint64))
    slots = token_output.PerfectHash.build(keys)(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_packing(spark):
    rows = corpus()
    size = 512
    got = packing.pack_documents(frame(spark, rows), WORD_TOKENIZER, size).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
    assert set(by_doc) == {i for i, _ in rows}
    total = 0
    for i, t in rows:
        ids = ids_of(t)
        total += len(ids)
        pieces = [by_doc[i][k] for k in range(len(by_doc[i]))]
        assert [p.start for p in pieces] == list(range(0, len(ids), size))
        assert [p.length for p in pieces] == [min(size, len(ids) - p.start) for p in pieces]
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    check_sequences(got, size)
    assert len({r.sequence_id for r in got}) <= -(-total // size) + 2


def check_sequences(rows, size):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_packing_odd_rows(spark):
    assert packing.pack_documents(frame(spark, []), WORD_TOKENIZER).count() == 0
    got = packing.pack_documents(frame(spark, [(None, "a"), (None, None), (4, "a"), (4, "a")] + [(9, "b")] * 40), WORD_TOKENIZER, 8).collect()
    assert len(got) == 44
    check_sequences(got, 8)
    assert len({r.sequence_id for r in got}) == -(-(43 * 2 + 1) // 8)


def brute_best_fit(counts, size):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(size - length)
    return sorted(gaps)


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([10, 37, 100])
        counts = {rng.randrange(1, size + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
        plan, opened = packing.sweep(counts, size)
        used, ranks = {}, {}
        for length, r0, r1, b0, each, offset in plan.tolist():
            for r in range(r0, r1):
                seq, at = b0 + (r - r0) // each, offset + (r - r0) % each * length
                used.setdefault(seq, []).append((at, length))
                ranks.setdefault(length, []).append(r)
        assert {n: len(r) for n, r in ranks.items()} == counts and all(sorted(r) == list(range(len(r))) for r in ranks.values())
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
        assert sorted(size - sum(n for _, n in p) for p in used.values()) == brute_best_fit(counts, size) and len(used) == opened


def test_transducer_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECE_MODEL)
    t = Transducer(open(PIECE_MODEL, "rb").read(), limit=40)
    rng = random.Random(1)
    texts = ODD + [x or "" for _, x in corpus()] + ["".join(rng.choice("abc dé▁漢\n .'9😀") for _ in range(rng.randrange(40))) for _ in range(1500)]
    for x in texts:
        ids = np.frombuffer(t.encode(x), "<u4").tolist()
        assert ids == sp.encode(x), x
        assert t.decode(ids) == sp.decode(ids), x
    t.by_word = False
    for x in texts[:60]:
        assert np.frombuffer(t.encode(x), "<u4").tolist() == sp.encode(x), x
    for ids in ([rng.randrange(32000) for _ in range(50)] for _ in range(200)):
        assert t.decode(ids) == sp.decode(ids)
    got = encoded(frame(spark, [(1, None), (None, "a b"), (3, "x"), (3, "x")]), PIECE_MODEL, True).collect()
    assert [(r.doc_id, r.ids, r.round_trip) for r in got] == [(1, [], True), (None, sp.encode("a b"), True), (3, sp.encode("x"), True), (3, sp.encode("x"), True)]
    assert encoded(frame(spark, []), PIECE_MODEL).count() == 0


def message(*fields) -> bytes:
    """A protocol-buffer message of (number, value)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model(pieces, kind, charsmap=b"", dummy=1, trim=1, fallback=0):
    rows = [message((1, p.encode()), (2, float(s)), (3, k)) for p, s, k in pieces]
    return b"".join(message((1, r)) for r in rows) + message((2, message((3, kind), (35, fallback))), (3, message((1, b"own"), (2, charsmap), (3, dummy), (4, trim), (5, 1))))


@pytest.mark.parametrize(("kind", "fallback"), [(1, 0), (1, 1), (2, 0), (2, 1)])
@pytest.mark.parametrize(("dummy", "trim"), [(1, 1), (0, 0), (1, 0)])
def test_small_models_equal_the_library(kind, fallback, dummy, trim):
    """Unigram and byte-pair models with ties, unknown characters, byte fallback and both treatments of spaces."""
    spm = pytest.importorskip("sentencepiece")
    rng = random.Random(kind * 8 + fallback)
    found = {"a", "b", "c", "▁", "é"}
    while len(found) < 60:
        found.add("".join(rng.choice("abc▁é") for _ in range(rng.randrange(2, 5))))
    order = sorted(found, key=lambda p: (len(p), p))
    scores = [-float(i) for i in range(len(order))] if kind == 2 else [rng.choice([-1.5, -2.0, -2.5, -3.25, -4.1]) for _ in order]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] * fallback + list(zip(order, scores, [1] * len(order)))
    data = model(pieces, kind, dummy=dummy, trim=trim, fallback=fallback)
    sp, t = spm.SentencePieceProcessor(model_proto=data), Transducer(data, limit=30)
    for _ in range(1500):
        x = "".join(rng.choice("aabbcc  éxy漢▁") for _ in range(rng.randrange(14)))
        ids = np.frombuffer(t.encode(x), "<u4").tolist()
        assert ids == sp.encode(x), (x, sp.encode(x, out_type=str))


def test_character_map():
    """A double array of two sources, made by hand: "b" and "be" become "x" and "yz"; the longest wins."""
    units, targets = [0] * 1024, b"x\0yz\0"
    units[0] = 256 << 10  # the root's block
    units[256 ^ ord("b")] = ord("b") | 1 << 8 | ((256 ^ ord("b")) ^ 512) << 10
    units[512] = 0 | 1 << 31
    units[512 ^ ord("e")] = ord("e") | 1 << 8 | ((512 ^ ord("e")) ^ 768) << 10
    units[768] = 2 | 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + np.array(units, "<u4").tobytes() + targets
    assert charsmap_rules(blob) == {"b": "x", "be": "yz"}
    n = Normaliser(charsmap_rules(blob), True, False, True)
    assert n("abe bb ebe") == "▁ayz▁xx▁eyz" and n("") == "" and n("acd") == "▁acd"
    spm = pytest.importorskip("sentencepiece")
    data = model([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((c, -1.0 - i, 1) for i, c in enumerate("▁axyzecd"))], 1, blob)
    sp, t = spm.SentencePieceProcessor(model_proto=data), Transducer(data)
    for x in ("abe bb ebe", "  be  b ", "cd", "bebebx q", "   "):
        assert np.frombuffer(t.encode(x), "<u4").tolist() == sp.encode(x), x
