"""Token ids from a public tokenizer file, with an exact cache of words."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: The id that ends a document.
END = 1
_STOP = "<|endoftext|>"


#: Characters that normalisation only lower-cases, one by one: printable ASCII, and letters up to U+017F without U+0130
#: and U+0149. Words of them are split into pre-tokens here, as the tokenizer's own pattern does.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")
_PLAIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]*")
#: A full stop or comma beside another mark, with which it is one pre-token.
_BESIDE = re.compile(rb"[.,][^\sA-Za-z0-9\x80-\xff]|[^\sA-Za-z0-9\x80-\xff][.,]")
_PRE = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Kept:
    """A dictionary of two generations; of `limit` entries each, the older one goes when the younger is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; the known ones are in the younger generation afterwards."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, keys
        get, out = self.old.get, []
        for k in new:
            if (x := get(k)) is None:
                out.append(k)
            else:
                self.young[k] = x
        return out


class WordEncoder:
    """encode(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, as little-endian 32-bit integers.

    It needs a tokenizer that drops white space between its pre-tokens: then no token spans ASCII white space, and the
    ids of a text are those of its words in order. Words are kept once encoded, and so are the pre-tokens of plain words,
    which go through the tokenizers library once each; other words go through it whole, as they are. Memory is bounded:
    both are kept in two generations. Texts that could hold a special token's string go through the library whole.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stop = self.tokenizer.token_to_id(_STOP)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.plain = _PLAIN.fullmatch if steps == ["NFC", "Replace", "Lowercase"] and split == _PATTERN else lambda w: None
        self.words, self.parts = _Kept(limit), _Kept(limit // 8)

    def _ids(self, text: str) -> np.ndarray:
        # the fast form leaves out offsets; its ids are the same
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _each(self, texts: list[str]):
        """(text, ids) of short texts, many at a time."""
        for i in range(0, len(texts), 1000):
            some = texts[i : i + 1000]
            ids = self._ids(_STOP.join(some))
            at = np.flatnonzero(ids == self.stop)
            data, ends = ids.tobytes(), (4 * at).tolist()
            yield from ((t, data[a:b]) for t, a, b in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True))

    def _learn(self, part: set[bytes]) -> None:
        """Puts all words of a part into the younger generation."""
        split, whole = {}, []
        for w in self.words.missing(part):
            t = w.decode()
            if t.isalpha():
                whole.append(t)
            elif self.plain(t):
                split[w] = _PRE.findall(t.lower())
            else:
                whole.append(t)
        words, parts = self.words.young, self.parts
        for t, ids in self._each(whole):
            words[t.encode()] = ids
        if split:
            new = parts.missing({x for xs in split.values() for x in xs})
            parts.young.update(self._each(new))
            get = parts.young.__getitem__
            for w, xs in split.items():
                words[w] = get(xs[0]) if len(xs) == 1 else b"".join(map(get, xs))

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text or self.stop is None:
            return self._ids(text.decode()).tobytes()
        if self.plain("a") and (text.isascii() or _PLAIN_TEXT.fullmatch(text.decode())):
            # Fewer different words: case doesn't matter in such a text, nor does a space between a letter and a mark.
            text = text.lower()
            if not _BESIDE.search(text):
                text = text.replace(b".", b" . ").replace(b",", b" , ")
        out = []
        words = text.split()
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            ids = list(map(self.words.young.get, part))
            if not all(ids):  # a word without ids is asked for again, which is rare and harmless
                at = [i for i, x in enumerate(ids) if not x]
                self._learn({part[i] for i in at})
                for i in at:
                    ids[i] = self.words.young[part[i]]
            out += ids
        return b"".join(out)


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; tasks that reuse the worker reuse its words."""
    return WordEncoder(path)
