"""Public vocabularies inside tasks: word-by-word encoding with a bounded cache.

Texts repeat their words, so a task encodes each distinct piece of text
once and gathers the ids of all its occurrences with numpy. The cache is
keyed by a 64-bit hash, holds at most ``max_words`` entries and starts
anew beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from distillery.llm import textarrays as ta
from distillery.operators.generate import _worker_store


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """``encode(list of str) -> list of id lists``, remembered by hash."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], max_words: int = 300_000):
        self.encode, self.max_words = encode, max_words
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slot = np.zeros(0, dtype=np.int64)
        self.off = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def lookup(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry number of each span; spans not met before are encoded."""
        uniq, inv = np.unique(hashes, return_inverse=True)
        first = np.empty(len(uniq), dtype=np.int64)
        first[inv] = np.arange(len(inv))  # any occurrence
        if len(self.keys) + len(uniq) > self.max_words:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        new = np.flatnonzero(~known)
        if len(new):
            buf = data.tobytes()
            words = [buf[s:e].decode("utf-8", "replace")
                     for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            coded = self.encode(words)
            lens = np.fromiter((len(c) for c in coded), dtype=np.int64, count=len(coded))
            flat = np.fromiter((i for c in coded for i in c), dtype=np.int32, count=int(lens.sum()))
            base = len(self.off) - 1
            self.ids = np.concatenate([self.ids, flat])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
            self.slot = np.insert(self.slot, at[new], base + np.arange(len(new)))
            self.keys = np.insert(self.keys, at[new], uniq[new])
            at = np.searchsorted(self.keys, uniq)
        return self.slot[at][inv]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of entries, one after another."""
        lens = self.off[slots + 1] - self.off[slots]
        return self.ids[ragged(self.off[slots], lens)], lens


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + length[i] - 1``, one after another."""
    if not len(length):
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def piece_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut once more between an ASCII letter and ASCII punctuation
    (apostrophes stay). A tokenizer that splits there anyway gives a piece
    the same ids alone as in its text."""
    if len(data) == 0:
        return ta.word_spans(data, off)
    word = ~ta.WHITESPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    letter, punct = _LETTER[data], _PUNCT[data]
    edge[1:-1] |= (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def held(key: tuple, build: Callable):
    """``build()``, kept by the Python worker for the tasks to come until
    another key is asked for: workers live on from one stage to the next, so
    each holds the vocabulary and word cache of one operator at a time."""
    store = _worker_store()
    if store.get("held", (None,))[0] != key:
        store.pop("held", None)
        store.pop("loaded", None)
        ta.release()
        store["held"] = key, build()
    return store["held"][1]


def let_go() -> None:
    """Drop what an earlier operator left in this Python worker."""
    store = _worker_store()
    if [k for k in ("held", "loaded") if store.pop(k, None)]:
        ta.release()


def _loaded() -> dict:
    return _worker_store().setdefault("loaded", {})


def tokenizer(path: str):
    """A `tokenizers` file, loaded once per Python worker."""
    loaded = _loaded()
    if path not in loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def pieces(path: str):
    """A `sentencepiece` model, loaded once per Python worker."""
    loaded = _loaded()
    if path not in loaded:
        import sentencepiece

        loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return loaded[path]


def _byte_signs() -> list[str]:
    """The printable sign byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(extra)
            extra += 1
    return [signs[b] for b in range(256)]


def lowercase_bpe(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of pieces by a `tokenizers` file that lower-cases, splits letter
    runs from the rest and works on bytes. A piece of Latin letters only is
    a single run and goes to its BPE model directly; any other piece takes
    the whole pipeline."""
    import unicodedata

    tok = tokenizer(path)
    model, signs = tok.model, _byte_signs()

    def encode(words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if w.isascii():
                if w.isalpha():
                    out[k] = [t.id for t in model.tokenize(w.lower())]
                    continue
            elif w.isalpha() and max(w) < "\u0250" and "\u0130" not in w and unicodedata.is_normalized("NFC", w):
                out[k] = [t.id for t in model.tokenize("".join([signs[b] for b in w.lower().encode()]))]
                continue
            rest.append(k)
        coded = tok.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)
        for k, c in zip(rest, coded, strict=True):
            out[k] = c.ids
        return out

    return encode
