"""Token counts by a linear longest-match automaton (operator 7).

Greedy word-piece: a word is cut into the longest vocabulary piece that
begins it, then the longest continuation piece, and so on; a word that
cannot be cut counts as one unknown token. The automaton is a trie of the
pieces (word-initial pieces hang from one root, continuations from another)
with failure links: when a character does not continue a node, the pieces
already certain are popped and the walk goes on at the node of what is
left. A node stores its failure node and the number of popped tokens, so
the length of a word is summed without making any piece, and each character
is looked at once but for the failure steps it pays for.

All distinct words of a batch walk the automaton together, one character at
a time, as numpy arrays.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.shared import col

_CHARS = 1 << 21  # code points, for (node, character) keys


class LengthAutomaton:
    """Greedy longest-match lengths over ``pieces``: (text, starts a word)."""

    def __init__(self, pieces: list[tuple[str, bool]]):
        kids: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for text, initial in pieces:
            v = 0 if initial else 1
            for ch in map(ord, text):
                nxt = kids[v].get(ch)
                if nxt is None:
                    nxt = len(kids)
                    kids.append({})
                    final.append(False)
                    kids[v][ch] = nxt
                v = nxt
            final[v] = bool(text)
        n = len(kids)
        fail, popped = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        todo = deque((c, w, 0) for c, w in kids[0].items())
        todo.extend((c, w, 1) for c, w in kids[1].items())
        while todo:  # breadth first: failure nodes are shallower
            ch, v, up = todo.popleft()
            if final[v]:
                fail[v], popped[v] = 1, 1  # v is one token, go on at the continuation root
            else:
                z, pops = int(fail[up]), int(popped[up])
                while z >= 0 and ch not in kids[z]:
                    pops += int(popped[z])
                    z = int(fail[z])
                if z >= 0:
                    fail[v], popped[v] = kids[z][ch], pops
            todo.extend((c, w, v) for c, w in kids[v].items())
        self.fail, self.popped = fail, popped
        edges = sorted((v * _CHARS + c, w) for v in range(n) for c, w in kids[v].items())
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.to = np.array([w for _, w in edges], dtype=np.int64)

    def _step(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(state), -1)
        k = state * _CHARS + ch
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.to[at], -1)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; -1 for a word that cannot be cut, 0 for ''."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        state, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        order = np.argsort(-size, kind="stable")  # words still running stay in front
        longest = int(size.max()) if len(size) else 0
        running = np.searchsorted(-size[order], -np.arange(longest), side="left")
        for pos in range(longest):
            at = order[: running[pos]]
            at = at[state[at] >= 0]
            self._advance(at, flat[start[at] + pos], state, count)
        # what is left of a word after its last character is popped likewise
        at = np.flatnonzero((state >= 2) & (size > 0))
        while len(at):
            count[at] += self.popped[state[at]]
            state[at] = self.fail[state[at]]
            at = at[state[at] >= 2]
        return np.where((state == 1) | (size == 0), count, -1)

    def _advance(self, at: np.ndarray, ch: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        while len(at):
            nxt = self._step(state[at], ch)
            hit = nxt >= 0
            state[at[hit]] = nxt[hit]
            at, ch = at[~hit], ch[~hit]
            count[at] += self.popped[state[at]]
            state[at] = self.fail[state[at]]
            alive = state[at] >= 0
            at, ch = at[alive], ch[alive]


def word_pieces(path: str) -> list[tuple[str, bool]]:
    """Pieces of a sentencepiece vocabulary as (text, starts a word): its
    word mark becomes the flag; special, byte and mark-only pieces are out."""
    model = vocab.pieces(path)
    out = []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        p = model.id_to_piece(i)
        text = p.removeprefix("▁")
        if text and "▁" not in text:
            out.append((text, p != text))
    return out


def _word_cache(path: str) -> vocab.WordCache:
    auto = LengthAutomaton(word_pieces(path))
    # the cache stores a word's length as its single "id"
    return vocab.WordCache(lambda w: auto.lengths(w)[:, None].tolist())


def _counts(arr: pa.Array, path: str) -> pa.Array:
    cache = vocab.held(("counts", path), lambda: _word_cache(path))
    out = [[], [], [], []]
    for _, part in ta.slices(arr):
        data, off = ta.raw(part)
        starts, ends, at = ta.word_spans(data, off)
        slots = cache.lookup(ta.span_hashes(data, starts, ends), data, starts, ends)
        n, _ = cache.gather(slots)
        owner = np.repeat(np.arange(len(part)), np.diff(at))
        unknown = n < 0
        add = lambda w: np.bincount(owner, weights=w, minlength=len(part)).astype(np.int64)
        for o, v in zip(out, (np.diff(at), add(np.where(unknown, 1, n)), add(unknown), np.diff(off)), strict=True):
            o.append(v)
    names = ["n_words", "n_tokens", "n_unknown", "n_bytes"]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], names)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown, n_bytes)`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no tokens;
    repeated rows are counted each; an empty table gives no rows; other
    columns are not read.
    """
    kind = "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint,n_bytes:bigint>"
    counted = arrow_udf(lambda a: _counts(a, vocabulary), kind)(col(text))
    return df.select(col(doc_id).alias("doc_id"), counted.alias("c")).select("doc_id", "c.*")


def corpus_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Token totals by group, combined before the shuffle."""
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
