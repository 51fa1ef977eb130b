"""Katz backoff word model over a corpus (operator 11).

A token's probability is looked up from the word pair it ends down to the
word, and down to the one unknown word:

    p(w | v) = d(c(v w)) c(v w) / T(v)     if the pair was seen in training,
    p(w | v) = alpha(v) p(w)               if only v was seen,
    p(w | v) = p(w)                        otherwise,

with ``p(w) = d(c(w)) c(w) / T`` of known words, and all that is left for the
unknown one. ``d`` are Good-Turing discounts of counts up to 5 (``discounts``)
and ``alpha(v) = (1 - sum of p(w | v)) / (1 - sum of p(w))`` over the words seen
after v, so that each context sums to one over the vocabulary and the unknown
word. ``T`` of a context is its count, plus one if that exceeds the discounted
counts: otherwise a context with frequent successors alone left nothing for
others.

The tables are as large as the corpus, so they are never in one place. They
are cut by hash ranges, and documents meet them in blocks:

1. Documents are dealt by hash into blocks of about ``BLOCK_BYTES``. A block
   sends its distinct words and word pairs, sorted, with its training counts,
   to the ranges of the two count tables. A frequent word is one entry a block.
2. A range adds the counts up and answers each block in the order that it asked
   in. It names one block as the owner of each pair, and it hands on the
   counts of counts.
3. A block evaluates its tokens: pairs, else words. It sends what its own pairs
   add to their contexts' sums to the ranges of the context table, and asks for
   the contexts that its unseen pairs back off from.
4. A context range adds up and answers with ``log10 alpha``; the block adds it
   to its documents.

Steps 1 and 3 read the same exchange of texts. Words are compared by 64-bit
hashes; a collision is the one way to a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.shared import col

FOLDS = 10              # documents whose crc32 leaves remainder 0 are held out
BLOCK_BYTES = 12 << 20  # text that a block holds
RANGE_BYTES = 12 << 20  # text whose n-grams a range of a table counts
HIGHEST = 5             # counts up to here are discounted
START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
WORDS, PAIRS = 0, 1


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts ``d[0..k]`` from ``n[r - 1]``, the number of n-grams
    with count r: Good-Turing counts ``(r + 1) n[r+1] / n[r]`` as shares of
    r, scaled so that counts above k stay whole. k is ``HIGHEST``, or the
    largest below it, 2 at least, for which all of them lie between 0 and 1;
    0 if none."""
    for k in range(HIGHEST, 1, -1):
        if min(n[: k + 1]) <= 0:
            continue
        top = (k + 1) * n[k] / n[0]
        if top >= 1:
            continue
        d = [((r + 1) * n[r] / n[r - 1] / r - top) / (1 - top) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d])
    return np.ones(1)


class Level:
    """Discounted counts of one table, from its counts of counts, the sum of
    its counts and its size."""

    def __init__(self, hist: list[int]):
        self.total, self.size = hist[HIGHEST + 1], hist[HIGHEST + 2]
        self.d = discounts(hist[: HIGHEST + 1])
        self.whole = float(self.totals(np.array([self.total]))[0])
        # what the discounts leave
        left = sum(hist[r - 1] * r * (1 - self.d[r]) for r in range(1, len(self.d))) + self.whole - self.total
        self.rest = left / self.whole if self.total else 1.0

    def mass(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small = c < len(self.d)
        return c * np.where(small, self.d[np.where(small, c, 0)], 1.0)

    def totals(self, c: np.ndarray) -> np.ndarray:
        """The totals of contexts seen ``c`` times."""
        return c + (c >= len(self.d))


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _numbers(blob: bytes, kind=np.uint64) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], n * 8, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(kind)


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges of the hash space that sorted ``keys`` fall into."""
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, slice(int(cuts[r]), int(cuts[r + 1]))


def _packed_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


class _Tokens:
    """The tokens of a block: per token its text, its word and its context;
    the distinct words and pairs, sorted, and each token's place in them."""

    def __init__(self, text: pa.ChunkedArray):
        vocab.let_go()
        word, doc, first = [], [], 0
        for chunk in text.chunks:
            for _, part in ta.slices(chunk, 4 << 20):
                data, off = ta.raw(part)
                data = ta.LOWER[data]
                starts, ends, at = ta.word_spans(data, off)
                # a document's end follows its words
                word.append(np.insert(ta.span_hashes(data, starts, ends), at[1:], END))
                doc.append(np.repeat(np.arange(first, first + len(part)), np.diff(at) + 1))
                first += len(part)
        self.docs = first
        w = np.concatenate(word) if word else np.zeros(0, dtype=np.uint64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, dtype=np.int64)
        opens = np.ones(len(w), dtype=bool)
        opens[1:] = self.doc[1:] != self.doc[:-1]
        v = np.where(opens, START, np.concatenate([[START], w[:-1]])) if len(w) else w
        self.words, self.word = np.unique(w, return_inverse=True)
        self.pairs, self.pair = np.unique(ta.mix(ta.mix(v, 0x2545F4914F6CDD1D) + w), return_inverse=True)
        self.context, self.opens = v, opens

    def parent(self) -> np.ndarray:
        """The place of each token's context among the words; a document's
        start was seen as often as its end."""
        prior = np.concatenate([[0], self.word[:-1]]) if len(self.word) else self.word
        return np.where(self.opens, np.searchsorted(self.words, END), prior)


_INT, _BYTES = pa.int32(), pa.binary()
_ASK = pa.schema([("kind", _INT), ("range", _INT), ("block", _INT), ("keys", _BYTES), ("counts", _BYTES)])
_TOLD = pa.schema([("kind", _INT), ("range", _INT), ("block", _INT), ("counts", _BYTES), ("hist", pa.list_(pa.int64()))])


def _evaluated(id_type: pa.DataType) -> pa.Schema:
    """``block`` rows hold a block's documents and the places of its late
    tokens among the contexts it asks for; ``ask``, ``add`` and ``told`` rows
    hold contexts and what is asked, added or told about them."""
    many = {"ids": id_type, "held": pa.bool_(), "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(),
            "score": pa.float64(), "late_doc": _INT, "late_key": _INT}
    return pa.schema([("what", pa.string()), ("range", _INT), ("block", _INT), ("keys", _BYTES), ("a", _BYTES), ("b", _BYTES),
                      ("train", pa.int64()), *[(k, pa.list_(t)) for k, t in many.items()]])


def _ask(ranges: int):
    def f(t: pa.Table) -> pa.Table:
        x = _Tokens(t["text"])
        train = ~np.asarray(t["held_out"]).astype(bool)[x.doc]
        block = t["block"][0].as_py()
        rows = []
        for kind, keys, at in ((WORDS, x.words, x.word), (PAIRS, x.pairs, x.pair)):
            n = np.bincount(at[train], minlength=len(keys)).astype(np.uint64)
            rows += [(kind, r, block, _packed_keys(keys[s]), _planes(n[s])) for r, s in _by_range(keys, ranges)]
        return _table(rows, _ASK)
    return f


def _count(t: pa.Table) -> pa.Table:
    """All blocks' counts of one range, added up; each block's answer is, in
    its own order, twice the count, plus one if the block owns the n-gram."""
    vocab.let_go()
    ta.release()
    t = t.sort_by("block")
    keys = [_sorted_keys(b.as_py()) for b in t["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    own = np.concatenate([_numbers(b.as_py()) for b in t["counts"]]).astype(np.int64)
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=own, minlength=len(uniq)).astype(np.int64)
    owner = np.full(len(uniq), -1)
    trained = np.flatnonzero(own > 0)[::-1]
    owner[at[trained]] = trained  # the first block keeps it
    told = (total[at] * 2 + (owner[at] == np.arange(len(at)))).astype(np.uint64)
    kind, r = t["kind"][0].as_py(), t["range"][0].as_py()
    rows = [(kind, r, b, _planes(told[e - len(k): e]), None)
            for b, k, e in zip(t["block"].to_pylist(), keys, ends.tolist(), strict=True)]
    seen = total[total > 0]
    low = np.bincount(seen[seen <= HIGHEST + 1], minlength=HIGHEST + 2)[1:]
    rows.append((kind, r, -1, None, [*low.tolist(), int(seen.sum()), len(seen)]))
    return _table(rows, _TOLD)


def _evaluate(ranges: int, schema: pa.Schema):
    def f(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:  # no document fell into the block: the totals alone
            return _table([], schema)
        x = _Tokens(docs["text"])
        told = told.sort_by("range")
        level, counts = [], []
        for kind in (WORDS, PAIRS):
            mine = told.filter(pc.equal(told["kind"], kind))
            level.append(Level(mine["hist"].drop_null()[0].as_py()))
            counts.append(np.concatenate([_numbers(b.as_py()) for b in mine["counts"].drop_null()]).astype(np.int64))
        words, pairs = level
        c_word, c_pair = counts[WORDS] >> 1, counts[PAIRS] >> 1
        p_word = np.where(c_word > 0, words.mass(c_word) / max(words.whole, 1.0), words.rest)

        # per token: the pair, else the word
        above = c_word[x.parent()]
        total = pairs.totals(above)
        seen = c_pair[x.pair] > 0
        late = ~seen & (above > 0)
        p = np.where(seen, pairs.mass(c_pair[x.pair]) / np.maximum(total, 1), p_word[x.word])
        add = lambda v: np.bincount(x.doc, weights=v, minlength=x.docs)
        c = c_word[x.word]
        base = add(np.log10((c + 0.1) / (words.total + 0.1 * (words.size + 1))))
        asked, late_key = np.unique(x.context[late], return_inverse=True)
        t_asked = np.zeros(len(asked), dtype=np.uint64)
        t_asked[late_key] = total[late]

        block = docs["block"][0].as_py()
        none = [None] * 9
        rows = [("block", block % ranges, block, None, None, None, words.total, docs["doc_id"].to_pylist(),
                 docs["held_out"].to_pylist(), add(np.ones(len(c))).astype(np.int64), add(c > 0).astype(np.int64), base,
                 add(np.log10(p)), x.doc[late].astype(np.int32), late_key.astype(np.int32))]
        rows += [("ask", r, block, _packed_keys(asked[s]), _planes(t_asked[s]), None, *none) for r, s in _by_range(asked, ranges)]

        # what the pairs that this block owns add to their contexts
        token = np.empty(len(x.pairs), dtype=np.int64)
        token[x.pair] = np.arange(len(x.pair))
        own = np.flatnonzero(counts[PAIRS] & 1)
        contexts, at = np.unique(x.context[token[own]], return_inverse=True)
        a = np.bincount(at, weights=pairs.mass(c_pair[own]), minlength=len(contexts))
        b = np.bincount(at, weights=p_word[x.word[token[own]]], minlength=len(contexts))
        rows += [("add", r, block, _packed_keys(contexts[s]), _planes(a[s]), _planes(b[s]), *none)
                 for r, s in _by_range(contexts, ranges)]
        return _table(rows, schema)
    return f


def _back_off(schema: pa.Schema):
    def f(t: pa.Table) -> pa.Table:
        """Answers ``ask`` rows with ``log10 alpha``; ``block`` rows pass."""
        what = t["what"].combine_chunks()
        pick = lambda w: t.filter(pc.equal(what, w))
        adds, asks = pick("add").sort_by("block"), pick("ask")
        keys = [_sorted_keys(k.as_py()) for k in adds["keys"]]
        uniq, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), return_inverse=True)
        total = lambda c: np.bincount(
            at, weights=np.concatenate([_numbers(b.as_py(), np.float64) for b in adds[c]]) if keys else [], minlength=len(uniq))
        a, b = total("a"), total("b")
        rows = []
        for row in asks.select(["range", "block", "keys", "a"]).to_pylist():
            mine = np.searchsorted(uniq, _sorted_keys(row["keys"]))
            alpha = (1 - a[mine] / _numbers(row["a"]).astype(np.float64)) / (1 - b[mine])
            rows.append(("told", row["range"], row["block"], None, _planes(np.log10(alpha)), None, *[None] * 9))
        return pa.concat_tables([pick("block").cast(schema), _table(rows, schema)])
    return f


def _finish(t: pa.Table) -> pa.Table:
    told = t.filter(pc.equal(t["what"], "told")).sort_by("range")
    alpha = [_numbers(b.as_py(), np.float64) for b in told["a"]]
    alpha = np.concatenate(alpha) if alpha else np.zeros(0)
    own = t.filter(pc.equal(t["what"], "block"))
    flat = lambda c: own[c].combine_chunks().flatten()
    ids = flat("ids")
    late = np.bincount(np.asarray(flat("late_doc")), weights=alpha[np.asarray(flat("late_key"))], minlength=len(ids))
    return pa.table({
        "doc_id": ids, "held_out": flat("held"), "n_tokens": flat("tokens"), "n_known": flat("known"),
        "train_tokens": pa.array([own["train"][0].as_py()] * len(ids), pa.int64()), "base_score": flat("base"),
        "score": pa.array(np.asarray(flat("score")) + late)})


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def katz_scores(df: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = FOLDS,
                block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` of every row of ``df``, under a model of the rows whose crc32 of
    the id's text leaves a remainder by ``folds``; the others are held out.

    Tokens are words, A-Z lower-cased, and one end. ``base_score`` is the
    add-0.1 word score, ``score`` the model's log10 probability of the text.
    A null or empty text is its end alone; a null id counts as the empty
    text for the fold; repeated rows count as often as they are there and
    score alike. Without training rows every token is the unknown word, and
    both scores are 0. An empty table gives no rows; other columns are not
    read.
    """
    rows = df.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"),
                     (F.pmod(F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0)
                     .alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks, ranges = 1 + size // block_bytes, 1 + size // range_bytes
    kind = rows.schema["doc_id"].dataType
    schema = _evaluated(to_arrow_type(kind))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    asked = dealt.groupBy("block").applyInArrow(_ask(ranges), from_arrow_schema(_ASK))
    told = asked.groupBy("kind", "range").applyInArrow(_count, from_arrow_schema(_TOLD))
    hist = F.array(*[F.sum(F.col("hist")[i]) for i in range(HIGHEST + 3)])
    whole = (told.filter("block < 0").groupBy("kind").agg(hist.alias("hist"))  # two rows, one for each block
             .select("kind", F.lit(-1).alias("range"), F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"),
                     F.lit(None).cast("binary").alias("counts"), "hist"))
    told = told.filter("block >= 0").unionByName(whole).withColumnRenamed("block", "of")
    scored = (dealt.groupBy("block").cogroup(told.groupBy("of"))
              .applyInArrow(_evaluate(ranges, schema), from_arrow_schema(schema)))
    back = scored.groupBy("range").applyInArrow(_back_off(schema), from_arrow_schema(schema))
    return back.groupBy("block").applyInArrow(
        _finish, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                 "base_score double, score double")
