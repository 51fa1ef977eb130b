"""The word model and the two audits against brute force, and on odd tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from distillery.llm import filter_audit, katz, source_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, "one two three One TWO three", "en", "a"), (1, "one two three One TWO three", "en", "a"), (2, None, None, None),
       (3, "", "en", "a"), (4, " \t\n ", "de", "b"), (None, "null id text three", "en", "a"), (None, "one two three One TWO three", "en", "b"),
       (5, LONG, "en", "b"), (6, "é ü ß 中文 \U0001f600 </s> $1", "fr", "b"), (7, "ONE X", "", "a"), (8, "one two three One TWO three", "de", None)]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def odd(spark):
    """Odd rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("block", "held_out", "n", "part", "mask", "term", "good", "kind", "word", "p", "size", "value", "rank"):
        df = df.withColumn(c, F.lit("extra"))
    return df


# ---------------------------------------------------------------- word model

class BruteKatz:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.word, self.pair = Counter(), Counter()
        for t in texts:
            toks = self.tokens(t)
            self.word.update(toks)
            self.pair.update(zip(["<s>", *toks[:-1]], toks, strict=True))
        self.n = sum(self.word.values())
        self.d1, self.d2 = (katz.discounts([sum(c == r for c in t.values()) for r in range(1, 7)]) for t in (self.word, self.pair))
        self.total = self.n + (self.n >= len(self.d1))
        known = sum(self.d(self.d1, c) * c for c in self.word.values())
        self.unknown = 1 - known / self.total if self.n else 1.0
        self.after = defaultdict(list)
        for v, w in self.pair:
            self.after[v].append(w)
        self.contexts = Counter()
        for (v, _), c in self.pair.items():
            self.contexts[v] += c

    @staticmethod
    def tokens(text):
        return [*WORD.findall((text or "").translate(UPPER)), "</s> end"]

    @staticmethod
    def d(table, c):
        return table[c] if c < len(table) else 1.0

    def p1(self, w):
        c = self.word[w]
        return self.d(self.d1, c) * c / self.total if c else self.unknown

    def p(self, w, v):
        c, above = self.pair[v, w], self.contexts[v]
        if not above:
            return self.p1(w)
        total = above + (above >= len(self.d2))
        if c:
            return self.d(self.d2, c) * c / total
        seen = self.after[v]
        alpha = (1 - sum(self.d(self.d2, self.pair[v, x]) * self.pair[v, x] for x in seen) / total) / (1 - sum(map(self.p1, seen)))
        return alpha * self.p1(w)

    def score(self, text):
        toks = self.tokens(text)
        return sum(math.log10(self.p(w, v)) for v, w in zip(["<s>", *toks[:-1]], toks, strict=True))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % katz.FOLDS == 0


def check_katz(rows, found):
    model = BruteKatz([t for i, t in rows if not held(i)])
    v, n = len(model.word), model.n
    want = []
    for i, t in rows:
        toks = model.tokens(t)
        base = sum(math.log10((model.word[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        want.append((-1 if i is None else i, held(i), len(toks), sum(model.word[w] > 0 for w in toks), n, base, model.score(t)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in found)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


@pytest.mark.parametrize("size", [12 << 20, 20_000])
def test_katz_against_dictionaries(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    model = check_katz(rows, katz.katz_scores(docs, block_bytes=size, range_bytes=size).collect())
    # every context sums to one over the vocabulary and the unknown word
    for v in ["<s>", *random.Random(1).sample(sorted(model.contexts), 5), "unheard of"]:
        assert sum(model.p(w, v) for w in model.word) + model.p("unheard of", v) == pytest.approx(1)


def test_katz_beats_the_base_on_held_out_texts(spark):
    found = katz.katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = found.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_katz_odd_rows(spark):
    for size in (12 << 20, 50_000):
        check_katz([r[:2] for r in ODD], katz.katz_scores(odd(spark), block_bytes=size, range_bytes=size).collect())
    assert katz.katz_scores(odd(spark).limit(0)).count() == 0
    # frequent pairs alone: a context still leaves something for others
    rows = [(i, "a b a b") for i in range(40)] + [(40, "b c a"), (0, "a zz")]
    check_katz(rows, katz.katz_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    alone = [(i, "all held out") for i in range(200) if held(i)]
    for r in katz.katz_scores(spark.createDataFrame(alone, "doc_id bigint, text string")).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_discounts_fall_back():
    assert len(katz.discounts([0] * 6)) == 1
    assert len(katz.discounts([100, 40, 20, 12, 8, 5])) == 6
    assert len(katz.discounts([100, 30, 0, 0, 0, 0])) == 1
    assert katz.discounts([100, 30, 12, 0, 0, 0]) == pytest.approx([1, 0.375, 0.375])
    assert len(katz.discounts([1, 50, 3, 9, 1, 70])) == 1


# -------------------------------------------------------------- filter audit

def brute_steps(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flag = lambda k: {r[0] for r in labels if r[0] is not None and r[k] == 1}
    good, toxic = flag(1), flag(2)
    rows = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > first[t]), strict=True) if x}
        rows[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, these in rows.items():
        for order in permutations("ABCDE"):
            alive = list(these)
            for k, f in enumerate(order):
                gone = [r for r in alive if f in r[0]]
                alive = [r for r in alive if f not in r[0]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (
                    len(alive), len(gone), sum(f in r[0] for r in these) - len(gone), sum(r[0] == {f} for r in these),
                    sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def steps_of(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:3]: r[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_steps_against_removals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    found = steps_of(filter_audit.filter_interactions(docs, labels))
    assert found == brute_steps([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_filter_steps_odd_rows(spark):
    labels = [(1, 1, 0), (1, 1, 1), (2, None, 1), (8, 1, 2), (None, 1, 1), (6, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("mask", F.lit(1))
    found = steps_of(filter_audit.filter_interactions(odd(spark), frame))
    assert found == brute_steps(ODD, labels) and {k[0] for k in found} == {"", "en", "de", "fr"}
    assert filter_audit.filter_interactions(odd(spark).limit(0), frame).count() == 0
    none = steps_of(filter_audit.filter_interactions(odd(spark), frame.limit(0)))
    assert all(v[4:6] == (0, 0) for v in none.values())


def test_potentials_are_the_recursion():
    v = np.array([0, *np.random.default_rng(3).integers(1, 1000, 31)])
    q = filter_audit.potentials(v)
    for s in range(1, 32):
        k = bin(s).count("1")
        inside = [s & ~(1 << i) for i in range(5) if s >> i & 1]
        # P(S) = (v(S) + sum of P(S - i)) / |S|
        assert q[s] / math.factorial(k) == pytest.approx((v[s] + sum(q[x] / math.factorial(k - 1) for x in inside)) / k)


# -------------------------------------------------------------- source audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(docs):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in docs:
        key = (lang or "", source or "")
        groups.add(key)
        terms = TERM.findall((t or "").translate(UPPER))
        counts[key].update(terms)
        df[key[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]
        names = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = shares(counts[lang, source])
        lists = {"pair": [], "term": []}
        for other in names:
            if other != source:
                q = shares(counts[lang, other])
                lists["pair"].append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = shares(whole)
        lists["term"] = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items in lists.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, *x, k + 1) for k, x in enumerate(items) if part == "pair" or k < 200]
    return sorted(out)


@pytest.mark.parametrize("cells", [500_000, 300])
def test_divergence_against_dense_columns(spark, cells, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK_CELLS", cells)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()] + ODD * 3
    found = source_audit.source_divergence(docs.unionByName(spark.createDataFrame(ODD * 3, SCHEMA)))
    assert sorted(tuple(r) for r in found.collect()) == brute_divergence(rows)


def test_divergence_odd_rows(spark):
    found = sorted(tuple(r) for r in source_audit.source_divergence(odd(spark)).collect())
    assert found == brute_divergence(ODD)
    assert ("de", "b", "pair", "", 0, 1) in found  # a language without kept terms
    assert source_audit.source_divergence(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("part_bytes", [8 << 20, 1000])
def test_term_counts_of_a_part_are_combined(part_bytes, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "PART_BYTES", part_bytes)
    rows = [(k % 2 and "en" or "", f"s{k % 70}", t) for k, t in enumerate(
        ["B\u00c9 b\u00c9 be", "x", "", "a1a-A", "z\u00e9 \U0001f600Q", "0 9", "@[`{\x7f", "aB"] * 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["lang", "source", "text"]).slice(3)
    found = list(source_audit._count_terms(iter([batch.slice(0, 0), batch])))
    n, docs = Counter(), Counter()
    for lang, source, t in rows[3:]:
        terms = TERM.findall(t.translate(UPPER))
        n.update((lang, source, x) for x in terms)
        docs.update((lang, source, x) for x in set(terms))
    got = [tuple(r.values()) for b in found for r in b.to_pylist()]
    sums = {k: [0, 0] for k in n}
    for *k, c, d in got:
        sums[tuple(k)][0] += c
        sums[tuple(k)][1] += d
    assert sums == {k: [n[k], docs[k]] for k in n}
    if part_bytes > 1000:  # one batch for all its groups, a row for each cell
        assert len(found) == 1 and len(got) == len(n)


def test_runs_restore_columns():
    rng = np.random.default_rng(5)
    for terms in (1, 2, 50):
        for _ in range(30):
            dense = rng.integers(0, 3, (4, terms))
            t, s = np.nonzero(dense.T)
            place = source_audit.reorder(t, s, dense[s, t], terms)
            assert sorted(place) == list(range(terms))
            new = np.empty_like(dense)
            new[:, place] = dense
            # equal counts lie together: the first source's column has one run a count
            assert len(np.flatnonzero(np.diff(new[0]))) == len(set(new[0].tolist())) - 1
            for row in new:
                at = np.flatnonzero(row)
                starts, values = source_audit.encode_runs(at, row[at], 0, terms)
                assert np.array_equal(np.repeat(values, np.diff(np.append(starts, terms))), row)
                assert starts[0] == 0 and (np.diff(values) != 0).all()
