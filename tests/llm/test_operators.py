"""The operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from distillery.llm import (
    chat_template,
    components,
    fertility,
    license_rules,
    mixing,
    ngram_join,
    packing,
    quality_trees,
    queries,
    token_counts,
    url_rules,
    vocab,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    """``{id: (n_shingles, component)}`` by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op1_held_out_accuracy(spark):
    rows = (queries.op1_quality_trees(spark, "/root/testdata/sf0.01")
            .join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect())
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    clean = [r for r in rows if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in clean]) > 0.97


def test_op2_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_trie_join(spark, SF).collect()}
    assert got == brute_components(texts)


def near_group(size, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


def test_op2_blocks_of_large_groups(spark, monkeypatch):
    """Groups above the block size go through pivots and block pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 3_000)
    monkeypatch.setattr(ngram_join, "SLOT_COUNTS", 50)
    docs = [*near_group(60, 80, 3, 1), *near_group(40, 60, 4, 2), *near_group(30, 50, 2, 3)]
    shared = docs[0].split()[:60]
    docs += [" ".join(shared + [f"own{i}x{k}" for k in range(12)]) for i in range(20)]
    texts = dict(enumerate(docs))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(df).collect()}
    assert got == brute_components(texts)


def test_op2_ranges_hold_no_copies(spark, monkeypatch):
    """Copies, with other ids or as whole rows, do not fill a range."""
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 400)
    docs = near_group(3, 80, 2, 4)
    rows = [(i, docs[0]) for i in range(200)] + [(1000 + i % 2, docs[1 + i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    dealt, real = [], type(df).mapInArrow

    def spy(self, f, schema, *args, **kw):
        out = real(self, f, schema, *args, **kw)
        if schema == ngram_join._PACK:
            dealt.append(out)
        return out
    monkeypatch.setattr(type(df), "mapInArrow", spy)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(df).collect()}
    assert got == brute_components(dict(rows))
    for out, width in zip(dealt, (4, 8), strict=True):
        held = out.groupBy("r").agg((F.sum(F.length("toks")) / width).alias("n")).agg(F.max("n")).first()[0]
        assert held <= 2 * ngram_join.RANGE_TOKENS


def test_trie_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        bases = [rng.permutation(60)[: rng.integers(1, 50)] for _ in range(3)]
        sets = []
        for _ in range(n):
            s = set(bases[rng.integers(3)].tolist())
            for _ in range(rng.integers(0, 6)):
                s.discard(int(rng.integers(60)))
                s.add(int(rng.integers(60)))
            sets.append(np.array(sorted(s)))
        sizes = np.array([len(s) for s in sets]) + rng.integers(0, 3, n)
        tree = ngram_join.Trie(sets, sizes, run=int(rng.integers(1, 30)))
        for p in range(n):
            present = np.zeros(61, dtype=bool)
            present[sets[p]] = True
            hits, over = tree.probe(present, len(sets[p]), int(sizes[p]))
            got = {int(a): int(o) for a, o in zip(hits, over, strict=True) if 7 * o >= 3 * (sizes[p] + sizes[a])}
            both = {i: len(np.intersect1d(sets[p], sets[i])) for i in range(n)}
            assert got == {i: o for i, o in both.items() if 7 * o >= 3 * (sizes[p] + sizes[i])}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3), (200, 5)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(df.limit(0)).count() == 0


def test_op3_edits_and_likeness(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op3_one_permutation_minhash(spark, SF).collect()}
    ids, prints, errors = sorted(texts), {}, []
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        a, b = shingles_cased(t), shingles_cased(edited)
        errors.append(rows[i]["near_edited"] - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.07


def shingles_cased(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_counts(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    times = Counter(runs)
    inside = {j for k, r in enumerate(runs) if times[r] > 1 for j in range(k, k + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_op4_counts_and_labels(spark, texts):
    rows = queries.op4_tokeniser_fertility(spark, SF).collect()
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_counts(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    model = vocab.pieces(vocab.public_path(queries.FERTILITY_VOCABULARY))
    for r in rows[:40]:
        ids = [i for w in WORD.findall(texts[r["doc_id"]]) for i in model.encode(w)]
        assert r["n_tokens"] == len(ids)
        assert r["byte_share"] == pytest.approx(sum(map(model.is_byte, ids)) / max(1, len(ids)))


def test_op4_bands_reject_noise(spark):
    rng = random.Random(5)
    clean = [" ".join(rng.choice("the of and to in that was with for this have from".split()) + rng.choice("abcde") for _ in range(120))
             for _ in range(80)]
    noise = " ".join("".join(chr(rng.randrange(0x1400, 0x1600)) for _ in range(6)) for _ in range(120))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, noise])], "doc_id bigint, text string, lang string")
    rules = fertility.FertilityRules(vocab.public_path(queries.FERTILITY_VOCABULARY), min_group=20)
    # a group is a language at an octave of its length: bring the noise into it
    r = {x["doc_id"]: x for x in fertility.fertility_report(df, rules).collect()}
    assert all(r[i]["kept"] for i in range(80))
    found = {"en:8": {"chars_per_token": (1.0, 9.0), "byte_share": (0.0, 0.1), "token_entropy": (0.1, 2.0)}}
    probe = spark.createDataFrame([("en:8", 300, 0.5, 0.9, 0.9), ("en:8", 300, 2.0, 0.0, 0.9), ("fr:8", 300, 0.5, 0.9, 0.9), ("en:8", 9, 0.5, 0.9, 0.9)],
                                  "grp string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double")
    m = F.struct("n_tokens", *fertility.MEASURES)
    assert [x[0] for x in probe.select(fertility.in_bands(F.col("grp"), m, found, rules)).collect()] == [False, True, True, True]


def test_op4_noise_goes_at_every_size(spark):
    """Noise finds a band whatever its length, language or tokens."""
    rng = random.Random(5)
    words = "the of and to in that was with for this have from".split()
    some = lambda k: " ".join(rng.choice(words) + rng.choice("abcde") for _ in range(k))
    noise = lambda k: " ".join("".join(chr(rng.randrange(0x1400, 0x1600)) for _ in range(6)) for _ in range(k))
    clean = [(some(120), "en") for _ in range(80)] + [(some(12), "en") for _ in range(60)] + [(some(150), "fr") for _ in range(5)]
    bad = [(noise(k), lang) for k in (12, 120, 3000) for lang in ("en", "fr", "xx", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate([*clean, *bad])], "doc_id bigint, text string, lang string")
    rules = fertility.FertilityRules(vocab.public_path(queries.FERTILITY_VOCABULARY))
    got = {r["doc_id"]: r["kept"] for r in fertility.fertility_report(df, rules).collect()}
    assert got == {i: i < len(clean) for i in range(len(clean) + len(bad))}
    assert {r["doc_id"] for r in fertility.keep_fluent(df, rules).collect()} == set(range(len(clean)))


def test_op5_rules_in_order(spark):
    rows = [(1, "Foo. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\n"
                "You may obtain a copy of the License at"),
            (2, "You may obtain a copy of the License at. Released under the MIT License."),
            (3, "released UNDER the   mit license!\nBar\nThe software is provided \"as is\", without warranty of any kind, express or implied"),
            (4, "Licensed under CC BY-NC 4.0."), (5, "no licence here"), (6, None)]
    got = {r["doc_id"]: r for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["licenses"] == "Apache-2.0" and got[1]["first_sentence"] == 1
    assert got[1]["sentence_ids"] == "APACHE2_LICENSED APACHE2_MAY_NOT APACHE2_COPY"
    assert got[2]["licenses"] == "MIT" and got[3]["licenses"] == "MIT" and got[3]["sentence_ids"] == "MIT_RELEASED AS_IS"
    assert got[4]["licenses"] == "CC-BY-NC-4.0"
    assert (got[5]["licenses"], got[6]["licenses"], got[6]["first_sentence"]) == ("", "", None)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright (c) 2020, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """ * This program is free software%s you can redistribute it and/or modify
 * it under the terms of the GNU %s as published by
 * the Free Software Foundation%s either version %s of the License, or
 * (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""


def test_op5_published_notices(spark):
    cases = [(MIT, "MIT"), (BSD, "BSD"), (APACHE, "Apache-2.0"), (ISC, "ISC"), (MIT.replace("\n", "\r\n"), "MIT"),
             (GPL % (":", "General Public License", ",", "3"), "GPL-3.0-or-later"),
             (GPL % (";", "General Public License", ";", "2"), "GPL-2.0-or-later"),
             (GPL % (";", "Lesser General Public License", ";", "2.1"), "LGPL-2.1-or-later"),
             (GPL % (":", "Affero General Public License", ",", "3"), "AGPL-3.0-or-later"),
             ("This file is released under the MIT license", "MIT"), ("Copyright (c) 2020 X, All rights reserved", "proprietary"),
             ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
             ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT Apache-2.0"), ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
             ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"),
             ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"),
             ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
             ("It is not licensed under the MIT license.", ""), ("The MIT licence was named in all of the text.", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_rules.scan_licenses(df).collect()}
    want = {i: w for i, (_, w) in enumerate(cases)}
    assert {i: " ".join(sorted(r["licenses"].split())) for i, r in got.items()} == {i: " ".join(sorted(w.split())) for i, w in want.items()}
    assert got[0]["sentence_ids"] == "MIT_PERMISSION AS_IS" and got[0]["first_sentence"] == 3


def test_op6_meets_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.6, 0.4, 0.3], 400)
    rows = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(rng.integers(10, 500, 400), p, strict=True)],
                                 "tokens bigint, p0 double, p1 double, p2 double")
    total = rows.agg(F.sum("tokens")).first()[0]
    target = np.array([0.5, 0.3, 0.2]) * total
    rate = mixing.rate_column(mixing.fit_rates(rows, target), [F.col(f"p{i}") for i in range(3)])
    got = rows.select(*[F.sum(F.col("tokens") * rate * F.col(f"p{i}")) for i in range(3)], F.min(rate)).first()
    assert np.allclose(got[:3], target, rtol=0.02) and got[3] >= 0


@pytest.mark.parametrize("share", [(0.9, 0.06, 0.04, 0.0), (0.1, 0.1, 0.1, 0.7), (1.0, 0.0, 0.0, 0.0)])
def test_op6_is_least_squares(spark, share):
    """Nearly hard posteriors, a domain with next to no tokens, targets that
    clip rates: against projected gradient descent on the rates themselves."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.02, 0.02, 0.02, 0.002], 300)
    p = (p + 1e-6) / (p + 1e-6).sum(axis=1, keepdims=True)
    t = rng.integers(10, 500, 300).astype(float)
    rows = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p, strict=True)],
                                 "tokens bigint, " + ", ".join(f"p{i} double" for i in range(4)))
    target = np.array(share) * t.sum()
    lam = mixing.fit_rates(rows, target)
    got = np.maximum(0, 1 + p @ np.array(lam))
    assert np.allclose([r[0] for r in rows.select(mixing.rate_column(lam, [F.col(f"p{i}") for i in range(4)])).collect()], got)
    ridge = mixing.RIDGE * ((t[:, None] * p).T @ p).trace() / 4
    cost = lambda r: ((t * r) @ p - target) @ ((t * r) @ p - target) + ridge * (t * (r - 1) ** 2).sum()
    # the optimum's conditions, by rate: no slope where it is positive, none downwards at zero
    slope = 2 * t * (p @ ((t * got) @ p - target) + ridge * (got - 1))
    assert (np.abs(slope[got > 1e-9]) <= 1e-5 * t.sum() * t[got > 1e-9]).all() and (slope[got <= 1e-9] >= -1e-5 * t.sum()).all()
    r, y, k = np.ones(300), np.ones(300), 1.0
    rate = 1 / (2 * (np.linalg.norm(t[:, None] * p, 2) ** 2 + ridge * t.max()))
    for _ in range(20_000):  # accelerated projected gradient
        new = np.maximum(0, y - rate * 2 * t * (p @ ((t * y) @ p - target) + ridge * (y - 1)))
        k, before = (1 + math.sqrt(1 + 4 * k * k)) / 2, k
        y, r = new + (before - 1) / k * (new - r), new
    assert cost(got) <= cost(r) * (1 + 1e-6) + 1e-6 * t.sum() ** 2 * mixing.RIDGE
    if share[3] == 0:
        assert np.abs((t * got) @ p - target)[:3].max() <= 1e-3 * t.sum()


def test_op6_meets_targets_within_a_thousandth(spark):
    rows = queries.op6_soft_membership_mixing(spark, "/root/testdata/sf0.01")
    whole = rows.agg(F.sum("tokens")).first()[0]
    for d, w in queries.MIX_WEIGHTS.items():
        got = rows.agg(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}"))).first()[0]
        assert got == pytest.approx(w * whole, rel=1e-3)


def test_op6_finds_toxic_documents(spark):
    rows = (queries.op6_soft_membership_mixing(spark, "/root/testdata/sf0.01")
            .join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect())
    mean = lambda c: np.mean([r["rate"] for r in rows if c(r)])
    assert mean(lambda r: r["toxic"] and r["quality"]) < 0.3 < 1 < mean(lambda r: r["quality"] and not r["toxic"])


def test_op1_splits_are_the_best(spark):
    """One tree of depth 2 against an exhaustive search over the same cuts."""
    rng = np.random.default_rng(2)
    width = len(quality_trees.FEATURES)
    x = rng.integers(0, 12, (200, width)).astype(float)
    y = ((x[:, 1] > 5) & (x[:, 3] <= 8) | (rng.random(200) < 0.1)).astype(int)
    x[:20], y[:20] = x[0], y[0]  # repeated rows and ties
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(5)
    model = quality_trees.fit(rows, trees=1, depth=2, bins=64)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))

    def gain(mask, f, cut):
        parts = [mask & (x[:, f] <= cut), mask & (x[:, f] > cut)]
        if min(h[m].sum() for m in parts) < 1:
            return -1.0
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in parts) - g[mask].sum() ** 2 / (h[mask].sum() + 1)

    def walk(node, mask, depth):
        best = max(gain(mask, f, c) for f in range(width) for c in range(12)) if depth < 2 else -1
        if model.feature[node] < 0:
            assert depth == 2 or best <= 1e-6
            assert model.value[node] == pytest.approx(-0.4 * g[mask].sum() / (h[mask].sum() + 1))
            return
        f, c = int(model.feature[node]), model.threshold[node]
        assert gain(mask, f, c) == pytest.approx(best)
        walk(model.left[node], mask & (x[:, f] <= c), depth + 1)
        walk(model.right[node], mask & (x[:, f] > c), depth + 1)
    walk(model.roots[0], np.ones(200, dtype=bool), 0)


def greedy(word, initial, inner):
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (inner if at else initial):
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def test_op7_automaton_is_greedy():
    rng = random.Random(11)
    for _ in range(200):
        pieces = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))), rng.random() < 0.5) for _ in range(rng.randrange(1, 12))]
        words = ["".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randrange(0, 14))) for _ in range(30)]
        initial, inner = {p for p, s in pieces if s}, {p for p, s in pieces if not s}
        got = token_counts.LengthAutomaton(pieces).lengths(words).tolist()
        assert got == [greedy(w, initial, inner) for w in words]


def test_op7_counts(spark, texts):
    pieces = token_counts.word_pieces(vocab.public_path(queries.COUNT_VOCABULARY))
    initial, inner = {p for p, s in pieces if s}, {p for p, s in pieces if not s}
    rows = {r["doc_id"]: r for r in queries.op7_linear_longest_match(spark, SF).collect()}
    assert len(rows) == len(texts)
    for i in list(texts)[:60]:
        n = [greedy(w, initial, inner) for w in WORD.findall(texts[i])]
        assert (rows[i]["n_words"], rows[i]["n_tokens"], rows[i]["n_unknown"]) == (len(n), sum(abs(x) for x in n), n.count(-1))


def test_op8_round_trip(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {}
    for r in turns:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    by[-7] = [(k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in queries.op8_template_compiler(spark, SF).collect()}
    assert got.keys() == by.keys()
    for i, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[i]["n_turns"] == len(own)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op8_escapes_are_reversible():
    rng = random.Random(2)
    parts = [*chat_template.CONTROLS, "\\", "\\\\", "\n", "n", "<", "[", "|im_start|>", "INST]", "<<", "a"]
    for _ in range(500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        e, line = chat_template.escape(s), chat_template.escape_line(s)
        assert chat_template.unescape(e) == s and chat_template.unescape_line(line) == s and "\n" not in line
        assert not any(c in e or c in line for c in chat_template.CONTROLS)


def test_op8_template_language():
    t = chat_template.Template("A{{ 'b' ~ 1 | upper }}{% if 1 == 2 %}no{% elif 'a' in 'abc' %}yes{% endif %}"
                               "{% for m in messages %}{% if not loop.first %}, {% endif %}{{ loop.index }}:{{ m['text'] | trim }}"
                               "{% if loop.last %}!{% endif %}{% endfor %}{% generation %}{{ missing }}Z{% endgeneration %}")
    assert t.tree[1] == ("text", "Ab1yes")  # folded
    text, spans = t.render([{"role": "r", "text": " x "}, {"role": "r", "text": "y"}])
    assert text == "Ab1yes1:x, 2:y!Z" and [text[a:b] for a, b in spans] == ["Z"]
    for bad in ("{{ m.__class__() }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ 'a' | eval }}", "{{ }}", "{% import os %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.Template(bad)


def test_op9_packs_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab.public_path(queries.PACKING_TOKENIZER))
    want = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, vocab.public_path(queries.PACKING_TOKENIZER), bucket_tokens=20_000).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            ids = want[i][r["start"]: r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want[i])
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["ids"] == ids.tolist()
            at += r["length"]
        assert at == len(want[i])
    total = sum(map(len, want.values()))
    assert sorted(sequences) == list(range(-(-total // 2048)))
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == (2048 if s < total // 2048 else total % 2048)


def test_op9_windows_keep_the_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = vocab.public_path(queries.PACKING_TOKENIZER)
    rows = packing.pack(docs, path, with_ids=False).collect()
    assert deviation(rows) < packing.SEQUENCE
    # with weights: the heavy source is served first, and all is packed still
    heavy = packing.pack(docs, path, weights={"src0": 1.0, "src1": 1.0}, with_ids=False).collect()
    assert sum(r["length"] for r in heavy) == sum(r["length"] for r in rows)
    early = [r for r in heavy if r["sequence_id"] < 10]
    assert {r["source"] for r in early} == {"src0", "src1"}


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, "src2": 1.0, "src3": 0.5, None: 0.5}])
def test_op9_deficits_are_carried(spark, weights):
    """Every window keeps to its targets, deficits of all earlier buckets
    included, until a source of its bucket runs out."""
    size, docs = 30_000, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") != "src4", F.concat(F.lit("src"), F.pmod(F.xxhash64("source"), F.lit(4)).cast("string"))))
    rows = packing.pack(docs, vocab.public_path(queries.PACKING_TOKENIZER), weights=weights, bucket_tokens=size, with_ids=False)
    total = rows.agg(F.sum("length")).first()[0]
    buckets = math.ceil(total / size)
    bucket = F.pmod(F.xxhash64("doc_id", F.col("doc_tokens"), "source"), F.lit(buckets)).cast("int")
    pieces = sorted(rows.select(bucket.alias("b"), "source", "length", (F.col("sequence_id") * packing.SEQUENCE + F.col("offset")).alias("at")).collect(),
                    key=lambda r: r["at"])
    assert [r["b"] for r in pieces] == sorted(r["b"] for r in pieces) and buckets > 5  # bucket after bucket
    whole, by = Counter(), {}
    for r in pieces:
        whole[r["source"]] += r["length"]
        by.setdefault(r["b"], []).append(r)
    scale = sum(whole.values()) if weights is None else sum(w for s, w in weights.items() if s in whole)
    target = {s: (whole[s] if weights is None else weights.get(s, 0.0)) / scale for s in whole}
    served, begin, checked = Counter(), 0, 0
    for own in by.values():
        n, here = sum(r["length"] for r in own), Counter()
        left = Counter()
        for r in own:
            left[r["source"]] += r["length"]
        share = {s: max(0, target[s] + (target[s] * begin - served[s]) / n) for s in left}
        share = {s: x / sum(share.values()) for s, x in share.items()} if any(share.values()) else {s: x / n for s, x in left.items()}
        for r in own:
            here[r["source"]] += r["length"]
            left[r["source"]] -= r["length"]
            if min(left.values()) == 0:
                break
            if (r["at"] + r["length"]) % packing.SEQUENCE == 0:
                checked += 1
                for s in here:
                    assert abs(here[s] - share[s] * sum(here.values())) <= packing.SEQUENCE + packing.MIN_PIECE
        for r in own:
            served[r["source"]] += r["length"]
        begin += n
    assert checked > 2 * buckets


def deviation(rows):
    """The largest distance in tokens from a source's share of all tokens, at
    the end of any sequence."""
    total, share, done, worst = sum(r["length"] for r in rows), Counter(), Counter(), 0
    for r in rows:
        share[r["source"]] += r["length"] / total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in sorted(by)[:-1]:
        for r in by[s]:
            done[r["source"]] += r["length"]
        worst = max(worst, *(abs(done[x] - share[x] * packing.SEQUENCE * (s + 1)) for x in share))
    return worst


def test_op9_special_strings_go_in_whole(spark):
    from tokenizers import Tokenizer

    path = vocab.public_path(queries.PACKING_TOKENIZER)
    texts = ["a<|endoftext|>b", "it's don't U.S. x1y2", "é été İx straße", "中文 \U0001f600!", "A B", None, ""]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s")), path).collect()
    tok = Tokenizer.from_file(path)
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def same_as_oracle(spark, rows):
    """The registered SQL over made-up pages gives the same rows."""
    import duckdb

    found = url_rules.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(queries.ORACLE["op10_redirect_equivalence"]).fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_op10_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    move = "<META http-equiv='Refresh' content='0; url={}'>".format
    rows = [(1, "http://blocked.net/fr/a", link("https://alias.org/x")), (2, "https://alias.org/x?q=1", None),
            (3, "http://far.org/y", move("//alias.org/x")), (4, "http://ok.org/z", link("/zz")), (5, "http://ok.org/zz", ""),
            (6, "http://mixed.net/fr/b", link("http://good.com/c")), (7, "http://tied.org/d", link("http://good.com/c")),
            (8, "http://www.example.com/en/p", None), (9, "http://x.example.com/en/p", None), (10, "http://unseen.org/", link("http://b.net/es/q")),
            (11, "HTTPS://ALIAS.org/x#part", None), (12, "http://go.org/?id=1", link("http://b.net/es/q")),
            (13, "http://go.org/?id=2", link("http://good.org/")), (14, "http://go.org/?id=3", None), (15, "http://good.org/", None),
            (16, "http://go.org?id=1", None), (None, None, link("http://b.net/es/q")), (17, "no scheme", None), (18, "http://r.org/", ";")]
    same_as_oracle(spark, rows)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in
           url_rules.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    got = {i: v for i, v in got.items() if i is not None}
    assert got == {1: ("net/fr/", "block"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"),
                   6: ("net/fr/", "block"), 7: (None, "allow"), 8: ("www.example.com/en/", "allow"), 9: ("example.com/en/", "block"),
                   10: (None, "block"), 11: (None, "block"), 12: (None, "block"), 13: (None, "allow"), 14: (None, "allow"),
                   15: (None, "allow"), 16: (None, "block"), 17: (None, "allow"), 18: (None, "allow")}


def test_op10_relative_links(spark):
    link = '<link rel="canonical" href="{}">'.format
    move = "<meta http-equiv='refresh' content='0; url={}'>".format
    blocked = "http://b.net/fr/x"
    rows = [(1, "http://a.org/d/p?q/r", link("page.html")), (2, "http://a.org/d/page.html", move(blocked)),
            (3, "http://a.org/d/e/f", move("../page.html")), (4, "http://a.org/d/e/", link("./../page.html?x=1&amp;y=2")),
            (5, "http://c.org/k", '<base href="http://a.org/d/">' + link("page.html")),
            (6, "http://c.org/l", '<base href="//b.net/a/">' + link("../fr/x")), (7, "http://e.org", link("/a/%2E%2e/n")),
            (8, "http://e.org/n", link("//b.net/a/../fr/x")), (9, "http://f.org/s&t", move("http://g.org/")),
            (10, "http://g.org/", link(blocked)), (11, "http://h.org/", link("//f.org/s&amp;t")),
            (12, "http://i.org/", link("mailto:me@b.net/fr/")), (13, "http://j.org/v", link("?id=2")),
            (14, "http://k.org/w", link("/in?next=http://b.net/fr/x")), (15, "http://l.org/a/./b", link(blocked)),
            (16, "http://l.org/z", link("a/b")), (17, "http://m.org/a/b/", link("..")), (18, "http://m.org/a/", move(blocked)),
            (19, "http://n.net/fr/o", link("../../../far")), (20, "http://n.net/far", None),
            (21, "http://a.org/d/page.html?x=1&y=2", move(blocked))]
    same_as_oracle(spark, rows)
    got = {r["page_id"]: r["verdict"] for r in
           url_rules.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "allow" if i in (12, 13, 14) else "block" for i in range(1, 22)}
