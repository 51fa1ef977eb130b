"""Every operator on nulls, empty and long texts, ties, repeated rows, empty
tables, and extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from distillery.llm import (
    chat_template,
    fertility,
    fingerprints,
    license_rules,
    mixing,
    ngram_join,
    packing,
    quality_trees,
    token_counts,
    url_rules,
)
from distillery.llm.queries import MIX_WEIGHTS
from distillery.llm.vocab import public_path

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [(1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "de", "b"), (None, "null id text here", "en", "a"),
        (5, LONG, "en", "b"), (6, "é ü ß 中文 \U0001f600 <|endoftext|> </s>", "fr", "b"), (7, "x", "en", "a")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """The rows, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("row_key", "n", "k1", "_fertility", "_pieces", "bucket", "h", "score", "m", "tokens"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (5, 1, 1), (None, 1, 0), (7, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")


def apply(name, docs, labels):
    rules = fertility.FertilityRules(public_path("piece_bpe_32k.model"))
    domain = mixing.domain_labels(labels)
    bpe, piece = public_path("word_bpe_49k.json"), public_path("piece_bpe_32k.model")
    return {
        "quality": lambda: quality_trees.quality_scores(docs, labels, trees=2),
        "keep_good": lambda: quality_trees.keep_good(docs, labels, trees=2),
        "near": lambda: ngram_join.near_duplicate_components(docs),
        "drop_near": lambda: ngram_join.drop_near_duplicates(docs),
        "fingerprints": lambda: fingerprints.fingerprint_report(docs),
        "fertility": lambda: fertility.fertility_report(docs, rules),
        "keep_fluent": lambda: fertility.keep_fluent(docs, rules),
        "licenses": lambda: license_rules.scan_licenses(docs),
        "mixing": lambda: mixing.mixing_report(docs, domain, MIX_WEIGHTS),
        "mix": lambda: mixing.mix(docs, domain, MIX_WEIGHTS),
        "counts": lambda: token_counts.count_tokens(docs, piece),
        "packing": lambda: packing.pack(docs, bpe),
    }[name]()


ROW_PER_ROW = ("quality", "near", "fingerprints", "fertility", "licenses", "mixing", "counts")
SAME_COLUMNS = ("keep_good", "drop_near", "keep_fluent", "mix")


@pytest.mark.parametrize("name", [*ROW_PER_ROW, *SAME_COLUMNS, "packing"])
def test_odd_rows(name, docs, labels):
    out = apply(name, docs, labels)
    rows = out.collect()
    if name in ROW_PER_ROW:
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
        assert sum(r["start"] + r["length"] == r["doc_tokens"] for r in rows) == len(ROWS)


@pytest.mark.parametrize("name", [*ROW_PER_ROW, *SAME_COLUMNS, "packing"])
def test_empty_tables(name, docs, labels):
    assert apply(name, docs.limit(0), labels.limit(0)).count() == 0


def test_repeated_rows_are_alike(docs, labels):
    for name in ("quality", "near", "fingerprints", "fertility", "mixing"):
        own = [r for r in apply(name, docs, labels).drop("near_next", "edited_sha256", "edited_fingerprint", "near_edited").collect()
               if r["doc_id"] == 1]
        assert len(own) == 2 and own[0] == own[1], name


def test_null_and_blank_texts(docs, labels):
    near = {r["doc_id"]: r for r in ngram_join.near_duplicate_components(docs).collect()}
    assert [(near[i]["n_shingles"], near[i]["component_id"]) for i in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    kept = {r["doc_id"]: r["n"] for r in ngram_join.drop_near_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert kept == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_report(docs).collect()}
    assert prints[2] == prints[3] == prints[4] == "" and len(prints[1]) == 2 * fingerprints.BINS
    counts = {r["doc_id"]: r for r in apply("counts", docs, labels).collect()}
    assert counts[2]["n_tokens"] == counts[3]["n_tokens"] == 0 and counts[5]["n_words"] == 40_000
    fert = {r["doc_id"]: r for r in apply("fertility", docs, labels).collect()}
    assert fert[2]["base_failed"] and not fert[2]["kept"] and fert[5]["n_words"] == 40_000


def test_unlinked_texts_without_own_ids_are_kept(spark):
    rows = [(None, "red green blue cyan black white"), (None, "one two three four five six"), (None, "one two three four five six"),
            (9, "north south east west up down"), (9, "iron gold lead zinc tin copper")]
    out = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(out, key=str) == sorted(set(rows), key=str)


def test_no_labels_gives_neutral_models(docs, labels):
    none = labels.limit(0)
    assert {r["score"] for r in quality_trees.quality_scores(docs, none).collect()} == {0.5}
    assert {(r["rate"], r["copies"]) for r in apply("mixing", docs, none).collect()} == {(1.0, 1)}
    assert apply("mix", docs, none).count() == len(ROWS)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no scheme", "x"), (3, "http://", None), (None, "http://EXAMPLE.com/en/a", ""),
            (4, "http://a.net/fr/x?y#z", None), (4, "http://a.net/fr/x?y#z", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("own", F.lit(1)).withColumn("node", F.lit(2))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (None, "example.com", "/en/a", "example.com/en/", "block"),
        (4, "a.net", "/fr/x", "net/fr/", "block"), (4, "a.net", "/fr/x", "net/fr/", "block")], key=str)
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "a\\b</s>"),
            (2, 5, "assistant", LONG), (2, 6, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(1))
    got = {r["conv_id"]: r for r in chat_template.read_back(chat_template.format_conversations(df)).collect()}
    assert {k: (v["n_turns"], v["loss_chars"]) for k, v in got.items()} == {1: (3, 0), None: (1, 7), 2: (2, len(LONG))}
    assert chat_template.read_back(chat_template.format_conversations(df.limit(0))).count() == 0
