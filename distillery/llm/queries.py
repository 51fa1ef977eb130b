"""The queries of this package, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from distillery.llm import (
    chat_template,
    fertility,
    filter_audit,
    fingerprints,
    katz,
    license_rules,
    mixing,
    ngram_join,
    packing,
    quality_trees,
    source_audit,
    token_counts,
    url_rules,
)
from distillery.llm.oracle import ORACLE  # noqa: F401  (registered with the queries)
from distillery.llm.shared import table
from distillery.llm.vocab import public_path

# Vocabulary files are parameters; these are the ones the queries use.
FERTILITY_VOCABULARY = "piece_bpe_32k.model"
PACKING_TOKENIZER = "word_bpe_49k.json"
COUNT_VOCABULARY = "piece_bpe_32k.model"

# Wanted shares of tokens by domain, a domain being a pair of labels.
MIX_WEIGHTS = {"q1_t0": 0.93, "q1_t1": 0.01, "q0_t0": 0.05, "q0_t1": 0.01}

# A conversation that holds control strings, beside those of the table.
PROBE_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_quality_trees(spark, sf_dir):
    return quality_trees.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_trie_join(spark, sf_dir):
    return (ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))
            .select("doc_id", F.col("n_shingles"), "component_id"))


def op3_one_permutation_minhash(spark, sf_dir):
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_tokeniser_fertility(spark, sf_dir):
    rules = fertility.FertilityRules(public_path(FERTILITY_VOCABULARY))
    return (fertility.fertility_report(table(spark, sf_dir, "documents"), rules)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "n_tokens", *fertility.MEASURES))


def op5_license_sentence_rules(spark, sf_dir):
    return license_rules.scan_licenses(table(spark, sf_dir, "documents"))


def op6_soft_membership_mixing(spark, sf_dir):
    found = mixing.mixing_report(table(spark, sf_dir, "documents"), mixing.domain_labels(table(spark, sf_dir, "labels")),
                                 MIX_WEIGHTS)
    p = F.col("posteriors")
    return found.select("doc_id", "tokens", *[p[d].alias(f"p_{d}") for d in MIX_WEIGHTS], "rate", "copies")


def op7_linear_longest_match(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_path(COUNT_VOCABULARY))


def op8_template_compiler(spark, sf_dir):
    probe = spark.createDataFrame(PROBE_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_template.read_back(chat_template.format_conversations(rows))


def op9_mixture_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_path(PACKING_TOKENIZER), with_ids=False)


def op10_redirect_equivalence(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op11_katz_backoff(spark, sf_dir):
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op12_removal_potential(spark, sf_dir):
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_run_length_divergence(spark, sf_dir):
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_trees, op2_ngram_trie_join, op3_one_permutation_minhash, op4_tokeniser_fertility,
    op5_license_sentence_rules, op6_soft_membership_mixing, op7_linear_longest_match, op8_template_compiler,
    op9_mixture_packing, op10_redirect_equivalence,
    op11_katz_backoff, op12_removal_potential, op13_run_length_divergence)}

