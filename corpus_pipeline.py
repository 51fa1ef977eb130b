"""Corpus pipeline: the training-data operators in a row.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir), its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from distillery.llm import fertility, mixing, ngram_join, packing, quality_trees
from distillery.llm.queries import FERTILITY_VOCABULARY, PACKING_TOKENIZER
from distillery.llm.shared import table
from distillery.llm.vocab import public_path
from distillery.session import scratch_path
from distillery.sources.fs import delete


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality_trees.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the fertility bands reject."""
    return fertility.keep_fluent(docs, fertility.FertilityRules(public_path(FERTILITY_VOCABULARY)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return ngram_join.drop_near_duplicates(docs)


# By how much the domains' shares of tokens are to change. (Few documents of low quality are left at this stage, so
# that their share is none that could be asked for outright.)
MIX_MULTIPLES = {"q1_t0": 1.0, "q1_t1": 0.3, "q0_t0": 0.5, "q0_t1": 0.15}


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by rates that meet the domains' target tokens.
    A quarter more tokens than came in are asked for, so that the wanted
    domain is repeated rather than thinned."""
    return mixing.mix(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), MIX_MULTIPLES, total_share=1.25,
                      multiples=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, every part with the mixture's proportions."""
    return packing.pack(docs, public_path(PACKING_TOKENIZER), with_ids=False)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mixture), ("packing", packed)]

# Trees, tokenizers and similarity joins are not SQL; tests/llm holds the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    scratch folder, read again, and removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
