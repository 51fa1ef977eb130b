"""Projection and prompt filters."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O
from distillery.functions.text import word_count

log = logging.getLogger(__name__)

_SPACE = r"\s\x1c-\x1f"


def at_most_words(text, limit: int) -> Column:
    """True when ``text`` has at most ``limit`` words (Python ``split``).

    Equivalent to ``word_count(text) <= limit`` but decided with one
    anchored, possessive regex: no word array is built and a long text is
    rejected as soon as word ``limit + 1`` starts.
    """
    if limit < 0:
        raise ValueError("limit must be >= 0")
    c = F.col(text) if isinstance(text, str) else text
    pattern = (rf"(?U)^[{_SPACE}]*+(?:[^{_SPACE}]++[{_SPACE}]*+){{0,{limit}}}+\z")
    return c.rlike(pattern)


def project_key(df: DataFrame, key: str | None, alias: str = "instruction") -> DataFrame | None:
    """The configured key column as ``alias``.

    A source with no key contributes nothing (returns None, with a warning).
    A key that is not a column reads as the empty string, which B2 drops.
    A non-string key column is rejected at plan time.
    """
    if not key:
        log.warning("source has no key; it contributes no rows")
        return None
    if key not in df.columns:
        return df.withColumn(alias, F.lit("").cast("string"))
    dtype = df.schema[key].dataType
    if not isinstance(dtype, T.StringType):
        raise TypeError(f"key column {key!r} must be a string, got {dtype.simpleString()}")
    if key == alias:
        return df
    if alias in df.columns:
        df = df.drop(alias)
    return df.withColumnRenamed(key, alias)


def non_empty(col: str = "instruction") -> Column:
    """B2: not null and not the empty string (whitespace-only passes)."""
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))


def drop_empty(df: DataFrame, col: str = "instruction") -> DataFrame:
    return df.filter(non_empty(col))


def with_word_count(df: DataFrame, col: str = "instruction", out: str = "word_count") -> DataFrame:
    """Add the Python-compatible word count."""
    return df.withColumn(out, word_count(col))


def keep_short(df: DataFrame, col: str = "instruction", limit: int = O.PROMPT_WORD_LIMIT) -> DataFrame:
    """B2 + B4: keep non-empty values with at most ``limit`` words.

    The cheap, pushable null/empty test runs first; the original value is
    kept untrimmed.
    """
    return df.filter(non_empty(col)).filter(at_most_words(col, limit))


def prune_for_sft(df: DataFrame) -> DataFrame:
    """B5 (SFT): keep the training text and the token columns."""
    keep = [c for c in ("text", "input_ids", "attention_mask") if c in df.columns]
    return df.select(*keep)


def prune_for_kd(df: DataFrame) -> DataFrame:
    """B5 (KD): keep the token columns only."""
    keep = [c for c in ("input_ids", "attention_mask") if c in df.columns]
    return df.select(*keep)
