"""Chat turns -> message arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversation_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                          role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``messages ARRAY<STRUCT<role, content>>``
    ordered by turn.

    Partial aggregation is not possible for an ordered list, so the
    conversation is the unit of work; a conversation is bounded by the
    model context it is rendered for.
    """
    return (turns.groupBy(conv)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"),
                                                      F.col(text).alias("content")))).alias("_m"))
            .select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                m["content"].alias("content"))).alias("messages")))


def render_turn_lines(turns: DataFrame, role: str = "role", text: str = "text", out: str = "line") -> DataFrame:
    """E7 without grouping: each turn rendered as its ``Role: content`` line
    (map-only). Joining the lines of a conversation in turn order gives the
    text of ``render_messages``; use this form when a conversation may be
    too large to hold in one row."""
    from distillery.functions.text import role_title

    return turns.withColumn(out, F.concat(role_title(role), F.lit(": "), F.col(text)))
