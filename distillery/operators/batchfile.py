"""Batch request and response files.

Pure Spark SQL expressions plus one keyed join: requests are built with
``to_json``; response lines are parsed with ``from_json`` (malformed lines
dropped), mapped through the output ladder and joined back to their
instructions by ``custom_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O
from distillery.functions.text import chat_messages

RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([
                    T.StructField("content", T.StringType())]))]))),
        ])),
    ])),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

# Request lines escape non-ASCII text as \uXXXX, like a default JSON dump.
REQUEST_JSON_OPTIONS = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
# JSON texts of an ``error`` value, other than a string, that count as no error.
FALSY_JSON = ["{}", "[]", "", "0", "0.0", "false"]


def custom_id(idx) -> Column:
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.concat(F.lit(O.REQUEST_ID_PREFIX), c.cast("string"))


def request_index(custom: str = "custom_id", status: str = "status") -> Column:
    """The index inside a known ``custom_id``, as text; null for others."""
    own = F.substring(F.col(custom), len(O.REQUEST_ID_PREFIX) + 1, 2**31 - 1)
    return F.when(F.col(status) != "unknown_id", own)


def build_requests(df: DataFrame, idx_col: str = "row_idx", instruction_col: str = "instruction",
                   model: str = O.BATCH_MODEL, temperature: float = O.BATCH_TEMPERATURE,
                   top_p: float = O.BATCH_TOP_P, system: str = O.BATCH_DEVELOPER_PROMPT) -> DataFrame:
    """G1: ``custom_id``, ``instruction`` and the request JSON line."""
    body = F.struct(F.lit(model).alias("model"),
                    chat_messages(instruction_col, system, system_role="developer").alias("messages"),
                    F.lit(float(temperature)).alias("temperature"),
                    F.lit(float(top_p)).alias("top_p"))
    req = F.struct(custom_id(idx_col).alias("custom_id"), F.lit(O.BATCH_METHOD).alias("method"),
                   F.lit(O.BATCH_URL).alias("url"), body.alias("body"))
    return df.select(custom_id(idx_col).alias("custom_id"), F.col(instruction_col).alias("instruction"),
                     F.to_json(req, REQUEST_JSON_OPTIONS).alias("request"))


def parse_responses(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """G2 + G3: parse lines; drop malformed ones; apply the output ladder.

    Columns: ``custom_id`` ('' when missing), ``output``, ``status``
    ('ok' / 'error' / 'no_content').
    """
    error = F.try_variant_get(F.try_parse_json(F.col(value_col)), "$.error", "variant")
    parsed = lines.select(F.from_json(F.col(value_col), RESPONSE_SCHEMA,
                                      {"mode": "PERMISSIVE",
                                       "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
                          F.schema_of_variant(error).alias("kind"))
    ok = parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull())
    err = F.col("r.error")
    # any string but the empty one is an error, whatever it spells
    is_error = err.isNotNull() & F.when(F.col("kind") == "STRING", err != "").otherwise(~F.trim(err).isin(FALSY_JSON))
    choices = F.col("r.response.body.choices")
    has_choice = F.coalesce(F.size(choices), F.lit(0)) > 0
    output = (F.when(is_error, F.concat(F.lit(O.ERROR_MARK), err))
               .when(has_choice, F.element_at(choices, 1)["message"]["content"])
               .otherwise(F.lit(O.NO_CONTENT_MARK)))
    status = (F.when(is_error, F.lit("error")).when(has_choice, F.lit("ok"))
               .otherwise(F.lit("no_content")))
    return ok.select(F.coalesce(F.col("r.custom_id"), F.lit("")).alias("custom_id"),
                     output.alias("output"), status.alias("status"))


def attach_instructions(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """The original instruction by ``custom_id``; unknown ids read as
    ``[Batch custom_id={id}]`` with status ``unknown_id``."""
    req = requests.select("custom_id", F.col("instruction").alias("_instr"), F.lit(True).alias("_known"))
    j = parsed.join(req, "custom_id", "left")
    fallback = F.concat(F.lit("[Batch custom_id="), F.col("custom_id"), F.lit("]"))
    return j.select("custom_id",
                    F.when(F.col("_known").isNull(), fallback).otherwise(F.col("_instr")).alias("instruction"),
                    "output",
                    F.when(F.col("_known").isNull(), F.lit("unknown_id")).otherwise(F.col("status")).alias("status"))


def status_counts(results: DataFrame) -> DataFrame:
    """Rows per status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
