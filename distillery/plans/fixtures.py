"""Inputs derived from the driver tables, as Spark plans.

Every fixture reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from distillery.operators.corpus import Source
from distillery.session import read_table, scratch_path


def corpus_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    """f_corpus registry: documents (split = lang), benchmark, user turns."""
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    conv = read_table(spark, sf_dir, "conversations")
    return [
        Source("documents", docs, key="text", split=F.col("lang"), row_key="doc_id"),
        Source("benchmark", bench, key="text", split="train", row_key="item_id"),
        Source("conversations", conv, key="text", split="train",
               row_key=F.col("conv_id") * F.lit(1000) + F.col("turn"),
               where=F.col("role") == F.lit("user")),
    ]


def pairs(spark: SparkSession, sf_dir: str, index: bool = True, method: str = "join") -> DataFrame:
    """f_pairs: each user turn answered by the next assistant turn.

    ``method="join"`` finds the next turn with ``order.with_next`` (no
    per-conversation window, so one very long conversation is still spread
    over all tasks); ``"window"`` uses ``lead`` per conversation. The index
    is the two-pass D1 index on (conv_id, turn).
    """
    from distillery.operators.order import with_next, with_row_index

    conv = read_table(spark, sf_dir, "conversations")
    if method == "join":
        x = with_next(conv, ["conv_id"], ["turn"], ["text", "role"])
        x = x.withColumnRenamed("next_text", "nxt").withColumnRenamed("next_role", "nr")
    elif method == "window":
        w = Window.partitionBy("conv_id").orderBy("turn")
        x = conv.withColumn("nxt", F.lead("text").over(w)).withColumn("nr", F.lead("role").over(w))
    else:
        raise ValueError(f"unknown method {method!r}")
    p = (x.filter((F.col("role") == "user") & (F.col("nr") == "assistant"))
          .select("conv_id", "turn", F.col("text").alias("instruction"), F.col("nxt").alias("output")))
    if not index:
        return p
    return with_row_index(p, ["conv_id", "turn"])


def in_table_order(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as a table stored by ``key`` gives them: files in that order."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_messages input: one row per turn."""
    return read_table(spark, sf_dir, "conversations")


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_responses: one batch-response JSON line per pair.

    Built from the pair index with a fixed rule set so every branch of the
    response ladder (malformed, error, empty choices, unknown id, ok) occurs.
    """
    return response_lines_from(pairs(spark, sf_dir))


def response_lines_from(p: DataFrame) -> DataFrame:
    """Every pair yields exactly one line; the rules on ``row_idx`` only pick
    which kind of line it is (no row is dropped or sampled here)."""
    i = F.col("row_idx")
    rid = i.cast("string")
    line = (F.when(i % 13 == 6, F.concat(F.lit('{"custom_id": "request-'), rid))
             .when(i % 7 == 3, F.concat(F.lit('{"custom_id":"request-'), rid,
                                        F.lit('","response":null,"error":{"code":"rate_limit"}}')))
             .when(i % 11 == 5, F.concat(F.lit('{"custom_id":"request-'), rid,
                                         F.lit('","response":{"body":{"choices":[]}},"error":{}}')))
             .when(i % 17 == 8, F.concat(F.lit('{"custom_id":"missing-'), rid,
                                         F.lit('","response":{"body":{"choices":[{"message":{"content":"x"}}]}},"error":null}')))
             .otherwise(F.concat(F.lit('{"custom_id":"request-'), rid,
                                 F.lit('","response":{"body":{"choices":[{"message":{"content":"'),
                                 F.md5(F.col("output")), F.lit('"}}]}},"error":null}'))))
    return p.select(F.col("row_idx").alias("line_no"), line.alias("value"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_logits: student row = embedding of vec_id, assistant row = the next
    vec_id (cyclic); 4 positions per sample; label -100 on every 10th id."""
    emb = read_table(spark, sf_dir, "embeddings")
    n = emb.count()
    a = emb.select("vec_id", F.col("embedding").alias("student"), "label",
                   ((F.col("vec_id") + 1) % F.lit(n)).alias("nxt"))
    b = emb.select(F.col("vec_id").alias("nxt"), F.col("embedding").alias("assistant"))
    return (a.join(b, "nxt")
             .select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("sample_id"),
                     (F.col("vec_id") % 4).cast("bigint").alias("pos"),
                     F.transform("student", lambda x: x.cast("double")).alias("student"),
                     F.transform("assistant", lambda x: x.cast("double")).alias("assistant"),
                     F.when(F.col("vec_id") % 10 == 0, F.lit(-100))
                      .otherwise(F.col("label")).cast("int").alias("label")))


def stored_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_logits as a table stored by sample and position, as a scoring run
    writes it."""
    path = scratch_path(spark, "logits")
    (logits(spark, sf_dir).repartitionByRange("sample_id", "pos").sortWithinPartitions("sample_id", "pos")
     .write.parquet(path))
    return spark.read.parquet(path)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_candidates: long form (ctx, tok, lg) of every embedding value."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("ctx"),
                      F.posexplode("embedding").alias("tok", "lg")).select(
        "ctx", F.col("tok").cast("bigint").alias("tok"), F.col("lg").cast("double").alias("lg"))


def rules_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_rules: documents with their labels (left join on doc_id)."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")
