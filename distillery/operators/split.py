"""Teacher-table loading and exact seeded train/test split (H0-H3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O

TEACHER_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("status", T.StringType()),
])

_BUCKET_HEX = 4  # 65,536 histogram buckets


def load_teacher(spark: SparkSession, path: str, only_ok: bool = True,
                 schema: T.StructType = TEACHER_SCHEMA) -> DataFrame:
    """H0: the teacher outputs (JSONL) with an explicit schema; error and
    no-content rows are dropped when ``only_ok`` (a missing status counts
    as ok). A file of ``{instruction, output}`` rows without any index gets
    one, in the order of both texts."""
    df = spark.read.schema(schema).json(path)
    if only_ok:
        df = df.filter(F.col("status").isNull() | (F.col("status") == "ok"))
    if df.filter(F.col("row_idx").isNotNull()).isEmpty():
        from distillery.operators.order import with_row_index

        texts = df.drop("row_idx")
        df = with_row_index(texts, ["instruction", "output", "status"]).select(*df.columns)
    return df


def held_out_count(n: int, test_size: float) -> int:
    """Exact test size: ``ceil(n * test_size)``; train is the rest."""
    return int(math.ceil(n * test_size)) if n else 0


def split_key(idx: str, seed: int) -> Column:
    """Seeded rank key: md5 of ``'{seed}:{row_idx}'`` (hex)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")))


def exact_split(df: DataFrame, idx: str = "row_idx", test_size: float = O.TEST_SIZE,
                seed: int = O.SFT_SPLIT_SEED, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """H1/H2: (train, test) with exactly ``ceil(n * test_size)`` test rows,
    the rows of lowest ``md5(seed:row_idx)`` (ties on ``row_idx``).

    No global sort: a 65,536-bucket histogram of the hash prefix (partial
    aggregation, a bounded collect) finds the bucket where the cut falls;
    only that bucket -- about n / 65,536 rows -- is ranked exactly. Null
    indexes raise ``ValueError``.
    """
    O.SplitOptions(test_size, seed)  # validates
    h = split_key(idx, seed)
    keyed = df.withColumn("_h", h).withColumn(
        "_b", F.conv(F.substring(F.col("_h"), 1, _BUCKET_HEX), 16, 10).cast("int"))
    counts = [(r["_b"], r["count"]) for r in keyed.groupBy("_b").count().collect()]
    if any(b is None for b, _ in counts):
        raise ValueError(f"rows without {idx!r} cannot be split: number them first")
    hist = sorted(counts)
    if n is None:
        n = sum(c for _, c in hist)
    k = held_out_count(n, test_size)
    below, cut, need = 0, None, 0
    for b, c in hist:
        if below + c >= k:
            cut, need = b, k - below
            break
        below += c
    if cut is None or k == 0:  # everything (or nothing) is test
        test = keyed if k else keyed.limit(0)
        train = keyed.limit(0) if k else keyed
        return train.drop("_h", "_b"), test.drop("_h", "_b")
    w = Window.partitionBy("_b").orderBy("_h", idx)
    in_cut = keyed.filter(F.col("_b") == cut).withColumn("_rn", F.row_number().over(w))
    test = keyed.filter(F.col("_b") < cut).unionByName(
        in_cut.filter(F.col("_rn") <= need).drop("_rn"))
    train = keyed.filter(F.col("_b") > cut).unionByName(
        in_cut.filter(F.col("_rn") > need).drop("_rn"))
    return train.drop("_h", "_b"), test.drop("_h", "_b")
