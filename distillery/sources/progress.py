"""Committed parts of a growing output and the row ranges they cover.

An output is a folder of parts, ``part-<id>``, and a log, ``_log/<id>``, with
the runs of row numbers that each part holds: ``(lo, hi, n)``. A part counts
once its log entry is there; what an interrupted append left behind is passed
over. Counting what is done and skipping it read the log, not the output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery.operators.order import broadcast_if_small
from distillery.sources import fs
from distillery.sources.sinks import JSON_WRITE

RANGES = "lo BIGINT, hi BIGINT, n BIGINT"
STEP = 1 << 16  # row numbers that one join key of a range stands for


def row_ranges(df: DataFrame, idx: str = "row_idx") -> DataFrame:
    """``(lo, hi, n)``: the runs of consecutive row numbers of ``df`` and the
    rows in each. A run that two partitions share comes in two pieces; rows
    without a number are in none."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        n = 0
        done: list[tuple[int, int, int]] = []
        for b in batches:
            v = np.asarray(b.column(0))
            for part in np.split(v, np.flatnonzero(np.diff(v) > 1) + 1):
                if not len(part):
                    continue
                if lo is None or part[0] > hi + 1:
                    if lo is not None:
                        done.append((lo, hi, n))
                    lo, n = int(part[0]), 0
                hi, n = int(part[-1]), n + len(part)
            if done:
                yield _rows(done)
                done = []
        if lo is not None:
            yield _rows([(lo, hi, n)])

    def _rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["lo", "hi", "n"])

    numbered = df.select(F.col(idx).cast("bigint").alias("i")).filter("i IS NOT NULL")
    return numbered.repartitionByRange("i").sortWithinPartitions("i").mapInArrow(runs, RANGES)


def append_part(df: DataFrame, path: str, idx: str = "row_idx") -> str:
    """Write ``df`` as one more part (JSONL) and log the row ranges it holds.
    Returns the part's id."""
    spark = df.sparkSession
    part, root = uuid.uuid4().hex[:12], path.rstrip("/")
    df.write.options(**JSON_WRITE).json(f"{root}/part-{part}")
    written = spark.read.schema(T.StructType([df.schema[idx]])).json(f"{root}/part-{part}")
    staged = f"{root}/_staged-{part}"
    row_ranges(written, idx).coalesce(1).write.json(staged)
    fs.replace_folder(spark, staged, f"{root}/_log/{part}")
    return part


def _entries(spark: SparkSession, path: str) -> list[str]:
    log = f"{path.rstrip('/')}/_log"
    return [n for n in fs.list_names(spark, log) if fs.is_complete(spark, f"{log}/{n}")]


def committed_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``(lo, hi, n)`` of all committed parts."""
    found = [f"{path.rstrip('/')}/_log/{n}" for n in _entries(spark, path)]
    return spark.read.schema(RANGES).json(found) if found else spark.createDataFrame([], RANGES)


def committed_rows(spark: SparkSession, path: str) -> int:
    """A10: rows already produced, from the log."""
    return int(committed_ranges(spark, path).agg(F.sum("n")).first()[0] or 0)


def read_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed parts."""
    found = [f"{path.rstrip('/')}/part-{n}" for n in _entries(spark, path)]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def resume_by_ranges(df: DataFrame, ranges: DataFrame, idx: str = "row_idx") -> DataFrame:
    """D4 (range mode): the rows whose number lies in none of ``ranges``. A
    range stands for ``STEP`` numbers a join key, so this is an equi-join of
    ``df`` with a table of about one row per ``STEP`` rows done (broadcast if
    that is small). Rows without a number are kept."""
    keys = ranges.select("lo", "hi", F.explode(F.expr(f"sequence(lo div {STEP}, hi div {STEP})")).alias("_key"))
    n = ranges.agg(F.sum(F.expr(f"hi div {STEP} - lo div {STEP} + 1"))).first()[0] or 0
    i = F.col(idx)
    done = (F.expr(f"`{idx}` div {STEP}") == F.col("_key")) & i.between(F.col("lo"), F.col("hi"))
    return df.join(broadcast_if_small(keys, n, 32), done, "left_anti")
