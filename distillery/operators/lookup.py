"""Dictionary lookup of array items without a bound on the dictionary.

Rows are numbered into blocks of a few MB by their sizes alone (only these pass
through Python) and checkpointed, so that a retried task sees the same blocks.
A block asks for its distinct items, which meet the
dictionary in a shuffle join; the answers are the block's own small dictionary,
cogrouped with its rows. A frequent item is asked for once a block, a repeated
or missing row key plays no part, and no dictionary is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery.session import ensure_checkpoint_dir

BLOCK_BYTES = 8 << 20
PYTHON_BYTES = 1 << 20   # values of a block that are Python objects at a time


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variant that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def value_bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value of type ``kind`` takes in an Arrow batch."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            size = F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + value_bytes(x, kind.elementType))
        else:
            size = F.array_size(c).cast("bigint") * F.lit(4 if isinstance(kind.elementType, (T.IntegerType, T.FloatType)) else 8)
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(0))
    else:
        size = F.lit(0)
    return (F.coalesce(size, F.lit(0)) + 8).cast("bigint")


def with_blocks(df: DataFrame, out: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with a block number: runs of rows of one partition that hold
    about ``block_bytes`` together (one row may hold more). Checkpointed."""
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = np.asarray(b, dtype=np.int64)
            end = before + np.cumsum(size)
            yield pa.array(first + (end - size) // block_bytes, pa.int64())  # where a row begins
            before = int(end[-1]) if len(end) else before

    ensure_checkpoint_dir(df.sparkSession)
    size = sum((value_bytes(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.withColumn(out, F.arrow_udf(number, "bigint").asNondeterministic()(size)).checkpoint(eager=True)


def map_items(df: DataFrame, items: Column, table: DataFrame, fn: Callable[[pa.ChunkedArray, dict], list],
              source: str | Column, out: str, out_type: T.DataType, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with ``out``: ``fn(values of source, dictionary)`` block by
    block. ``items`` is the array of what a row looks up in ``table(item,
    value)``; unknown items are missing from the dictionary."""
    block, value = free_name(df, "_block"), free_name(df, "_value")
    base = (df.drop(out) if out in df.columns and source != out else df)
    arr = free_name(df, "_items")
    rows = with_blocks(base.withColumn(value, F.col(source) if isinstance(source, str) else source).withColumn(
        arr, F.array_distinct(items)), block, block_bytes)
    asked = rows.select(F.col(block).alias("_of"), F.explode(arr).alias("item")).distinct()
    told = asked.join(table.select("item", F.col("value").alias("_told")), "item").select("_of", "item", "_told")
    kept = [c for c in df.columns if c != out]
    rows = rows.drop(arr)

    def apply(part: pa.Table, found: pa.Table) -> pa.Table:
        known = dict(zip(found["item"].to_pylist(), found["_told"].to_pylist(), strict=True))
        step = max(1, PYTHON_BYTES * part.num_rows // max(part[value].nbytes, 1))
        made = pa.chunked_array([pa.array(fn(part[value].slice(lo, step), known), type=kind)
                                 for lo in range(0, part.num_rows, step)], type=kind)
        pa.default_memory_pool().release_unused()
        return pa.table([*[part[c] for c in kept], made], names=[*kept, out])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(out_type)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, out_type)])
    return rows.groupBy(block).cogroup(told.groupBy("_of")).applyInArrow(apply, schema)
