"""Stable row index, shards, batches, resume and shard merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POS_MASK = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_row_index(df: DataFrame, order_by, out: str = "row_idx",
                   num_partitions: int | None = None, materialize_input: bool = True) -> DataFrame:
    """D1; see ``with_row_index_and_count``."""
    return with_row_index_and_count(df, order_by, out, num_partitions, materialize_input)[0]


def with_row_index_and_count(df: DataFrame, order_by, out: str = "row_idx",
                             num_partitions: int | None = None,
                             materialize_input: bool = True) -> tuple[DataFrame, int]:
    """A dense 0-based index in ``order_by`` order, without a global sort.

    Two passes, never one task for all rows:

    1. range-partition on the order keys and sort inside each partition,
       then write a reliable checkpoint so both passes (and any retried
       task) see the same partitions in the same order;
    2. count rows per partition (one small collect: one number per
       partition), turn the counts into starting offsets, and add each
       row's position inside its partition.

    Range partitioning samples its input with a full pass before the
    shuffle pass; with ``materialize_input`` the input is checkpointed
    first, so an expensive input plan (source scans, filters, joins,
    Python UDFs) runs once instead of twice. Turn it off only for inputs
    that are already cheap to re-read.

    The order keys must be unique for the index to be deterministic.
    Returns the indexed frame and its row count (known from pass 2).
    """
    spark = df.sparkSession
    from distillery.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    keys = _cols(order_by)
    if materialize_input:
        df = df.checkpoint(eager=True)
        # as many ranges as the input has partitions, so work downstream stays parallel
        num_partitions = num_partitions or max(df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    if num_partitions:
        ranged = df.repartitionByRange(num_partitions, *keys)
    else:
        ranged = df.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).checkpoint(eager=True)
    local = (ranged
             .withColumn("__ri_pid", F.spark_partition_id())
             .withColumn("__ri_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    counts = sorted((r["__ri_pid"], r["count"]) for r in local.groupBy("__ri_pid").count().collect())
    offsets, acc = [], 0
    for pid, cnt in counts:
        offsets.append((int(pid), int(acc)))
        acc += cnt
    if not offsets:
        return local.withColumn(out, F.lit(None).cast("bigint")).drop("__ri_pid", "__ri_pos"), 0
    off_df = spark.createDataFrame(offsets, "__ri_pid INT, __ri_off BIGINT")
    # One row per partition: bounded by the partition count, safe to broadcast.
    indexed = (local.join(F.broadcast(off_df), "__ri_pid")
               .withColumn(out, (F.col("__ri_off") + F.col("__ri_pos")).cast("bigint"))
               .drop("__ri_pid", "__ri_pos", "__ri_off"))
    return indexed, int(acc)


def chunk_size(n: int, world: int) -> int:
    if world <= 0:
        raise ValueError("world must be > 0")
    return (n + world - 1) // world


def shard_bounds(n: int, world: int) -> list[tuple[int, int, int]]:
    """D2 bounds ``(rank, start, end)``; trailing shards may be empty."""
    c = chunk_size(n, world)
    out = []
    for rank in range(world):
        start = rank * c
        out.append((rank, start, max(start, min(start + c, n))))
    return out


def assign_shards(df: DataFrame, n: int, world: int, idx: str = "row_idx",
                  out: str = "shard_id") -> DataFrame:
    """Contiguous shards of ``ceil(n / world)`` rows by row index."""
    c = max(chunk_size(n, world), 1)
    return (df.withColumn(out, F.floor(F.col(idx) / F.lit(c)).cast("bigint"))
              .withColumn("shard_pos", (F.col(idx) - F.col(out) * F.lit(c)).cast("bigint")))


def partition_by_shard(df: DataFrame, world: int, shard: str = "shard_id") -> DataFrame:
    """Spread shards over ``world`` tasks (one shuffle on the shard id)."""
    return df.repartition(world, shard)


def assign_batches(df: DataFrame, batch_size: int, pos: str = "shard_pos",
                   start: int | Column = 0, out: str = "batch_id") -> DataFrame:
    """D3: fixed-size batches in order, counted from ``start``.

    ``start`` is the resume offset (rows already produced) of the shard.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    s = F.lit(start) if isinstance(start, int) else start
    return df.withColumn(out, F.floor((F.col(pos) - s) / F.lit(batch_size)).cast("bigint"))


def resume_by_count(df: DataFrame, done: int | Column, pos: str = "row_idx") -> DataFrame:
    """D4 (count mode): skip the first ``done`` rows, as the count-based
    resume does. Assumes output order equals input order."""
    d = F.lit(done) if isinstance(done, int) else done
    return df.filter(F.col(pos) >= d)


def resume_by_key(df: DataFrame, produced: DataFrame, keys) -> DataFrame:
    """D4 (key mode, default): rows whose key has no produced output.

    A left-anti join: correct even when the input changed or outputs were
    written out of order.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(produced.select(*keys).distinct(), keys, "left_anti")


def batch_stats(df: DataFrame, groups=("shard_id", "batch_id")) -> DataFrame:
    """Rows per shard / batch."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def merge_shards(shards: list[DataFrame], idx: str = "row_idx") -> DataFrame:
    """One dataset from shard outputs; order is carried by ``row_idx``
    (sort only at write time if a sorted file is wanted)."""
    if not shards:
        raise ValueError("no shards")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def merge_shards_from(spark, path: str, shard: str = "shard_id") -> DataFrame:
    """C2 from files: every shard folder under ``path`` as one dataset."""
    return spark.read.option("basePath", path).parquet(path).withColumn(shard, F.col(shard).cast("bigint"))


def count_rows(df: DataFrame) -> int:
    """A10: rows already produced."""
    return int(df.count())


def with_next(df: DataFrame, group: list[str], order: list[str], cols: list[str],
              prefix: str = "next_", materialize_input: bool = False) -> DataFrame:
    """``lead(c) over (partition by group order by order)`` for each ``c``
    in ``cols``, without a window per group.

    A window sends every row of a group to one task; here the rows get a
    global two-pass index (D1) over ``group + order`` and each row is
    equi-joined to the row at index + 1 -- a unique key, so one group
    holding a large share of all rows is still spread over all tasks. The
    value is kept only when the successor belongs to the same group.
    """
    # a plain scan is as cheap to read twice as a copy of it would be
    idx = with_row_index(df, list(group) + list(order), "_g", materialize_input=materialize_input)
    succ = idx.select((F.col("_g") - F.lit(1)).alias("_g"),
                      *[F.col(g).alias(f"_sg{i}") for i, g in enumerate(group)],
                      *[F.col(c).alias(f"_sv{i}") for i, c in enumerate(cols)])
    j = idx.join(succ, "_g", "left")
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_sg{i}"))
    for i, c in enumerate(cols):
        j = j.withColumn(prefix + c, F.when(same, F.col(f"_sv{i}")))
    return j.drop("_g", *[f"_sg{i}" for i in range(len(group))], *[f"_sv{i}" for i in range(len(cols))])


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast only if ``rows * row_bytes`` is below the
    session's own broadcast threshold; beyond it the join shuffles."""
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(limit)))
    return F.broadcast(df) if rows * row_bytes <= limit else df


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal values, null being equal to null."""
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))


def carry_next(df: DataFrame, group: str, order: list[str], cols: list[str], prefix: str = "next_") -> DataFrame:
    """``lead(c) over (partition by group order by order)`` for each ``c`` in
    ``cols``, by boundary carry: rows are range-sorted by ``(group, *order)``,
    each takes the values of the row behind it, and every partition hands its
    first row to the one before. One shuffle, no window: a group may span any
    number of partitions. The driver sees one row per partition.
    """
    from distillery.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint(eager=True)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *b.slice(0, 1).columns],
                                                 ["_pid", *b.schema.names])
                return

    narrow = ranged.select(group, *[c for c in cols if c != group])
    first = narrow.mapInArrow(heads, T.StructType([T.StructField("_pid", T.IntegerType()), *narrow.schema.fields])).toArrow()
    head_of = {p: i for i, p in enumerate(first["_pid"].to_pylist())}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(b: pa.RecordBatch, behind: pa.RecordBatch | None) -> pa.RecordBatch:
            same = _same(b.column(group), behind.column(group)) if behind is not None else pa.array([False] * b.num_rows)
            added = [pc.if_else(same, behind.column(c), pa.scalar(None, b.column(c).type)) if behind is not None
                     else pa.nulls(b.num_rows, b.column(c).type) for c in cols]
            return pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *[prefix + c for c in cols]])

        last = None  # the row that waits for the one behind it
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                yield joined(last, b.slice(0, 1))
            if b.num_rows > 1:
                yield joined(b.slice(0, b.num_rows - 1), b.slice(1))
            last = b.slice(b.num_rows - 1)
        if last is not None:
            pid = TaskContext.get().partitionId()
            later = [p for p in head_of if p > pid]
            edge = first.slice(head_of[min(later)], 1).combine_chunks().to_batches()[0] if later else None
            if edge is not None:
                edge = edge.select([*dict.fromkeys([group, *cols])]).cast(last.select([*dict.fromkeys([group, *cols])]).schema)
            yield joined(last, edge)

    schema = T.StructType([*ranged.schema.fields, *[T.StructField(prefix + c, ranged.schema[c].dataType) for c in cols]])
    return ranged.mapInArrow(shift, schema)


def with_next_in_place(df: DataFrame, group: str, order: str, col: str, out: str, stored: bool = False) -> DataFrame:
    """``lead(col) over (partition by group order by order)`` as ``out``, for
    wide rows that should stay where they are stored.

    Only ``(group, order, col)`` and a row's place are moved, through
    ``carry_next``. A row whose successor lies behind it in the same partition
    takes the value from there; the others (the last row of a partition, and
    rows stored out of order) are corrected by a join on the place, broadcast
    if they are few. On a table stored in order that is one row per partition;
    on any other the corrections may move the wide rows. ``df`` is read twice
    and must lie alike both times: it is checkpointed unless it is ``stored``
    (a plain scan of a table, or a checkpoint). Rows with equal keys follow one
    another as they are stored.
    """
    if not stored:
        from distillery.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    at, fix, fixed = (_free(df, n) for n in ("_at", "_fix", "_fixed"))
    placed = df.withColumn(at, F.monotonically_increasing_id())
    narrow = placed.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(col).alias("_c"), F.col(at).alias("_p"))
    after = carry_next(narrow, "_g", ["_o", "_p"], ["_c", "_p"])
    wrong = (after.filter("next__p IS NOT NULL AND next__p <> _p + 1")
             .select(F.col("_p").alias(at), F.col("next__c").alias(fix), F.lit(True).alias(fixed))).checkpoint(eager=True)

    def neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(b: pa.RecordBatch, behind: pa.RecordBatch | None) -> pa.RecordBatch:
            value = pa.nulls(b.num_rows, b.column(col).type)
            if behind is not None:
                a, z = b.column(order), behind.column(order)
                up = pc.or_(pc.is_null(a), pc.fill_null(pc.less_equal(a, z), False))
                value = pc.if_else(pc.and_(_same(b.column(group), behind.column(group)), up), behind.column(col), value)
            return pa.RecordBatch.from_arrays([*b.columns, value], [*b.schema.names, out])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                yield joined(last, b.slice(0, 1))
            if b.num_rows > 1:
                yield joined(b.slice(0, b.num_rows - 1), b.slice(1))
            last = b.slice(b.num_rows - 1)
        if last is not None:
            yield joined(last, None)

    rest = placed.drop(out) if out in df.columns else placed
    near = rest.mapInArrow(neighbour, T.StructType([*rest.schema.fields, T.StructField(out, df.schema[col].dataType)]))
    joined = near.join(broadcast_if_small(wrong, wrong.count(), 32), at, "left")
    return joined.withColumn(out, F.when(F.col(fixed), F.col(fix)).otherwise(F.col(out))).drop(at, fix, fixed)


def _free(df: DataFrame, want: str) -> str:
    from distillery.operators.lookup import free_name

    return free_name(df, want)
