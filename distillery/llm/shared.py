"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from distillery.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast only if ``rows * row_bytes`` is below the
    session's own broadcast threshold; beyond it the join shuffles."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(limit)))
    return F.broadcast(df) if rows * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variant that no column of ``df`` has (names compare
    without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = want
    while name.lower() in taken:
        name = "_" + name
    return name


class KeyFilter:
    """Passes the rows whose 64-bit key is among ``keys``. Keys are told by a
    bitmap of 64 bits for each of ``rows`` keys, of 8 MB at most: it may let
    other keys pass, never stops one of these."""

    def __init__(self, keys: DataFrame, rows: int, key: str = "row_key"):
        self.bits = bits = 1 << min(26, max(15, (64 * rows).bit_length()))
        at = F.pmod(key, F.lit(bits)) + 1  # Spark's buckets of 32,768 bits count from 1
        self.parts = [(r["b"] - 1, bytes(r["m"])) for r in
                      keys.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
                      .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()]

    def mark(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """``df`` with the boolean ``out``, without Python: rows meet their
        part of the bitmap (2048 parts of 4 KB at most) in a broadcast join."""
        spark, place, part = df.sparkSession, free_name(df, "_place"), free_name(df, "_bitmap")
        parts = spark.createDataFrame(self.parts, "_bucket bigint, _bits binary").withColumnRenamed("_bits", part)
        found = (df.withColumn(place, F.pmod(key, F.lit(self.bits)))
                 .join(F.broadcast(parts), F.shiftright(col(place), 15) == F.col("_bucket"), "left"))
        at = F.pmod(col(place), F.lit(1 << 15)).cast("int")
        byte = F.conv(F.hex(F.substring(col(part), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("getbit", byte, at.bitwiseAND(F.lit(7))) == 1
        return found.withColumn(out, F.coalesce(hit, F.lit(False))).drop(place, part, "_bucket")


def likely(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``others``: all of those
    where it is, and a few more."""
    others = others.select(F.xxhash64(col(key).cast(df.schema[key].dataType)).alias("row_key")).filter(col("row_key").isNotNull())
    mark = free_name(df, "_likely")
    return KeyFilter(others, others.count()).mark(df, F.xxhash64(col(key)), mark).filter(col(mark)).drop(mark)


def matching(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``df`` joined with ``others`` on ``key``; rows of ``df`` whose key
    ``others`` does not have are left out before they are moved."""
    return likely(df, others, key).join(others, key)
