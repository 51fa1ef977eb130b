"""Dataset manifest: lineage record computed as one distributed aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\x1f"
_NULL = "\x00"


def row_hash(cols: list[str], method: str = "xxhash64") -> Column:
    """A 64-bit hash per row. ``md5`` gives 60 bits of the md5 of the
    fields joined by U+001F (null as U+0000), reproducible in plain SQL."""
    if method == "xxhash64":
        return F.xxhash64(*[F.col(c) for c in cols])
    if method == "md5":
        txt = F.concat_ws(_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in cols])
        return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash {method!r}")


def manifest(df: DataFrame, name: str, source: str = "", context: str = "",
             tags: dict[str, str] | None = None, digest: str = "xxhash64") -> DataFrame:
    """One row: name, source, context, tags, n_rows, n_cols, schema JSON and
    an order-independent digest (sum of row hashes, modulo 2^62, so that
    repeated rows count). A single partial
    aggregate; the data never reaches the driver."""
    cols = df.columns
    kv = []
    for k, v in sorted((tags or {}).items()):
        kv += [F.lit(k), F.lit(v)]
    tag_col = F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")
    agg = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.pmod(F.sum(row_hash(cols, digest).cast("decimal(20,0)")), F.lit(1 << 62).cast("decimal(38,0)"))
                 .cast("bigint").alias("digest"))
    return agg.select(F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(context).alias("context"),
                      tag_col.alias("tags"), "n_rows", F.lit(len(cols)).cast("bigint").alias("n_cols"),
                      F.lit(df.schema.json()).alias("schema_json"),
                      F.coalesce(F.col("digest"), F.lit(0).cast("bigint")).alias("digest"))


def tags_text(tags) -> Column:
    """``k=v`` pairs sorted by key, joined by ``;``."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def merge_manifests(old: DataFrame, part: DataFrame) -> DataFrame:
    """The manifest of a dataset after an append, from its manifest before
    (``old``) and that of the appended part, without reading the dataset
    again: rows add up, and so do the digests. Name, source, context and tags
    are the old record's. Both must be single rows with the same schema and
    the same kind of digest; else it fails when it runs."""
    kept = ("name", "source", "context", "tags", "n_cols", "schema_json")
    both = old.withColumn("_k", F.lit(0)).unionByName(part.withColumn("_k", F.lit(1)))
    m = both.agg(*[F.min_by(c, "_k").alias(c) for c in kept], F.sum("n_rows").alias("n_rows"),
                 F.sum(F.col("digest").cast("decimal(20,0)")).alias("digest"),
                 (F.count_distinct("schema_json") == 1).alias("_same"))
    rows = F.when(F.col("_same"), F.col("n_rows")).otherwise(
        F.raise_error(F.lit("manifests of different schemas")).cast("bigint"))
    digest = F.pmod("digest", F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint")
    return m.select("name", "source", "context", "tags", rows.alias("n_rows"), "n_cols", "schema_json", digest.alias("digest"))
