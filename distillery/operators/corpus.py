"""Prompt corpus: registry of sources -> filtered, unioned, indexed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distillery import options as O
from distillery.functions.text import teacher_prompt, word_count
from distillery.operators.filters import keep_short, project_key
from distillery.operators.order import broadcast_if_small, with_row_index, with_row_index_and_count

CORPUS_KEYS = ("dataset_ord", "split", "src_file", "src_block", "row_key")


def corpus_order():
    """Order keys of the corpus index; nulls sort last in every key."""
    return [F.col(c).asc_nulls_last() for c in CORPUS_KEYS]


@dataclass
class Source:
    """A registered dataset read as a DataFrame.

    ``split`` is a literal split name or a column; ``row_key`` orders rows
    inside a split. File sources leave ``row_key`` None and are ordered by
    file path, block start and position inside the block.
    """

    name: str
    frame: DataFrame
    key: str | None = "instruction"
    split: str | Column = "train"
    row_key: Column | str | None = None
    where: Column | None = None


def _source_rows(src: Source, ordinal: int) -> DataFrame | None:
    df = src.frame
    if src.where is not None:
        df = df.filter(src.where)
    split = F.lit(src.split) if isinstance(src.split, str) else src.split
    if src.row_key is not None:
        rk = F.col(src.row_key) if isinstance(src.row_key, str) else src.row_key
        df = df.select("*", split.alias("_split"), rk.cast("bigint").alias("_row_key"),
                       F.lit("").alias("_src_file"), F.lit(0).cast("bigint").alias("_src_block"))
    else:
        df = df.select("*", split.alias("_split"),
                       F.monotonically_increasing_id().alias("_row_key"),
                       F.col("_metadata.file_path").alias("_src_file"),
                       F.col("_metadata.file_block_start").alias("_src_block"))
    df = project_key(df, src.key)
    if df is None:
        return None
    return df.select(
        F.lit(ordinal).alias("dataset_ord"),
        F.lit(src.name).alias("dataset"),
        F.col("_split").cast("string").alias("split"),
        F.col("_src_file").alias("src_file"),
        F.col("_src_block").alias("src_block"),
        F.col("_row_key").alias("row_key"),
        F.col("instruction"),
    )


def union_sources(sources: list[Source]) -> DataFrame:
    """All rows of all sources, registry order, duplicates kept.

    Sources without a key are skipped (B7). One lazy plan, one job.
    """
    parts = [p for i, s in enumerate(sources) if (p := _source_rows(s, i)) is not None]
    if not parts:
        raise ValueError("no source with a key")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_corpus(df: DataFrame, limit: int = O.PROMPT_WORD_LIMIT) -> DataFrame:
    """B2-B4 on the union."""
    return keep_short(df, "instruction", limit)


def index_corpus(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """D1 on the corpus order (dataset, split, file, block, row key)."""
    return with_row_index(df, corpus_order(), "row_idx", num_partitions)


def index_blocks(df: DataFrame) -> tuple[DataFrame, int] | None:
    """D1 for file sources: rows lie in scan blocks, and each block's rows in
    order, so an index needs the rows per block and their prefix sums alone.
    No row is moved. ``df`` is read twice, by the same scans.

    Returns None where blocks are no unit of the order (a split that is not
    the file's). The driver sees one row per scan block, as it does when it
    plans the scan.
    """
    at = "_at"
    placed = df.withColumn(at, F.monotonically_increasing_id())
    block = ("dataset_ord", "src_file", "src_block")
    found = placed.groupBy(*block, "split").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).collect()
    if len({(r["dataset_ord"], r["src_file"], r["src_block"]) for r in found}) < len(found):
        return None
    if any(r["last"] - r["first"] + 1 != r["n"] for r in found):
        return None
    found.sort(key=lambda r: (r["dataset_ord"], r["split"] is None, r["split"] or "", r["src_file"], r["src_block"]))
    starts, total = [], 0
    for r in found:
        starts.append((r["dataset_ord"], r["src_file"], r["src_block"], r["first"], r["last"], total - r["first"]))
        total += r["n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, "dataset_ord INT, src_file STRING, src_block BIGINT, _first BIGINT, _last BIGINT, _shift BIGINT")
    size = sum(len(r["src_file"]) + 80 for r in found) // max(len(found), 1)
    # a scan that was planned anew (other files, other block sizes) must not pass
    there = F.coalesce(F.col(at).between(F.col("_first"), F.col("_last")), F.lit(False))
    idx = F.when(there, F.col("_shift") + F.col(at)).otherwise(F.raise_error(F.lit("the scan changed after it was indexed")).cast("bigint"))
    indexed = (placed.join(broadcast_if_small(offsets, len(starts), size), list(block), "left")
               .withColumn("row_idx", idx).select(*df.columns, "row_idx"))
    return indexed, total


def build_corpus(sources: list[Source], limit: int = O.PROMPT_WORD_LIMIT,
                 num_partitions: int | None = None) -> DataFrame:
    """The prompt corpus: union -> filter -> stable index."""
    return build_corpus_and_count(sources, limit, num_partitions)[0]


def build_corpus_and_count(sources: list[Source], limit: int = O.PROMPT_WORD_LIMIT,
                           num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``build_corpus`` plus its row count (no extra job). File sources are
    indexed by their scan blocks, others by a range partitioning."""
    rows = filter_corpus(union_sources(sources), limit)
    if all(s.row_key is None for s in sources if s.key):
        indexed = index_blocks(rows)
        if indexed is not None:
            return indexed
    return with_row_index_and_count(rows, corpus_order(), "row_idx", num_partitions)


def with_teacher_prompt(df: DataFrame, system: str = O.TEACHER_SYSTEM_PROMPT) -> DataFrame:
    """E1 as a column ``prompt``."""
    return df.withColumn("prompt", teacher_prompt("instruction", system))


def corpus_word_counts(df: DataFrame) -> DataFrame:
    """B3 over the union (before filtering)."""
    return df.withColumn("word_count", word_count("instruction"))
