"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distillery.llm.shared import cut


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")),
                                      F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component
    is its smallest node.

    Large-star and small-star steps alternate until nothing changes. Each
    step is a minimum by node (combined before the shuffle) and a join back
    on the node, so a node with very many edges is never gathered in one
    task: a skewed join is split. The edge count never grows, and each
    round is cut with a checkpoint. Null ends and loops are ignored; an
    empty edge table gives no rows.
    """
    e = cut(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        # large star: every larger neighbour of u points to u's minimum
        sym = _both_ways(e)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: every smaller neighbour of u, and u, points to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u <> v").distinct())
        e = cut(small)
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
