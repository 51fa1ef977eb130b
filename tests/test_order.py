import pytest
from pyspark.sql import functions as F

from distillery.operators import order as D


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_row_index_dense_and_ordered(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    df = df.repartition(5)
    out = D.with_row_index(df, ["k"], num_partitions=parts).select(
        "k", "row_idx").collect()
    assert sorted((r.k, r.row_idx) for r in out) == [(i, i) for i in range(1000)]


def test_row_index_empty(spark):
    df = spark.range(0).select(F.col("id").alias("k"))
    assert D.with_row_index(df, ["k"]).count() == 0


@pytest.mark.parametrize("n,world", [(0, 4), (3, 4), (10, 3), (10, 4), (12, 4)])
def test_shard_bounds(n, world):
    b = D.shard_bounds(n, world)
    assert len(b) == world
    covered = [i for _, s, e in b for i in range(s, e)]
    assert covered == list(range(n))
    if n == 10 and world == 4:
        assert b == [(0, 0, 3), (1, 3, 6), (2, 6, 9), (3, 9, 10)]


def test_shards_partition_rows(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "row_idx")
    s = D.assign_shards(df, 10, 4).collect()
    assert [r.shard_id for r in sorted(s, key=lambda r: r.row_idx)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r.shard_pos for r in sorted(s, key=lambda r: r.row_idx)] == [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]


@pytest.mark.parametrize("k", [0, 3, 10, 12])
def test_resume_by_count(spark, k):
    df = spark.range(0, 10).withColumnRenamed("id", "row_idx")
    left = sorted(r.row_idx for r in D.resume_by_count(df, k).collect())
    assert left == list(range(min(k, 10), 10))


def test_resume_by_key_survives_changed_input(spark):
    done = spark.createDataFrame([("a",), ("c",)], "instruction STRING")
    now = spark.createDataFrame([("z",), ("a",), ("b",), ("c",)], "instruction STRING")
    assert sorted(r[0] for r in D.resume_by_key(now, done, "instruction").collect()) == ["b", "z"]


def test_batches(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "shard_pos")
    b = D.assign_batches(df, 4).collect()
    assert [r.batch_id for r in sorted(b, key=lambda r: r.shard_pos)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    st = {(r.batch_id): r.n_rows for r in D.batch_stats(D.assign_batches(df, 4), ["batch_id"]).collect()}
    assert st == {0: 4, 1: 4, 2: 2}
    with pytest.raises(ValueError):
        D.assign_batches(df, 0)


def test_with_next_equals_window_lead(spark):
    from pyspark.sql import Window

    rows = [(g, t, f"v{g}-{t}") for g in range(4) for t in range(0, 3 * (g + 1), 2 if g % 2 else 1)]
    rows += [(99, t, f"hot{t}") for t in range(300)]          # one group with most rows
    df = spark.createDataFrame(rows, "g INT, t INT, v STRING").repartition(6)
    w = Window.partitionBy("g").orderBy("t")
    a = {(r.g, r.t): r.next_v for r in D.with_next(df, ["g"], ["t"], ["v"]).collect()}
    b = {(r.g, r.t): r.nv for r in df.withColumn("nv", F.lead("v").over(w)).collect()}
    assert a == b


def test_pairs_methods_agree(spark):
    from distillery.plans import fixtures as FX
    from tests.conftest import SF_SMALL

    cols = ["row_idx", "conv_id", "turn", "instruction", "output"]
    a = sorted(tuple(r) for r in FX.pairs(spark, SF_SMALL, method="join").select(*cols).collect())
    b = sorted(tuple(r) for r in FX.pairs(spark, SF_SMALL, method="window").select(*cols).collect())
    assert a == b and len(a) == 34


@pytest.mark.parametrize("out", ["_pos", "_pid", "_off", "row_idx"])
def test_row_index_any_output_name(spark, out):
    df = spark.range(0, 50).select((F.col("id") * 3).alias("k"))
    got = sorted(r[out] for r in D.with_row_index(df, ["k"], out).collect())
    assert got == list(range(50))


def test_small_path_keeps_downstream_parallel(spark):
    df = spark.range(0, 500).select((F.col("id") * 7).alias("k")).repartition(6)
    out = D.with_row_index(df, ["k"])
    assert out.rdd.getNumPartitions() > 1
    assert sorted(r.row_idx for r in out.collect()) == list(range(500))
