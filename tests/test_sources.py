import pytest
from pyspark.sql import functions as F

from distillery import options as O
from distillery.sources import datasets as DS
from distillery.sources import fs, sinks
from distillery.sources.manifest import manifest


@pytest.mark.parametrize("names,name,registry,expect", [
    (["a.jsonl"], "a", None, {"train": "a.jsonl"}),
    (["a_train.jsonl"], "a", None, {"train": "a_train.jsonl"}),
    (["a_train.jsonl", "a_test.jsonl"], "a", None, {"train": "a_train.jsonl", "test": "a_test.jsonl"}),
    (["a_train.jsonl", "a_b_train.jsonl"], "a", ["a", "a_b"], {"train": "a_train.jsonl"}),
    (["ab.jsonl", "a.jsonl"], "a", None, {"train": "a.jsonl"}),
    (["x.jsonl"], "a", None, {}),
])
def test_dataset_file_selection(names, name, registry, expect):
    assert DS.dataset_files(names, name, registry) == expect


def test_split_write_read_roundtrip(spark, tmp_root):
    df = spark.createDataFrame([("train", "héllo", 1), ("test", None, 2), ("train", "b", 3)],
                               "split STRING, instruction STRING, k INT")
    written = sinks.write_jsonl_splits(df, f"{tmp_root}/org_set")
    assert sorted(w.rsplit("/", 1)[1] for w in written) == ["org_set_test.jsonl", "org_set_train.jsonl"]
    assert sinks.write_jsonl_splits(df, f"{tmp_root}/org_set") == []        # complete: skipped
    back = DS.read_dataset(spark, tmp_root, "org/set", "instruction STRING, k INT")
    assert sorted(tuple(r) for r in back.select("split", "instruction", "k").collect()) == \
        [("test", None, 2), ("train", "b", 3), ("train", "héllo", 1)]
    raw = spark.read.text(f"{tmp_root}/org_set_train.jsonl").collect()
    assert any("héllo" in r.value for r in raw)                              # UTF-8, not escaped
    nulls = spark.read.text(f"{tmp_root}/org_set_test.jsonl").first().value
    assert '"instruction":null' in nulls                                      # null field kept


def test_resolve_order_and_missing(spark, tmp_root):
    e = O.RegistryEntry("ds", "instruction")
    snap = f"{tmp_root}/snap"
    sinks.write_snapshot(spark.createDataFrame([("p",)], "instruction STRING"), f"{snap}/ds")
    got = DS.resolve_source(spark, e, f"{tmp_root}/jsonl", snap)
    assert [r.instruction for r in got.collect()] == ["p"] and "split" in got.columns
    with pytest.raises(FileNotFoundError):
        DS.resolve_source(spark, O.RegistryEntry("nope"), f"{tmp_root}/jsonl", snap)


def test_write_once_needs_success_marker(spark, tmp_root):
    df = spark.createDataFrame([("a",)], "instruction STRING")
    path = f"{tmp_root}/once"
    assert sinks.write_once(df, path) is True
    assert sinks.write_once(df, path) is False
    assert fs.is_complete(spark, path)


def test_append_new_results_is_idempotent(spark, tmp_root):
    df = spark.createDataFrame([("request-0", "a"), ("request-1", "b")], "custom_id STRING, output STRING")
    path = f"{tmp_root}/teacher"
    sinks.append_new_results(df, path)
    sinks.append_new_results(df, path)
    assert spark.read.json(path).count() == 2


def test_pick_version(spark):
    assert DS.pick_version(spark, "open", "64k") == "v7-GoogleDocString"
    assert DS.pick_version(spark, "closed", "16k") == "v3-NumpyDocString"
    with pytest.raises(ValueError):
        DS.pick_version(spark, "open", "8k")
    with pytest.raises(ValueError):
        DS.pick_version(spark, "other", "16k")


def test_manifest_digest_is_order_free(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i INT, t STRING")
    a = manifest(df, "x", tags={"version": "v1"}).first()
    b = manifest(df.repartition(7).orderBy(F.rand(3)), "x", tags={"version": "v1"}).first()
    assert a.digest == b.digest and a.n_rows == 50 and a.n_cols == 2 and a.tags == {"version": "v1"}
    c = manifest(df.limit(49), "x").first()
    assert c.digest != a.digest


def test_file_order_index_over_split_files(spark, tmp_root):
    """Plain reference-style JSONL files (one per split, seven splits): the
    corpus index follows split name, then line order."""
    import os

    from distillery.operators.corpus import Source, build_corpus

    local = tmp_root.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    splits = ["a", "b", "c", "d", "e", "f", "g"]
    expect = []
    for j, sp in enumerate(splits):
        lines = [f"w{j} x{i}" for i in range(5 + j)]
        with open(os.path.join(local, f"ds_{sp}.jsonl"), "w", encoding="utf-8") as f:
            for ln in lines:
                f.write('{"instruction": "%s"}\n' % ln)
        expect += [(sp, ln) for ln in lines]
    df = DS.read_dataset(spark, tmp_root, "ds", "instruction STRING")
    idx = build_corpus([Source("ds", df, key="instruction", split=F.col("split"))], limit=17, num_partitions=3)
    got = [(r.split, r.instruction) for r in idx.orderBy("row_idx").collect()]
    assert got == expect
    assert [r.row_idx for r in idx.orderBy("row_idx").collect()] == list(range(len(expect)))


def test_file_order_survives_block_splits(spark, tmp_root):
    """One file read as many scan blocks keeps line order in the index."""
    import os

    from distillery.operators.corpus import Source, build_corpus

    local = tmp_root.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    lines = [f"line {i:04d} " + "x" * (i % 37) for i in range(400)]
    with open(os.path.join(local, "big.jsonl"), "w", encoding="utf-8") as f:
        for ln in lines:
            f.write('{"instruction": "%s"}\n' % ln)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = DS.read_dataset(spark, tmp_root, "big", "instruction STRING")
        assert df.rdd.getNumPartitions() > 5
        idx = build_corpus([Source("big", df, key="instruction", split=F.col("split"))], limit=17)
        got = [r.instruction for r in idx.orderBy("row_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == lines


def test_split_name_ignores_parent_folders(spark, tmp_root):
    """A parent folder that looks like a split file does not decide the split."""
    base = f"{tmp_root}/ds_zz.jsonl/inner"
    df = spark.createDataFrame([("train", "a"), ("test", "b")], "split STRING, instruction STRING")
    sinks.write_jsonl_splits(df, f"{base}/ds")
    back = DS.read_dataset(spark, base, "ds", "instruction STRING")
    assert sorted((r.split, r.instruction) for r in back.collect()) == [("test", "b"), ("train", "a")]
