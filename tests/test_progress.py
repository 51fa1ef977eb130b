"""Committed parts, merged shards and published sources, also when a run ends
in between."""

import random

import pytest
from pyspark.sql import functions as F

from distillery import options as O
from distillery.operators import order as D
from distillery.sources import datasets as DS
from distillery.sources import fs, progress, sinks
from distillery.sources.manifest import manifest, merge_manifests


def _numbered(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "row_idx BIGINT, instruction STRING")


def _covered(df):
    return {i for r in df.collect() for i in range(r.lo, r.hi + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_row_ranges(spark, seed):
    rng = random.Random(seed)
    ids = [i for i in range(300) if rng.random() < 0.8]
    df = _numbered(spark, ids + ids[:5] + [None]).repartition(7)
    found = progress.row_ranges(df)
    assert _covered(found) == set(ids)
    assert found.agg(F.sum("n")).first()[0] == len(ids) + 5
    assert progress.row_ranges(df.limit(0)).count() == 0


def test_parts_and_resume(spark, tmp_root):
    c = _numbered(spark, range(500_000)).repartition(6)
    path = f"{tmp_root}/answers"
    assert progress.committed_rows(spark, path) == 0
    assert progress.resume_by_ranges(c, progress.committed_ranges(spark, path)).count() == 500_000
    progress.append_part(c.filter("row_idx < 1000"), path)
    progress.append_part(c.filter("row_idx BETWEEN 70000 AND 140000 OR row_idx = 499999"), path)
    # an append that ended before its log entry
    c.filter("row_idx = 1500").write.json(f"{path}/part-half")
    assert progress.committed_rows(spark, path) == 1000 + 70001 + 1
    left = progress.resume_by_ranges(c, progress.committed_ranges(spark, path))
    assert left.count() == 500_000 - 71_002 and left.filter("row_idx IN (1500, 1000, 69999, 140001, 499998)").count() == 5
    rows = progress.read_parts(spark, path, "row_idx BIGINT, instruction STRING")
    assert rows.count() == 71_002 and rows.filter("instruction <> concat('t', row_idx)").isEmpty()
    assert progress.resume_by_ranges(_numbered(spark, [None, 5]), progress.committed_ranges(spark, path)).collect()[0].row_idx is None


def test_merge_commits_in_order(spark, tmp_root):
    shards, out = f"{tmp_root}/shards", f"{tmp_root}/merged"
    rows = D.assign_shards(_numbered(spark, range(40)).repartition(5), 40, 4)
    sinks.write_shards(rows, shards)
    merged = sinks.merge_shards_to(spark, shards, out)
    assert [r.row_idx for r in merged.collect()] == list(range(40))  # file by file
    assert not fs.exists(spark, shards) and fs.is_complete(spark, out)
    assert sinks.merge_shards_to(spark, shards, out).count() == 40  # nothing left to do
    # other shards under a finished output are not thrown away
    sinks.write_shards(D.assign_shards(_numbered(spark, range(30, 60)), 60, 4), shards)
    with pytest.raises(FileExistsError):
        sinks.merge_shards_to(spark, shards, out)
    assert fs.exists(spark, shards)


def test_merge_keeps_shards_when_it_fails(spark, tmp_root, monkeypatch):
    shards, out = f"{tmp_root}/shards", f"{tmp_root}/merged"
    sinks.write_shards(D.assign_shards(_numbered(spark, range(20)), 20, 2), shards)

    def killed(*a):
        raise OSError("killed before the rename")

    with monkeypatch.context() as m:
        m.setattr(fs, "replace_folder", killed)
        with pytest.raises(OSError):
            sinks.merge_shards_to(spark, shards, out)
    assert fs.exists(spark, shards) and not fs.exists(spark, out)
    assert sinks.merge_shards_to(spark, shards, out).count() == 20
    # killed between the rename and the removal: the next run removes
    sinks.write_shards(D.assign_shards(_numbered(spark, range(20)), 20, 2), shards)
    assert sinks.merge_shards_to(spark, shards, out).count() == 20 and not fs.exists(spark, shards)


def test_resolved_source_is_saved(spark, tmp_root):
    e, jsonl, snap = O.RegistryEntry("org/ds"), f"{tmp_root}/jsonl", f"{tmp_root}/snap"
    df = spark.createDataFrame([("a", 1, "train"), (None, 2, "test"), ("c", 3, None)], "instruction STRING, k BIGINT, split STRING")
    sinks.write_snapshot(df, f"{snap}/org_ds")
    want = sorted(map(repr, df.collect()))
    first = DS.resolve_source(spark, e, jsonl, snap)
    again = DS.resolve_source(spark, e, jsonl)  # no snapshot: from the JSONL
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.select(*df.columns).collect())) == want
    assert again.schema["k"].dataType.simpleString() == "bigint"
    assert fs.list_names(spark, jsonl) == [".schemas", "org_ds_test.jsonl", "org_ds_train.jsonl", "org_ds_~null.jsonl"]
    assert DS.resolve_source(spark, O.RegistryEntry("b", external_local_path=f"{snap}/org_ds", external_format="parquet"), jsonl,
                             save=False).count() == 3
    assert not any(n.startswith("b") for n in fs.list_names(spark, jsonl))


def test_interrupted_publish_is_passed_over(spark, tmp_root, monkeypatch):
    e, jsonl, snap = O.RegistryEntry("ds"), f"{tmp_root}/jsonl", f"{tmp_root}/snap"
    df = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate("abc")], "instruction STRING, split STRING")
    sinks.write_snapshot(df, f"{snap}/ds")
    move, moved = fs.replace_folder, []

    def once(spark, src, dst):
        if moved:
            raise OSError("killed")
        moved.append(dst)
        move(spark, src, dst)

    with monkeypatch.context() as m:
        m.setattr(fs, "replace_folder", once)
        with pytest.raises(OSError):
            DS.resolve_source(spark, e, jsonl, snap)
    assert len(moved) == 1 and DS.read_dataset(spark, jsonl, "ds") is None  # one split of three is no dataset
    with pytest.raises(FileNotFoundError):
        DS.resolve_source(spark, e, jsonl)
    assert sorted(r.split for r in DS.resolve_source(spark, e, jsonl, snap).collect()) == ["a", "b", "c"]
    assert DS.resolve_source(spark, e, jsonl).count() == 3


def test_odd_split_names(spark, tmp_root):
    names = [None, "", "null", "~null", "~~x", "train", "a b", "~"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "split STRING, k INT")
    sinks.write_jsonl_splits(df, f"{tmp_root}/ds")
    back = DS.read_dataset(spark, tmp_root, "ds")
    got = {r.k: r.split for r in back.collect()}
    assert {k: v for k, v in got.items() if k != 6} == {i: n for i, n in enumerate(names) if i != 6}
    assert sinks.write_jsonl_splits(df, f"{tmp_root}/ds") == []  # complete splits are skipped


def test_registry_takes_schemas_from_the_catalogue(spark, tmp_root):
    df = spark.createDataFrame([("x", 5, "train")], "text STRING, k BIGINT, split STRING")
    sinks.write_jsonl_splits(df, f"{tmp_root}/one")
    local = tmp_root.replace("file:", "")
    with open(f"{local}/two.jsonl", "w") as f:
        f.write('{"text": "y", "n": 1}\n')
    entries = [O.RegistryEntry("one", "text"), O.RegistryEntry("none", None), O.RegistryEntry("two", "text")]
    assert DS.load_schema(spark, tmp_root, "two") is None
    sources = DS.registry_sources(spark, entries, tmp_root)
    assert [s.name for s in sources] == ["one", "two"]
    assert DS.load_schema(spark, tmp_root, "one").simpleString() == "struct<text:string,k:bigint>"
    assert DS.load_schema(spark, tmp_root, "two").simpleString() == "struct<n:bigint,text:string>"  # inferred once, kept
    from distillery.operators.corpus import build_corpus

    rows = build_corpus(sources).orderBy("row_idx").collect()
    assert [(r.row_idx, r.dataset, r.instruction) for r in rows] == [(0, "one", "x"), (1, "two", "y")]


def test_file_index_moves_no_row(spark, tmp_root):
    from distillery.operators.corpus import Source, build_corpus_and_count

    df = spark.createDataFrame([(("b", "a")[i % 2], f"w{i}" if i % 3 else "", i) for i in range(300)], "split STRING, text STRING, k INT")
    sinks.write_jsonl_splits(df.repartition(4), f"{tmp_root}/ds")
    sources = [Source("ds", DS.read_dataset(spark, tmp_root, "ds"), key="text", split=F.col("split"))]
    idx, n = build_corpus_and_count(sources)
    assert "rangepartitioning" not in idx._jdf.queryExecution().executedPlan().toString()
    got = idx.orderBy("row_idx").collect()
    assert n == 200 and [r.row_idx for r in got] == list(range(200)) and [r.split for r in got] == ["a"] * 100 + ["b"] * 100
    # a scan planned anew is noticed
    again, _ = build_corpus_and_count(sources)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        with pytest.raises(Exception, match="scan changed"):
            again.select("row_idx", "instruction").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # a split that is a column of the rows, not the file's: sorted as before
    sinks.write_jsonl_splits(df.withColumn("kind", F.col("split")).withColumn("split", F.lit("train")), f"{tmp_root}/mixed")
    mixed = [Source("mixed", DS.read_dataset(spark, tmp_root, "mixed"), key="text", split=F.col("kind"))]
    idx, n = build_corpus_and_count(mixed)
    got = idx.orderBy("row_idx").collect()
    assert n == 200 and [r.row_idx for r in got] == list(range(200)) and [r.split for r in got] == ["a"] * 100 + ["b"] * 100
    empty = build_corpus_and_count([Source("ds", DS.read_dataset(spark, tmp_root, "ds").filter("k < 0"), key="text", split=F.col("split"))])
    assert empty[1] == 0 and empty[0].count() == 0


def test_merged_manifest_is_the_recomputed_one(spark):
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"t{i}") for i in range(90)], "k INT, t STRING")
    for digest in ("xxhash64", "md5"):
        whole = manifest(rows, "x", "s", tags={"a": "b"}, digest=digest).first()
        old, part = manifest(rows.filter("k < 4"), "x", "s", tags={"a": "b"}, digest=digest), manifest(rows.filter("k >= 4"), "p", digest=digest)
        assert merge_manifests(old, part).first() == whole
        assert merge_manifests(manifest(rows.limit(0), "x", "s", tags={"a": "b"}, digest=digest), manifest(rows, "y", digest=digest)).first() == whole
    with pytest.raises(Exception, match="different schemas"):
        merge_manifests(old, manifest(rows.drop("t"), "p")).collect()
