import pytest

from distillery import options as O
from distillery.operators import generate as G


def _raise_on(words):
    def factory():
        def fn(prompts):
            for p in prompts:
                if p in words:
                    raise RuntimeError(f"bad {p}")
            return [p.upper() for p in prompts]
        return fn
    return factory


@pytest.mark.parametrize("bad", [{"p0"}, {"p5"}, {"p9"}, {"p0", "p9"}])
def test_failing_rows_become_error_rows(spark, bad):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "row_idx BIGINT, prompt STRING").coalesce(1)
    out = {r.row_idx: (r.output, r.status) for r in G.generate(df, _raise_on(bad), batch_size=10).collect()}
    for i in range(10):
        p = f"p{i}"
        if p in bad:
            assert out[i] == (f"[OpenAI API Error] => bad {p}", "error")
        else:
            assert out[i] == (p.upper(), "ok")


def test_null_prompt_and_md5(spark):
    import hashlib

    df = spark.createDataFrame([(0, None), (1, "héllo")], "row_idx BIGINT, prompt STRING")
    out = {r.row_idx: (r.output, r.status) for r in G.generate(df, G.md5_generator).collect()}
    assert out[0] == (None, "no_prompt")
    assert out[1] == (hashlib.md5("héllo".encode()).hexdigest(), "ok")


def test_replay_and_modes(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx BIGINT, instruction STRING")
    ans = spark.createDataFrame([("a", "A2", 5), ("a", "A1", 3)], "instruction STRING, output STRING, k INT")
    out = {r.row_idx: (r.output, r.status) for r in G.replay(df, ans, order_col="k").collect()}
    assert out == {0: ("A1", "ok"), 1: (None, "missing")}
    with pytest.raises(ValueError):
        G.answer(df, "live")
    with pytest.raises(ValueError):
        G.answer(df, "inline")
    with pytest.raises(ValueError):
        G.answer(df, "replay")


def test_generator_built_once_per_worker(spark, tmp_root):
    """With reuse, tasks on the same Python worker share one built generator."""
    import os

    def factory_writing_to(marker_dir):
        def factory():
            import uuid as _u

            open(os.path.join(marker_dir, _u.uuid4().hex), "w").close()
            return lambda ps: [p[::-1] for p in ps]
        return factory

    df = spark.range(0, 400).selectExpr("id AS row_idx", "CAST(id AS STRING) AS prompt").repartition(16)
    counts = {}
    for reuse in (True, False):
        marker_dir = os.path.join(tmp_root.replace("file:", ""), f"reuse-{reuse}")
        os.makedirs(marker_dir)
        out = G.generate(df, factory_writing_to(marker_dir), reuse=reuse).collect()
        assert len(out) == 400 and all(r.output == r.prompt[::-1] for r in out)
        counts[reuse] = len(os.listdir(marker_dir))
    assert 1 <= counts[True] <= 16
    assert counts[False] == 16          # once per task without reuse


def test_spread_balances_one_big_partition(spark):
    df = spark.range(0, 800).selectExpr("id AS row_idx", "CAST(id AS STRING) AS prompt").coalesce(1)
    out = G.generate(df, G.md5_generator, partitions=8)
    sizes = out.rdd.glom().map(len).collect()
    assert len(sizes) == 8 and max(sizes) <= 2 * (800 // 8) and sum(sizes) == 800


def test_wide_keys_with_nulls_stay_exact(spark):
    rows = [(9007199254740993, "a"), (None, "b"), (-9007199254740993, None)]
    df = spark.createDataFrame(rows, "k bigint, prompt string").coalesce(1)
    out = {r.k: (r.prompt, r.status) for r in G.generate(df, G.md5_generator).collect()}
    assert out == {9007199254740993: ("a", "ok"), None: ("b", "ok"), -9007199254740993: (None, "no_prompt")}


def test_batch_mode_returns_the_index(spark):
    df = spark.createDataFrame([(7, "seven"), (8, "eight")], "row_idx bigint, instruction string")
    lines = [f'{{"custom_id": "{O.REQUEST_ID_PREFIX}8", "response": {{"body": {{"choices": [{{"message": {{"content": "x"}}}}]}}}}}}',
             '{"custom_id": "other", "error": "late"}']
    got = G.answer(df, "batch", responses=spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r.row_idx, r.instruction, r.status) for r in got.collect()} == {
        (8, "eight", "ok"), (None, "[Batch custom_id=other]", "unknown_id")}
