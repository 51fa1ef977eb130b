from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from distillery.functions.text import word_count
from distillery.operators.filters import at_most_words, keep_short, project_key

SEPS = [" ", "\t", "\n", "\u00a0", "\u3000", "\x1c", "\x1f", "\u2009", "\x85", "\u200b"]
EDGE = [None, "", "   ", " ".join(["w"] * 17), " ".join(["w"] * 18), "a\u00a0b", "a\u3000b",
        "a\x1cb", "a\u200bb", "  lead and trail  ", "\u2009x y"]


def _counts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = df.select("i", word_count("t").alias("n"), at_most_words("t", 17).alias("ok")).collect()
    return {r.i: (r.n, r.ok) for r in rows}


def test_word_count_matches_python_split(spark):
    got = _counts(spark, EDGE)
    for i, t in enumerate(EDGE):
        if t is None:
            assert got[i][0] is None
            continue
        assert got[i][0] == len(t.split()), repr(t)
        assert got[i][1] == (len(t.split()) <= 17), repr(t)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SEPS), st.text(alphabet="ab\u00e9\u4e2d\u200b", min_size=0, max_size=4)),
                max_size=25))
def test_word_count_property(spark, parts):
    t = "".join(s + w for s, w in parts)
    got = _counts(spark, [t])[0]
    assert got[0] == len(t.split())
    assert got[1] == (len(t.split()) <= 17)


def test_keep_short_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "i INT, instruction STRING")
    kept = {r.i: r.instruction for r in keep_short(df, "instruction", 17).collect()}
    assert 0 not in kept and 1 not in kept          # null and '' dropped
    assert kept[2] == "   "                        # whitespace-only passes, untrimmed
    assert 3 in kept and 4 not in kept             # 17 kept, 18 dropped (inclusive)
    assert kept[9] == "  lead and trail  "


def test_project_key_rules(spark):
    df = spark.createDataFrame([(1, "x")], "id INT, text STRING")
    assert project_key(df, None) is None
    missing = project_key(df, "nope").select("instruction").first()[0]
    assert missing == ""
    assert project_key(df, "text").columns == ["id", "instruction"]
    import pytest

    with pytest.raises(TypeError):
        project_key(df, "id")


def test_filter_is_pushed_to_scan(spark):
    from tests.conftest import SF_MID

    from distillery.operators.filters import keep_short as ks

    df = ks(spark.read.parquet(f"{SF_MID}/documents.parquet").withColumnRenamed("text", "instruction"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in plan
    assert F is not None
