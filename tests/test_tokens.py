import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery.operators import tokens as K

TEXTS = ["the cat sat", "the dog", "", "zebra the", "the <|im_end|> end", "   "]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_idx BIGINT, text STRING")


def test_vocab_ids(spark, frame):
    v = {r.token: (r.token_id, r.n) for r in K.build_vocab(frame, "text", 3).collect()}
    assert v["<|im_end|>"] == (0, None) and v["<unk>"] == (1, None)
    assert v["the"] == (2, 4)
    assert len(v) == 5  # 2 reserved + top 3


@pytest.mark.parametrize("method", ["arrow", "join"])
def test_encode_edges(spark, frame, method):
    v = K.build_vocab(frame, "text", 100)
    out = {r.row_idx: r.input_ids for r in K.encode(frame, v, "text", max_length=2, method=method).collect()}
    ids = {r.token: r.token_id for r in v.collect()}
    assert out[0] == [ids["the"], ids["cat"]]         # cut at max_length
    assert out[1] == [ids["the"], ids["dog"]]         # length == limit
    assert out[2] == [] and out[5] == []               # no words survive
    assert out[4] == [ids["the"], 0]                   # special token keeps id 0


def test_arrow_equals_join_and_roundtrip(spark, frame):
    v = K.build_vocab(frame, "text", 100)
    a = {r.row_idx: r.input_ids for r in K.encode(frame, v, "text", max_length=None, method="arrow").collect()}
    j = {r.row_idx: r.input_ids for r in K.encode(frame, v, "text", max_length=None, method="join").collect()}
    assert a == j
    enc = K.encode(frame, v, "text", max_length=None)
    dec = {r.row_idx: r.decoded for r in K.decode(enc, v, skip_special=False).collect()}
    for i, t in enumerate(TEXTS):
        assert dec[i] == " ".join(t.split())


ODD = [(1, "a b"), (1, "c"), (None, "a c"), (None, None), (2, ""), (2, "a b"), (3, "\u00a0x\u2003a\n")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 1])
def test_forms_agree_on_repeated_and_null_keys(spark, monkeypatch, block_bytes):
    from distillery.operators import lookup

    monkeypatch.setattr(lookup.with_blocks, "__defaults__", (block_bytes,))
    monkeypatch.setattr(lookup.map_items, "__defaults__", (block_bytes,))
    df = spark.createDataFrame(ODD, "row_idx BIGINT, text STRING").withColumn("_block", F.lit("x")).withColumn("item", F.lit(1))
    v = K.build_vocab(df, "text", 100)
    got = {}
    for method in ("arrow", "join"):
        e = K.encode(df, v, "text", max_length=None, method=method)
        d = K.decode(e.withColumn("input_ids", F.when(F.col("row_idx") == 3, F.array(F.lit(0), F.lit(77))).otherwise(F.col("input_ids"))),
                     v, method=method)
        assert e.columns == [*df.columns, "input_ids"] and d.columns == [*e.columns, "decoded"]
        assert d.schema["input_ids"].dataType == e.schema["input_ids"].dataType
        got[method] = sorted(map(repr, d.collect()))
    assert got["arrow"] == got["join"]
    by_text = {r.text: r.input_ids for r in K.encode(df, v, "text", max_length=None).collect()}
    assert [len(by_text[t]) for t in ("a b", "c", "a c", "", ODD[-1][1])] == [2, 1, 2, 0, 2] and by_text[None] is None
    assert by_text["a b"][0] == by_text["a c"][0] and by_text["a b"][0] != by_text["c"][0]


def test_lookup_holds_little_in_python(spark, monkeypatch):
    """Blocks are numbered by sizes alone, and a block's values are Python
    objects about a megabyte at a time."""
    from distillery.operators import lookup

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", None)
    df = (spark.range(0, 4000, 1, 1).withColumn("ids", F.sequence(F.lit(1), F.lit(300)))
          .withColumn("s", F.create_map(F.lit("k"), F.struct(F.lit(None).cast("string").alias("t"), F.array(F.lit("ab"))))))

    def count(values, known):
        if values.nbytes > 2 << 20:
            raise ValueError(f"{values.nbytes} bytes at a time")
        return [len(v) * len(known) for v in values.to_pylist()]

    table = spark.range(1, 301).select(F.col("id").cast("int").alias("item"), F.lit(1).alias("value"))
    found = lookup.map_items(df, F.col("ids"), table, count, "ids", "n", T.LongType())
    assert [tuple(r) for r in found.groupBy("n").count().collect()] == [(90000, 4000)]
    blocks = lookup.with_blocks(df.withColumn("a.b", F.lit("x")), "b", 1 << 20).groupBy("b").count().collect()
    row = 1 + df.toArrow().nbytes // 4000
    assert len(blocks) >= 4 and max(r["count"] for r in blocks) <= 1 + (1 << 20) // row * 1.1
    assert lookup.with_blocks(df.limit(0), "b").count() == 0


@pytest.mark.parametrize("part", [1, 1 << 20])
def test_encode_by_parts_of_a_batch(spark, monkeypatch, part):
    monkeypatch.setattr(K, "PYTHON_BYTES", part)
    df = spark.createDataFrame(ODD, "row_idx BIGINT, text STRING").coalesce(1)
    v = K.Vocab([("<|im_end|>", 0), ("<unk>", 1), ("a", 2), ("b", 3)])
    got = [r.input_ids for r in K.encode(df, v, "text", max_length=2).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [[2, 3], [1], [2, 1], None, [], [2, 3], [1, 2]]))


def test_vocabulary_above_the_bound(spark, frame):
    v = K.build_vocab(frame, "text", 100)
    with pytest.raises(OverflowError):
        K.Vocab.load(v, limit=3)
    whole = K.Vocab.load(v)
    a = sorted(map(tuple, K.decode(K.encode(frame, v), v).select("row_idx", "decoded").collect()))
    assert a == sorted(map(tuple, K.decode(K.encode(frame, whole), whole).select("row_idx", "decoded").collect()))


def test_length_percentiles(spark):
    import math

    lens = [0, 0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 600]
    df = spark.createDataFrame([(" ".join("w" * n),) for n in lens], "text STRING")
    r = K.token_profile(df, max_length=50).first()
    kept = sorted(min(n, 50) for n in lens)
    assert (r.n_rows, r.min_len, r.max_len, r.share_truncated) == (12, 0, 50, round(1 / 12, 6))
    assert [r.p50, r.p90, r.p99] == [kept[math.ceil(q * 12 / 100) - 1] for q in (50, 90, 99)]
    empty = K.token_profile(df.limit(0)).first()
    assert empty.n_rows == 0 and empty.p50 is None


def test_unknown_word(spark, frame):
    v = K.build_vocab(frame, "text", 1)   # only "the"
    out = K.encode(frame, v, "text", max_length=None).filter("row_idx = 0").first().input_ids
    assert out == [2, 1, 1]


@pytest.mark.parametrize("side", ["left", "right"])
def test_pad_and_labels(spark, side):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [8]), (1, [9])], "batch_id INT, input_ids ARRAY<INT>")
    rows = K.pad_batches(df, side=side).withColumn("labels", K.causal_labels("input_ids")).collect()
    got = sorted((r.batch_id, r.input_ids, r.attention_mask, r.labels) for r in rows)
    if side == "left":
        assert (0, [0, 0, 8], [0, 0, 1], [-100, -100, 8]) in got
    else:
        assert (0, [8, 0, 0], [1, 0, 0], [8, -100, -100]) in got
    assert (0, [5, 6, 7], [1, 1, 1], [5, 6, 7]) in got
    assert (1, [9], [1], [9]) in got


def test_drop_prompt_and_special(spark):
    df = spark.createDataFrame([([0, 0, 4, 5, 6, 0],)], "ids ARRAY<INT>")
    r = df.select(K.drop_prompt("ids", 3).alias("a"), K.drop_prompt("ids", 10).alias("b"),
                  K.drop_special("ids").alias("c")).first()
    assert r.a == [5, 6, 0] and r.b == [] and r.c == [4, 5, 6]
    assert F is not None


def test_vocab_ranking_paths_agree(spark):
    from tests.conftest import SF_SMALL

    from distillery.plans import fixtures as FX

    texts = FX.conversation_turns(spark, SF_SMALL).select("text")
    a = sorted(tuple(r) for r in K.build_vocab(texts, "text", 300).collect())
    b = sorted(tuple(r) for r in K.build_vocab(texts, "text", 300).collect())
    assert a == b and len(a) == 302


def test_user_tokenizer_matches_word_vocab(spark, frame):
    """A `tokenizers` WordLevel model built from our vocabulary, plugged in
    through encode_with, gives the same ids as encode."""
    v = K.build_vocab(frame, "text", 100)
    vocab = {r.token: r.token_id for r in v.collect()}

    def factory():
        from tokenizers import Tokenizer
        from tokenizers.models import WordLevel
        from tokenizers.pre_tokenizers import WhitespaceSplit

        tok = Tokenizer(WordLevel(vocab, unk_token="<unk>"))
        tok.pre_tokenizer = WhitespaceSplit()
        return lambda texts: [e.ids for e in tok.encode_batch(texts)]

    a = {r.row_idx: r.input_ids for r in K.encode(frame, v, "text", max_length=2).collect()}
    b = {r.row_idx: r.input_ids for r in K.encode_with(frame, factory, "text", max_length=2).collect()}
    assert a == b
