"""Vocabulary, encode/decode, truncate, pad, labels.

Words are Python ``str.split()`` words. The vocabulary reserves id 0 for
the end/pad token ``<|im_end|>`` and id 1 for ``<unk>``; words follow from
id 2 by descending count, ties by token.

A vocabulary comes in one of two forms, and encoding and decoding give the
same rows with both:

* ``Vocab``: collected, its number of entries checked against a bound when it
  is loaded. It is shipped once per executor and each Arrow batch is encoded
  with a dict lookup: map-only, no token row is shuffled.
* a DataFrame of any size: blocks of rows look up their distinct words in a
  shuffle join (``operators.lookup``).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O
from distillery.functions.text import words
from distillery.operators.lookup import PYTHON_BYTES, map_items

RESERVED = [O.PAD_TOKEN, O.UNK_TOKEN]
PAD_ID, UNK_ID = 0, 1
MAX_BROADCAST_ENTRIES = 1 << 21


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_vocab(texts: DataFrame, col: str = "text", size: int = 32000) -> DataFrame:
    """H4 + H5: ``(token, token_id, n)``; reserved rows have ``n`` null.

    No step funnels the token universe through one task:

    1. word counts are a partial aggregate (frequent words combine
       map-side), checkpointed;
    2. histograms of the counts (power-of-two buckets, then 256 equal parts
       of the part where the cut falls, until it is one count wide; each
       a collect of at most 256 rows) give the cut count ``c`` so that at
       least ``size`` tokens have ``n >= c``;
    3. only those candidates are ranked, by (n desc, token asc), with the
       distributed row index. Ranks below ``size`` are kept.
    """
    if size <= 0:
        raise ValueError("size must be > 0")
    from distillery.operators.order import with_row_index

    w = texts.select(F.explode(words(col)).alias("token"))
    counts = (w.filter(~F.col("token").isin(RESERVED))
               .groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n"))).checkpoint(eager=True)
    # narrow the range [low, high) of counts that holds the cut
    low, high, above = 1, 1 << 62, 0
    part = F.floor(F.log2(F.col("n"))).cast("bigint")
    edges = lambda i: (1 << i, 1 << (i + 1))
    while True:
        hist = sorted(((r["b"], r["count"]) for r in counts.filter(F.col("n").between(low, high - 1))
                       .groupBy(part.alias("b")).count().collect()), reverse=True)
        hit = None
        for b, c in hist:
            if above + c >= size:
                hit = b
                break
            above += c
        if hit is None:                 # fewer than `size` distinct tokens: keep all
            cut = 0
            break
        low, high = edges(hit)
        if high - low <= 1:
            cut = low
            break
        step, base = max(1, -(-(high - low) // 256)), low
        part = F.floor((F.col("n") - F.lit(base)) / F.lit(step)).cast("bigint")
        edges = lambda i, base=base, step=step, top=high: (base + i * step, min(base + (i + 1) * step, top))
    candidates = counts.filter(F.col("n") >= F.lit(cut)).withColumn("_neg", -F.col("n"))
    ranked = with_row_index(candidates, ["_neg", "token"], "_rank", materialize_input=False)
    numbered = (ranked.filter(F.col("_rank") < size)
                .withColumn("token_id", (F.col("_rank") + F.lit(len(RESERVED))).cast("int")))
    spark = texts.sparkSession
    reserved = spark.createDataFrame([(t, i, None) for i, t in enumerate(RESERVED)],
                                     "token STRING, token_id INT, n BIGINT")
    return reserved.unionByName(numbered.select("token", "token_id", "n"))


class Vocab:
    """A collected vocabulary whose size was checked against a bound; build
    once, use for any number of encode / decode calls."""

    def __init__(self, pairs: list[tuple[str, int]]):
        self.pairs = pairs

    @classmethod
    def load(cls, vocab: DataFrame, limit: int = MAX_BROADCAST_ENTRIES) -> "Vocab":
        rows = vocab.select("token", "token_id").limit(limit + 1).collect()
        if len(rows) > limit:
            raise OverflowError("vocabulary larger than the broadcast bound; pass it as a DataFrame instead")
        return cls([(r[0], int(r[1])) for r in rows])

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.pairs, "token STRING, token_id INT")


def _method(vocab, method: str | None) -> str:
    """By default the form of the vocabulary decides."""
    method = method or ("arrow" if isinstance(vocab, Vocab) else "join")
    if method not in ("arrow", "join"):
        raise ValueError(f"unknown method {method!r}")
    return method


def _loaded(vocab) -> "Vocab":
    return vocab if isinstance(vocab, Vocab) else Vocab.load(vocab)


def _framed(vocab, spark) -> DataFrame:
    return vocab.frame(spark) if isinstance(vocab, Vocab) else vocab


def encode(df: DataFrame, vocab, col: str = "text", out: str = "input_ids",
           max_length: int | None = O.SFT_MAX_LENGTH, method: str | None = None) -> DataFrame:
    """H6 + H7: ``out ARRAY<INT>`` of token ids, truncated to ``max_length``.

    The whole text is split; only the id list is cut. Unknown words map
    to ``<unk>``; a text with no words gives an empty array; null gives null.
    ``method`` forces one of the two forms (``arrow``, ``join``).
    """
    if _method(vocab, method) == "arrow":
        return _encode_arrow(df, _loaded(vocab).pairs, col, out, max_length)
    ws = words(_c(col))
    if max_length is not None:
        ws = F.slice(ws, 1, max_length)
    table = _framed(vocab, df.sparkSession).select(F.col("token").alias("item"), F.col("token_id").alias("value"))

    def ids(texts, known):
        return [None if t is None else _ids(t, known.get, max_length) for t in texts.to_pylist()]

    return map_items(df, ws, table, ids, col, out, T.ArrayType(T.IntegerType()))


def _ids(text: str, get, limit: int | None) -> list[int]:
    # the text behind the last wanted word is not split
    ws = text.split() if limit is None else text.split(None, limit)[:limit]
    return [get(w, UNK_ID) for w in ws]


def _encode_arrow(df, pairs, col, out, max_length):
    import pyarrow as pa

    bc = df.sparkSession.sparkContext.broadcast(dict(pairs))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _enc(texts: pa.Array) -> pa.Array:
        get, kind = bc.value.get, pa.list_(pa.int32())
        # not all texts and ids of a batch are Python objects at a time
        step = max(1, PYTHON_BYTES * len(texts) // max(texts.nbytes, 1))
        return pa.concat_arrays([pa.array([], kind)] + [
            pa.array([None if t is None else _ids(t, get, max_length) for t in texts.slice(lo, step).to_pylist()], kind)
            for lo in range(0, len(texts), step)])

    return df.withColumn(out, _enc(_c(col)))


def decode(df: DataFrame, vocab, col: str = "input_ids", out: str = "decoded",
           skip_special: bool = True, method: str | None = None) -> DataFrame:
    """H10 (+ F4): ids -> space-joined words; special ids dropped when
    ``skip_special``. Ids outside the vocabulary read as ``<unk>``; null
    gives null. ``method`` as in ``encode``."""
    specials = {PAD_ID} if skip_special else set()

    def text(ids, get):
        return None if ids is None else " ".join(get(int(i), O.UNK_TOKEN) for i in ids if int(i) not in specials)

    if _method(vocab, method) == "join":
        table = _framed(vocab, df.sparkSession).select(F.col("token_id").alias("item"), F.col("token").alias("value"))
        return map_items(df, _c(col), table, lambda rows, known: [text(r, known.get) for r in rows.to_pylist()],
                         col, out, T.StringType())
    import pandas as pd

    bc = df.sparkSession.sparkContext.broadcast({i: t for t, i in _loaded(vocab).pairs})

    @F.pandas_udf(T.StringType())
    def _dec(s: pd.Series) -> pd.Series:
        get = bc.value.get
        return s.map(lambda ids: text(ids, get))

    return df.withColumn(out, _dec(_c(col)))


def truncate(ids, max_length: int) -> Column:
    """H7 on an id array."""
    return F.slice(_c(ids), 1, max_length)


def pad_batches(df: DataFrame, col: str = "input_ids", batch: str = "batch_id",
                side: str = "left", pad_id: int = PAD_ID, out: str = "input_ids",
                mask: str = "attention_mask") -> DataFrame:
    """H8: pad every row to the longest row of its batch; attention mask.

    One window per batch (batches are small, fixed-size groups).
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    n = F.size(_c(col))
    longest = F.max(n).over(Window.partitionBy(batch))
    df = df.withColumn("_L", longest).withColumn("_n", n)
    pad = F.array_repeat(F.lit(pad_id), F.col("_L") - F.col("_n"))
    zeros = F.array_repeat(F.lit(0), F.col("_L") - F.col("_n"))
    ones = F.array_repeat(F.lit(1), F.col("_n"))
    if side == "left":
        ids, m = F.concat(pad, _c(col)), F.concat(zeros, ones)
    else:
        ids, m = F.concat(_c(col), pad), F.concat(ones, zeros)
    return df.withColumn(out, ids).withColumn(mask, m).drop("_L", "_n")


def causal_labels(ids, pad_id: int = PAD_ID) -> Column:
    """H9: labels = ids with pad positions set to -100 (true end tokens
    are masked too when pad equals end-of-text)."""
    return F.transform(_c(ids), lambda x: F.when(x == F.lit(pad_id), F.lit(O.IGNORE_INDEX)).otherwise(x))


def drop_prompt(ids, prompt_len) -> Column:
    """the ids after the first ``prompt_len`` (the padded prompt)."""
    p = F.lit(prompt_len) if isinstance(prompt_len, int) else _c(prompt_len)
    return F.slice(_c(ids), p + F.lit(1), F.greatest(F.size(_c(ids)) - p, F.lit(0)))


def drop_special(ids, special_ids=(PAD_ID,)) -> Column:
    """remove special ids."""
    sp = F.array(*[F.lit(i) for i in special_ids])
    return F.filter(_c(ids), lambda x: ~F.array_contains(sp, x))


def ids_text(ids) -> Column:
    """Comma-joined ids (for reports and comparisons)."""
    return F.array_join(F.transform(_c(ids), lambda x: x.cast("string")), ",")


def token_profile(df: DataFrame, text: str = "text", max_length: int = O.KD_MAX_LENGTH,
                  percentiles: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Count, min / max / mean token length after truncation, the share
    of rows that were truncated, and exact percentiles ``p50``, ... (the
    smallest length that at least so many percent of the rows do not exceed).

    Lengths are whole numbers up to ``max_length``, so one partial aggregate
    by length is a histogram of at most ``max_length + 1`` rows; everything is
    read off it. Rows without a text are not counted in it."""
    full = F.size(words(text)).cast("bigint")
    limit = F.lit(max_length).cast("bigint")
    hist = (df.filter(F.col(text).isNotNull()).select(full.alias("_full")).groupBy(F.least("_full", limit).alias("_kept"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("_n"), F.count_if(F.col("_full") > limit).alias("_cut")))
    up = Window.orderBy("_kept").rowsBetween(Window.unboundedPreceding, 0)  # over the histogram
    n = F.sum("_n")
    ranked = hist.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return ranked.agg(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_rows"),
        F.min("_kept").cast("bigint").alias("min_len"),
        F.max("_kept").cast("bigint").alias("max_len"),
        F.round(F.sum(F.col("_kept") * F.col("_n")) / n, 6).alias("mean_len"),
        F.round(F.sum("_cut") / n, 6).alias("share_truncated"),
        *[F.min(F.when(100 * F.col("_upto") >= q * F.col("_all"), F.col("_kept"))).cast("bigint").alias(f"p{q}") for q in percentiles])


def encode_with(df: DataFrame, factory, col: str = "text", out: str = "input_ids",
                max_length: int | None = O.SFT_MAX_LENGTH) -> DataFrame:
    """H6 with a user tokenizer (e.g. a pretrained subword model).

    ``factory()`` returns a callable ``list[str] -> list[list[int]]``; it is
    built once per Python worker (a tokenizer file is loaded once) and
    applied to whole Arrow batches. Ids are cut to ``max_length``. Map-only.
    """
    import pandas as pd

    from distillery.operators.generate import _factory_key, _worker_store

    key = "tok-" + _factory_key(factory)
    limit = max_length

    def enc(s: pd.Series) -> pd.Series:
        store = _worker_store()
        fn = store.get(key)
        if fn is None:
            fn = store[key] = factory()
        texts = s.tolist()
        live = [i for i, t in enumerate(texts) if t is not None]
        res = [None] * len(texts)
        ids = fn([texts[i] for i in live]) if live else []
        for i, v in zip(live, ids):
            v = [int(x) for x in v]
            res[i] = v[:limit] if limit is not None else v
        return pd.Series(res, dtype=object)

    return df.withColumn(out, F.pandas_udf(enc, T.ArrayType(T.IntegerType()))(F.col(col)))
