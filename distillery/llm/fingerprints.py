"""Document fingerprints by one-permutation MinHash (operator 3).

Native: SQL functions only. Each text's 5-word shingles are hashed once;
the top bits of a hash name its bin, and a bin keeps its least hash.
Empty bins borrow from another bin that holds a value, trying bins by a
hash of their own number and the attempt (optimal densification), so that
similar texts borrow the same bins. A fingerprint stores the low
8 bits of every bin as hex; the likeness of two fingerprints is the share
of equal bins, corrected for the 1/256 of unequal bins that agree by
chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distillery.llm.shared import col, cut

BINS = 128
BITS = 8
SHINGLE_WORDS = 5


def _borrow(m: str, bins: int) -> str:
    """SQL for the bin that the empty bin ``i`` borrows from: the first filled
    one among ``hash(i, attempt)``, attempts 1, 2, ... Few texts need more
    than 32 attempts; the least filled bin ends the search."""
    def first(lo: int, hi: int) -> str:
        tries = f"transform(sequence({lo}, {hi}), a -> cast(pmod(xxhash64(i, a), {bins}L) as tinyint))"
        return f"get(filter({tries}, j -> {m}[j] IS NOT NULL), 0)"
    return f"coalesce({first(1, 32)}, {first(33, 16 * bins)}, array_min(map_keys({m})))"


def with_fingerprint(df: DataFrame, text: Column, out: str, bins: int = BINS) -> DataFrame:
    """Add the fingerprint of ``text`` as the column ``out``.

    A null or blank text has the empty string as its fingerprint; a text of
    fewer than five words has one shingle, all its words. Equal texts have
    equal fingerprints.
    """
    shift = 64 - (bins - 1).bit_length()
    last = SHINGLE_WORDS - 1
    w, h, m = f"{out}__w", f"{out}__h", f"{out}__m"
    df = df.withColumn(w, F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    # hash every word once, then combine runs of five
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    run = ", ".join(f"`{w}`[i + {k}]" for k in range(SHINGLE_WORDS))
    df = df.withColumn(h, F.expr(f"""
        CASE WHEN size(`{w}`) = 0 THEN array()
             WHEN size(`{w}`) <= {last} THEN array(xxhash64(`{w}`))
             ELSE transform(sequence(0, size(`{w}`) - {SHINGLE_WORDS}), i -> xxhash64({run})) END"""))
    # ascending order puts each bin's least hash first in its run of equal top bits
    df = df.withColumn(h, F.sort_array(h))
    df = df.withColumn(m, F.expr(f"filter(`{h}`, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright(`{h}`[i - 1], {shift}))"))
    low = f"cast(x & {(1 << BITS) - 1} as int)"
    df = df.withColumn(m, F.expr(f"""
        map_from_arrays(transform(`{m}`, x -> cast(shiftright(x, {shift}) + {bins // 2} as tinyint)),
                        transform(`{m}`, x -> substr(hex(256 + {low}), 2)))"""))
    df = df.withColumn(out, F.expr(f"""
        CASE WHEN size(`{m}`) = 0 THEN ''
             ELSE array_join(transform(sequence(0, {bins - 1}), i ->
                    coalesce(`{m}`[cast(i as tinyint)], `{m}`[{_borrow(f"`{m}`", bins)}])), '') END"""))
    return df.drop(w, h, m)


def likeness(a: str, b: str, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1. Two empty
    fingerprints are alike; an empty one is unlike any other."""
    chance = 1.0 / (1 << BITS)
    return F.expr(f"""
        CASE WHEN `{a}` = `{b}` THEN 1.0D
             WHEN `{a}` = '' OR `{b}` = '' OR `{a}` IS NULL OR `{b}` IS NULL THEN 0.0D
             ELSE greatest(0.0D, (size(filter(sequence(0, {bins - 1}), i ->
                    substr(`{a}`, 2 * i + 1, 2) = substr(`{b}`, 2 * i + 1, 2))) / {bins}D - {chance}D) / {1 - chance}D) END""")


def _range_of(key: str, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below the key (0 for a
    null), by binary search."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    bounds = F.array(*[F.lit(c) for c in cuts])

    def step(lo, k):
        jump = F.call_function("shiftleft", F.lit(1), F.lit(steps) - k)
        return F.when(F.coalesce(F.get(bounds, lo + jump - 1) <= F.col(key), F.lit(False)), lo + jump).otherwise(lo)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step)


def with_following(df: DataFrame, keys: list[str], derive, values: list[str], prefix: str = "next_",
                   rows_per_range: int = 1_000, most_ranges: int = 100_000) -> DataFrame:
    """The next row's ``values`` in the order of ``keys``, the first row's
    after the last; every row gets one (its own in a table of one row).

    Rows are cut into ranges of the first key (a long) whose bounds are
    approximate quantiles; ``lead`` works inside a range, and each range's
    last row takes the first row of the next range that has any. Only the
    bounds and the number of each filled range reach the driver. Nulls come
    first. ``derive`` adds costly columns to rows of ``df``; it is applied once
    to all rows and once to the first rows of the ranges only.
    """
    n = df.count()
    ranges = max(1, min(most_ranges, n // rows_per_range))
    cuts = []
    if ranges > 1:
        q = df.select(F.percentile_approx(keys[0], [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
        cuts = sorted(set(q or []))
    b = "__range"
    df = df.withColumn(b, _range_of(keys[0], cuts))
    order = [F.col(k).asc_nulls_first() for k in keys]
    packed = F.struct(*[F.col(v) for v in values])
    first_keys = cut(df.groupBy(b).agg(F.min(F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)) for k in keys])).alias("k")))
    have = sorted(r[0] for r in first_keys.select(b).collect())
    wanted = df.sparkSession.createDataFrame(
        [(at, have[(i + 1) % len(have)]) for i, at in enumerate(have)], "__for int, __at int")
    names = [f"__k{i}" for i in range(len(keys))]
    first_keys = first_keys.select(F.col(b).alias("__at"), *[F.col("k").getField(f"col{i + 1}").getField(k).alias(x)
                                                             for i, (k, x) in enumerate(zip(keys, names, strict=True))])
    # at most `most_ranges` short rows: small enough for every task
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, names, strict=True)]
    firsts = (derive(df.join(F.broadcast(first_keys), [F.col(b) == F.col("__at"), *same]).dropDuplicates(["__at"]))
              .select("__at", packed.alias("__first")))
    firsts = firsts.join(wanted, "__at").select(F.col("__for").alias(b), "__first")
    df = derive(df).withColumn("__next", F.lead(packed).over(Window.partitionBy(b).orderBy(*order)))
    nxt = F.coalesce("__next", "__first")
    return (df.join(firsts, b, "left").withColumn("__next", nxt)
            .select("*", *[F.col(f"__next.{v}").alias(prefix + v) for v in values])
            .drop(b, "__next", "__first"))


def fingerprint_report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter
    replaced by the beginning of the next document, in the order of ids).

    A null text counts as empty. Repeated ids are ordered by length and
    text hash; null ids come first; an empty table gives no rows; other
    columns are not read.
    """
    rows = df.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    rows = with_following(rows, ["doc_id", "n_chars", "tie"], lambda d: with_fingerprint(d, F.col("text"), "fingerprint"),
                          ["text", "fingerprint"])
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"),
                                              F.left(F.col("next_text"), tail)))
    rows = with_fingerprint(rows, F.col("edited"), "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "next_fingerprint").alias("near_next"))
