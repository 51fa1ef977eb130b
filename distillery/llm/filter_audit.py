"""Filter interaction audit by Hart-Mas-Colell potentials (operator 12).

Five document filters A to E are players of a removal game: the value
``v(S)`` of a coalition is the number of documents that fail at least one
filter of ``S``. One distributed pass reduces the documents to counts by
(part, set of failed filters), at most 32 rows a part; everything after
works on these rows:

* ``v(S)`` of all 32 coalitions, also counted over good and toxic documents;
* potentials by the recursion ``P(S) = (v(S) + sum of P(S - i)) / |S|``, kept
  whole as ``Q(S) = |S|! P(S) = (|S| - 1)! v(S) + sum of Q(S - i)``;
* a filter's Shapley value is the grand potential minus the potential without
  it. Times 120 it is the filter's removals summed over all 120 orders:
  ``Q(ABCDE) - 5 Q(ABCDE - i)``, whole again;
* step k of an order is the difference of two coalitions: ``v`` of its first
  k filters minus ``v`` of its first k - 1.

Filter E (equal texts) needs no join: documents meet by a hash of their text,
one row per id and label, then one row per part and label, so that a large
group of copies is combined before it meets (what meets in one row is at most
four entries for each part).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distillery.llm.shared import col

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
MIN_WORDS = 200
_SPACE = " \t\n\x0b\f\r"


def fail_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(_SPACE))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    bits = [n < MIN_WORDS, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length(t).cast("long"), t.rlike(r"[#$%&*|]")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, toxic)``, one row per id: 1 if any of its rows says so."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    return (labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
            .withColumnRenamed("quality", "good"))


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                part: str = "lang") -> DataFrame:
    """``(part, mask, docs, good, toxic)``: documents by part and by the set
    of filters that they fail, and how many of them are good and toxic.

    A null text is empty, a null part the empty string. A document fails E
    if its text is that of a document with a smaller id: rows that share the
    smallest id pass, and so do rows without an id.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256)).alias("same"),
                       fail_mask(col(text)).alias("mask"))
    rows = rows.join(label_flags(labels), "doc_id", "left").withColumn(
        "good", F.coalesce("good", F.lit(0))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    kind = ["same", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    # one row per text, part and label: its rows, those without an id, its
    # smallest id and the rows that have it
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    least = groups.groupBy("same").agg(
        F.min("least.doc_id").alias("first"),
        F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "free", "least")).alias("g"))
    g = F.col("g")
    parted = least.select("first", F.explode("g").alias("g")).select(
        "first", g["part"].alias("part"), g["mask"].alias("mask"), g["good"].alias("good"), g["toxic"].alias("toxic"),
        g["n"].alias("n"), (g["free"] + F.when(g["least"]["doc_id"] == F.col("first"), g["least"]["n"]).otherwise(0)).alias("kept"))
    fails_e = 1 << FILTERS.index("E")
    split = parted.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("kept").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(fails_e)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    return (split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"))
            .agg(F.sum("x.n").alias("docs"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
                 F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")))


def coalition_values(fails: np.ndarray) -> np.ndarray:
    """``v`` by coalition: the documents that fail at least one of its
    filters. ``fails[.., mask]``: documents by the set of filters they fail."""
    return np.stack([fails[..., [m for m in range(EVERY + 1) if m & s]].sum(axis=-1) for s in range(EVERY + 1)], axis=-1)


def potentials(v: np.ndarray) -> np.ndarray:
    """``|S|! P(S)`` by coalition, each from those with one filter less."""
    q = np.zeros_like(v)
    for s in sorted(range(1, EVERY + 1), key=lambda s: bin(s).count("1")):
        q[..., s] = factorial(bin(s).count("1") - 1) * v[..., s]
        for i in range(len(FILTERS)):
            if s >> i & 1:
                q[..., s] += q[..., s & ~(1 << i)]
    return q


_ROWS = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
         "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, cells)``, a cell being ``(mask, docs, good, toxic)``, to
    the steps of all orders; slices of the parts keep the result small."""
    orders = list(permutations(range(len(FILTERS))))
    for whole in batches:
        for lo in range(0, whole.num_rows, 64):
            b = whole.slice(lo, 64)
            cells = np.zeros((3, b.num_rows, EVERY + 1), dtype=np.int64)
            for r, found in enumerate(b.column(1).to_pylist()):
                for c in found:
                    cells[:, r, c["mask"]] += (c["docs"], c["good"], c["toxic"])
            v, good, toxic = coalition_values(cells)
            total = cells[0].sum(axis=-1)
            q = potentials(v)
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for p in orders:
                before = 0
                for i in p:
                    after, one = before | 1 << i, 1 << i
                    removed = v[:, after] - v[:, before]
                    row = (total - v[:, after], removed, v[:, one] - removed, v[:, EVERY] - v[:, EVERY ^ one],
                           good[:, after] - good[:, before], toxic[:, after] - toxic[:, before],
                           q[:, EVERY] - len(FILTERS) * q[:, EVERY ^ one])
                    for k, x in enumerate(row):
                        cols[k].append(x)
                    before = after
            steps = len(orders) * len(FILTERS)
            names = ["".join(FILTERS[i] for i in p) for p in orders for _ in p]
            part = b.column(0).take(pa.array(np.tile(np.arange(b.num_rows), steps)))
            yield pa.RecordBatch.from_arrays(
                [part.cast(pa.string()), pa.array(np.repeat(names, b.num_rows).tolist()),
                 pa.array(np.repeat(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders)), b.num_rows)),
                 *[pa.array(np.concatenate(x)) for x in cols]],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_interactions(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                        part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: ``(part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``, as whole numbers of documents of the part.

    ``redundant``: documents that fail the step's filter but were removed
    before; ``unique_fails``: those that fail it alone; ``shapley``: the
    filter's removals summed over all orders. Nulls as in ``mask_counts``;
    labels without an id, or with other values than 1, count for nothing; a
    repeated label row counts once, a repeated document as often as it is
    there. A part without failing documents has rows of zeros; an empty table
    has no parts and no rows. Other columns are not read.
    """
    counts = mask_counts(docs, labels, text, doc_id, part)
    # at most 32 cells a part
    games = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return games.mapInArrow(_play, _ROWS)
