"""Source divergence audit over run-length columns (operator 13).

Per language, every source has a column of term counts over the language's
vocabulary (the terms that at least three of its documents hold). Sources are
compared by a divergence of their smoothed term shares, in whole billionths.

1. One pass counts terms by (lang, source); counts are combined in the task,
   then dealt by (lang, term), where a term's documents, its count in the
   whole language and its first source follow from one window.
2. Languages are cut into blocks of terms by hash, about ``BLOCK_CELLS``
   counts each, so that a hot language is many tasks. In a block the
   vocabulary is reordered: terms are sorted by their counts, source after
   source, which puts equal counts side by side. Each source's column is then
   run-length encoded; terms that a source does not have are runs of zeros.
3. Two sources are compared run by run: their boundaries are intersected, and
   ``f`` of a common run counts as often as the run is long. Blocks add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distillery.llm import textarrays as ta
from distillery.llm.shared import col, cut

SCALE = 1_000_000_000
MIN_DOCS = 3
TERM_RANKS = 200
BLOCK_CELLS = 500_000    # counts of a block of terms
PART_BYTES = 8 << 20     # text that a task counts before it hands the counts on
OUT_ROWS = 1 << 16       # rows of a batch of counts

# `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` in UTF-8: every byte above ASCII is in a
# term; A-Z read as a-z, what is in no term as the gap
_GAP = 0x20
_TERM_BYTE = ta.LOWER.copy()
_TERM_BYTE[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = _GAP


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and per text the offsets into them."""
    data, off = ta.raw(texts)
    data = _TERM_BYTE[data]
    starts, ends, doc_off = ta.word_spans(data, off)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[data != _GAP])), doc_off


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, text)`` rows to ``(lang, source, term, n, docs)``,
    combined over about ``PART_BYTES`` of text. Terms are told apart by their
    bytes (Arrow's dictionary); one sort by (group, term, row) counts them."""
    for b in batches:
        for lo, texts in ta.slices(b.column(2), PART_BYTES):
            terms, doc_off = _terms(texts)
            if not len(terms):
                continue
            lang, source = (b.column(i).slice(lo, len(texts)).dictionary_encode() for i in (0, 1))
            coded, rows, sources = terms.dictionary_encode(), len(texts), len(source.dictionary)
            group = np.asarray(lang.indices, dtype=np.int64) * sources + np.asarray(source.indices)
            key = np.repeat(group, np.diff(doc_off)) * len(coded.dictionary) + np.asarray(coded.indices)
            key = np.sort(key * rows + np.repeat(np.arange(rows), np.diff(doc_off)))
            cell = key // rows
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            n = np.diff(np.append(first, len(cell)))
            docs = np.add.reduceat(np.diff(key, prepend=-1) != 0, first, dtype=np.int64)
            group, term = np.divmod(cell[first], len(coded.dictionary))
            found = pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group // sources)), source.dictionary.take(pa.array(group % sources)),
                 coded.dictionary.take(pa.array(term)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
            for at in range(0, found.num_rows, OUT_ROWS):
                yield found.slice(at, OUT_ROWS)
    ta.release()


def _share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (n + v))``, exact."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (n + v).cast("decimal(20,0)"))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, source, term, n, all, one)`` of the kept terms: the count in
    the source, in the whole language, and 1 in one row of each term."""
    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    w = Window.partitionBy("lang", "term")
    return (found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("all"),
                    (F.col("source") == F.min("source").over(w)).cast("int").alias("one"))
            .filter(F.col("docs") >= MIN_DOCS).drop("docs"))


def reorder(term: np.ndarray, source: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """The new place of each of ``terms`` terms, from counts sorted by (term,
    source): by the count in the first source, in the next, and so on, so
    that equal counts lie together. A term's key lists (source, falling count)
    pairs and ends behind every source."""
    cell = np.zeros(len(n), dtype=[("source", ">u4"), ("count", ">u8")])
    cell["source"], cell["count"] = source, np.uint64((1 << 64) - 1) - n.astype(np.uint64)
    raw, width = cell.tobytes(), cell.dtype.itemsize
    at = np.searchsorted(term, np.arange(terms + 1)) * width
    keys = [raw[a:b] + b"\xff" * width for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    place = np.empty(terms, dtype=np.int64)
    place[sorted(range(terms), key=keys.__getitem__)] = np.arange(terms)
    return place


def encode_runs(place: np.ndarray, p: np.ndarray, zero: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """A source's column as runs ``(starts, values)``: ``p`` at the sorted
    places, ``zero`` everywhere else."""
    gap = np.diff(place, prepend=-1) > 1
    first = gap.copy()
    first[1:] |= p[1:] != p[:-1]
    first[:1] = True
    ends = np.append(place[1:], terms) > place + 1  # zeros follow
    starts = np.concatenate([place[first], place[ends] + 1, np.zeros(int(len(place) == 0 or place[0] > 0), dtype=np.int64)])
    values = np.concatenate([p[first], np.full(len(starts) - int(first.sum()), zero, dtype=np.int64)])
    order = np.argsort(starts)
    starts, values = starts[order], values[order]
    keep = starts < terms
    return starts[keep], values[keep]


def run_divergence(a: tuple, b: tuple, terms: int) -> tuple[int, int]:
    """``(sum of f(a, b), sum of f(b, a))`` over two encoded columns, with
    ``f(p, q) = floor((p - q)^2 / q)``, run by common run."""
    starts = np.union1d(a[0], b[0])
    length = np.diff(np.append(starts, terms))
    p = a[1][np.searchsorted(a[0], starts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], starts, side="right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _compare(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """All pairs of a language's sources over one block of its terms:
    ``cells(source, term, p, n)`` and ``groups(source, zero)``."""
    g = groups.sort_by("name")
    names, zero = g["name"].to_pylist(), np.asarray(g["zero"])
    number = {s: i for i, s in enumerate(names)}
    out: tuple[list, list, list] = ([], [], [])
    if len(names) > 1:
        source = np.array([number[s] for s in cells["source"].to_pylist()], dtype=np.int64)
        coded = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else None
        terms = len(coded.dictionary) if coded is not None else 0
        term = np.asarray(coded.indices, dtype=np.int64) if coded is not None else source
        order = np.lexsort((source, term))
        source, term = source[order], term[order]
        n, p = np.asarray(cells["n"])[order], np.asarray(cells["p"])[order]
        place = reorder(term, source, n, terms)[term] if terms else term
        order = np.lexsort((place, source))
        place, p = place[order], p[order]
        at = np.searchsorted(source[order], np.arange(len(names) + 1))
        columns = [encode_runs(place[at[i]: at[i + 1]], p[at[i]: at[i + 1]], int(zero[i]), terms) for i in range(len(names))]
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                x, y = run_divergence(columns[i], columns[j], terms) if terms else (0, 0)
                for k, v in enumerate(((names[i], names[j], x), (names[j], names[i], y))):
                    for c, e in zip(out, v, strict=True):
                        c.append(e)
    lang = groups["tongue"][0].as_py() if groups.num_rows else ""
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
                     "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` compares a
    source with each other source of its language, part ``term`` lists its 200
    terms that stand out most against the whole language.

    A null text, language or source is the empty string. A language without
    kept terms has pairs of value 0; one with a single source has no pairs.
    Repeated rows count as documents of their own. Ranks go by falling value,
    then by item; equal values are told apart by the item, which is unique.
    An empty table gives no rows; other columns are not read.
    """
    counts = cut(term_counts(docs, text, lang, source))
    sizes = counts.groupBy("lang").agg(F.sum("one").alias("v"), F.sum("n").alias("nl"), F.count(F.lit(1)).alias("cells"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("ns"))
    names = docs.select(F.coalesce(col(lang).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(col(source).cast("string"), F.lit("")).alias("source")).distinct()
    # one row per (lang, source)
    groups = cut(names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
                 .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ns", "v", "nl", "cells")])
                 .withColumn("blocks", F.expr(f"greatest(1, ceil(cells / {BLOCK_CELLS}))")))
    with_p = cut(counts.join(groups, ["lang", "source"])
                 .select("lang", "source", "term", "n", _share(F.col("n"), F.col("ns"), F.col("v")).alias("p"),
                         _share(F.col("all"), F.col("nl"), F.col("v")).alias("q"),
                         F.expr("pmod(xxhash64(term), blocks)").alias("block")))

    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("ns"), F.col("v"))).otherwise(1)
    sides = groups.select(F.col("lang").alias("tongue"), F.col("source").alias("name"), zero.alias("zero"),
                          F.explode(F.expr("sequence(0L, blocks - 1)")).alias("at"))
    found = (with_p.select("lang", "block", "source", "term", "n", "p").groupBy("lang", "block")
             .cogroup(sides.groupBy("tongue", "at")).applyInArrow(_compare, "lang string, source string, item string, value bigint"))
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    p, q = F.col("p"), F.col("q")
    terms = with_p.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        F.call_function("div", (p - q) * (p - q), q).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TERM_RANKS)
    return pairs.unionByName(terms)
