"""Quality classifier: histogram gradient-boosted trees (operator 1).

Whole-text statistics are taken from the UTF-8 bytes with numpy. Trees are
grown level by level: each level is one Spark job that sums gradients and
hessians into (node, feature, bin) histograms over all labelled rows; only
those sums, whose number does not depend on the data, reach the driver.
The fitted trees are flattened into arrays, and scoring walks all trees of
a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm.shared import col, cut, likely

FEATURES = ("log_bytes", "log_words", "bytes_per_word", "chars_per_byte", "upper", "digits", "stops", "commas",
            "shouts", "pipes", "symbols", "other_punct", "newlines", "lines_per_word", "distinct_words",
            "top_word", "repeat_next", "upper_start", "symbol_end", "dup_lines", "dup_windows", "spaces")

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#*$%&<>^~=+@\\{}[]_",
                             b"\"'()-/:;`", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_CLASSES = 11


def text_features(arr: pa.Array) -> np.ndarray:
    """``(rows, len(FEATURES))``; an empty or null text is all zero."""
    out = np.zeros((len(arr), len(FEATURES)), dtype=np.float64)
    for lo, part in ta.slices(arr):
        out[lo: lo + len(part)] = _features(*ta.raw(part))
    return out


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(doc * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) if n else None
    chars = np.bincount(doc, weights=ta.LEAD[data], minlength=n)
    starts, ends, at = ta.word_spans(data, off)
    words = np.diff(at).astype(np.float64)
    h = ta.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(at))
    per = lambda flag, of: np.bincount(of, weights=flag, minlength=n)
    cls = _CLASS[data]
    upper_start = per(cls[starts] == 1, owner) if len(starts) else np.zeros(n)
    symbol_end = per(np.isin(cls[ends - 1], (5, 6, 7)), owner) if len(starts) else np.zeros(n)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _repeats(h, at)
    win, win_at = ta.windows(h, at, 5)
    win_distinct, _ = _repeats(win, win_at)
    # lines: byte spans between newlines that hold anything
    is_nl = data == 10
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first, last = ~is_nl, ~is_nl
    first[1:] &= is_nl[:-1] | edge[1:-1]
    last[:-1] &= is_nl[1:] | edge[1:-1]
    ls, le = np.flatnonzero(first), np.flatnonzero(last) + 1
    line_at = np.searchsorted(ls, off)
    lines = np.diff(line_at).astype(np.float64)
    line_distinct, _ = _repeats(ta.span_hashes(data, ls, le), line_at)
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    runs = np.maximum(np.diff(win_at), 1)
    k = kinds / b[:, None]
    cols = [np.log1p(size), np.log1p(words), size / w, chars / b, k[:, 1], k[:, 2], k[:, 3], k[:, 4], k[:, 5], k[:, 6],
            k[:, 7], k[:, 8], k[:, 9], lines / w, distinct / w, top / w, per(again, owner) / w, upper_start / w,
            symbol_end / w, (lines - line_distinct) / np.maximum(lines, 1), (np.diff(win_at) - win_distinct) / runs, k[:, 10]]
    return np.where(size[:, None] > 0, np.stack(cols, axis=1), 0.0)


def _repeats(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, per text."""
    distinct, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for i in range(len(at) - 1):
        if at[i + 1] > at[i]:
            s = np.sort(h[at[i]: at[i + 1]])
            cuts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
            distinct[i] = len(cuts) - 1
            top[i] = np.diff(cuts).max()
    return distinct, top


@dataclass
class TreeModel:
    """All trees in flat arrays; a leaf has ``feature`` -1. ``left`` and
    ``right`` are node numbers in the same arrays."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    depth: int = 0
    base: float = 0.0

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Node reached in each of the trees ``roots``: ``(rows, trees)``."""
        at = np.tile(roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            nxt = np.where(x[row, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f >= 0, nxt, at)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        return self.base + self.value[self.leaves(x, self.roots)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def add(self, feature=-1, threshold=0.0, value=0.0) -> int:
        self.feature = np.append(self.feature, feature)
        self.threshold = np.append(self.threshold, threshold)
        self.left, self.right = np.append(self.left, 0), np.append(self.right, 0)
        self.value = np.append(self.value, value)
        return len(self.feature) - 1


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, bins: int = 32, rate: float = 0.4,
        ridge: float = 1.0, min_hessian: float = 1.0) -> TreeModel:
    """Boost trees on ``rows(x array<double>, y int)``, all of them.

    Without rows of both labels there is nothing to split and every score
    is the share of label 1 (0.5 without any row).
    """
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return TreeModel()
    share = min(max(ones / n, 1e-3), 1 - 1e-3)
    model = TreeModel(base=math.log(share / (1 - share)))
    if ones in (0, n):
        return model
    cuts = [i / bins for i in range(1, bins)]
    edges = rows.agg(*[F.percentile_approx(F.col("x")[i], F.array(*map(F.lit, cuts)), 2000).alias(f"e{i}")
                       for i in range(len(FEATURES))]).first()
    edges = [np.unique(np.array(e, dtype=np.float64)) for e in edges]
    for _ in range(trees):
        root = model.add()
        open_nodes = [root]
        model.roots, model.depth = np.append(model.roots, root), max(model.depth, depth)
        done = TreeModel(**{**model.__dict__, "roots": model.roots[:-1]})  # the trees so far give the gradients
        for level in range(depth + 1):
            sums = _histograms(rows, done, model, root, open_nodes, edges, last=level == depth)
            grown = []
            for node in open_nodes:
                g, h = sums[node]
                best = None
                total_g, total_h = g[0].sum(), h[0].sum()
                model.value[node] = -rate * total_g / (total_h + ridge)
                if level == depth:
                    continue
                for f in range(len(FEATURES)):
                    gl, hl = np.cumsum(g[f])[:-1], np.cumsum(h[f])[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - total_g ** 2 / (total_h + ridge)
                    gain = np.where((hl >= min_hessian) & (hr >= min_hessian), gain, -1.0)[: len(edges[f])]
                    if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                        best = (gain.max(), f, edges[f][int(gain.argmax())])
                if best:
                    model.feature[node], model.threshold[node] = best[1], best[2]
                    a, b = model.add(), model.add()
                    model.left[node], model.right[node] = a, b
                    grown += [a, b]
            open_nodes = grown
            if not open_nodes:
                break
    return model


def _histograms(rows: DataFrame, done: TreeModel, model: TreeModel, root: int, nodes: list[int],
                edges: list[np.ndarray], last: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient and hessian sums by (node, feature, bin). The last level needs
    only the sums of its nodes, which the first feature's bins hold."""
    width = max(len(e) for e in edges) + 1
    feats = 1 if last else len(FEATURES)
    tree = TreeModel(**model.__dict__)
    slot_of = np.full(len(tree.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    cells = len(nodes) * feats * width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(cells), np.zeros(cells)
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, len(FEATURES))
            y = np.asarray(b.column(1)).astype(np.float64)
            slot = slot_of[tree.leaves(x, np.array([root]))[:, 0]]
            p = done.score(x)
            keep = slot >= 0
            for f in range(feats):
                cell = (slot[keep] * feats + f) * width + np.searchsorted(edges[f], x[keep, f])
                g += np.bincount(cell, weights=(p - y)[keep], minlength=cells)
                h += np.bincount(cell, weights=(p * (1 - p))[keep], minlength=cells)
        used = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(g[used]), pa.array(h[used])], ["cell", "g", "h"])

    found = (rows.select("x", "y").mapInArrow(partial, "cell bigint, g double, h double")
             .groupBy("cell").agg(F.sum("g"), F.sum("h")).collect())
    g, h = np.zeros(cells), np.zeros(cells)
    for c, a, b in found:
        g[c], h[c] = a, b
    shape = (len(nodes), feats, width)
    return {v: (g.reshape(shape)[i], h.reshape(shape)[i]) for i, v in enumerate(nodes)}


def features_column(text: str):
    def f(arr: pa.Array) -> pa.Array:
        x = text_features(arr)
        off = np.arange(len(arr) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(x.reshape(-1)))
    return arrow_udf(f, "array<double>")(col(text))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on_labels(feats: DataFrame, labels: DataFrame, rows_per_task: int = 20_000, **options) -> TreeModel:
    """Fit on ``feats(doc_id, x)`` joined with ``labels(doc_id, quality)``,
    without the held-out rows. Null qualities and null ids are not used;
    repeated rows count as often as they come."""
    y = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)")
    y = y.filter(~held_out(F.col("doc_id")))
    tasks = max(1, math.ceil(y.count() / rows_per_task))
    rows = cut(likely(feats, y, "doc_id").join(y, "doc_id").select("x", "y").repartition(tasks))
    return fit(rows, **options)


def score_features(model: TreeModel, x):
    def f(arr: pa.Array) -> pa.Array:
        return pa.array(model.score(np.asarray(arr.flatten()).reshape(-1, len(FEATURES))))
    return arrow_udf(f, "double")(x)


def score_text(model: TreeModel, text: str):
    def f(arr: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(arr)))
    return arrow_udf(f, "double")(col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Only the text enters a score: null and empty texts get the score of the
    all-zero statistics, equal texts equal scores, repeated rows a row each;
    an empty table gives none. ``predicted`` is 1 from a score of 0.5.
    """
    feats = cut(docs.select(col("doc_id").alias("doc_id"), features_column("text").alias("x")))
    model = fit_on_labels(feats, labels, **options)
    return (feats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_features(model, F.col("x")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier predicts 1."""
    # of documents without a label only the score is needed
    feats = likely(docs, labels, "doc_id").select(col("doc_id").alias("doc_id"), features_column("text").alias("x"))
    model = fit_on_labels(feats, labels, **options)
    return docs.filter(score_text(model, "text") >= 0.5)
