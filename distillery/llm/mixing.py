"""Mixing sources to target weights by soft membership (operator 6).

A classifier fitted on a table of labelled documents predicts each
document's domain posteriors. Nonnegative document rates are then fitted so
that the expected tokens of each domain meet their targets:

    minimise  || sum_d rate_d * tokens_d * posterior_d  -  target ||^2,  rate_d >= 0,

with a small ridge that draws rates to 1 (``RIDGE``), so that the rates are
unique and a domain with next to no tokens cannot drive them beyond all
measure. The gradient by a rate is ``tokens_d`` times its posteriors' product
with the residual, so at the optimum ``rate_d = max(0, 1 + posterior_d .
lambda)`` for one short vector lambda, and projected gradient steps need only
move lambda. Steps are whitened by the Gram matrix of the posteriors of
documents with a rate above zero, and halved as long as they do not help. Each
is one Spark aggregate over all documents: the domain totals, the Gram matrix
and the objective under the present rates.

The classifier is a naive Bayes model over hashed pieces of text (words and
runs of punctuation), by presence, with its counts shrunk towards the
background; its temperature is chosen on the held-out labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.shared import col, cut, free_name, matching

FEATURES = 1 << 16
SHRINK = 0.1  # pseudo-documents of background, as a share of the labelled documents
RIDGE = 1e-6   # of the mean square of the posteriors, weighted by tokens
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def _pieces(arr: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(tokens, sorted distinct feature numbers)`` of each text. Tokens are
    pieces: words, cut where ASCII letters meet punctuation."""
    for _, part in ta.slices(arr):
        data, off = ta.raw(part)
        data = ta.LOWER[data]
        starts, ends, at = vocab.piece_spans(data, off)
        f = (ta.span_hashes(data, starts, ends) >> np.uint64(48)).astype(np.uint16)
        for i in range(len(part)):
            yield int(at[i + 1] - at[i]), np.unique(f[at[i]: at[i + 1]])


def _piece_column(text: str) -> Column:
    def f(arr: pa.Array) -> pa.Array:
        n, feats = [], []
        for tokens, x in _pieces(arr):
            n.append(tokens)
            feats.append(x.tobytes())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(feats, pa.binary())], ["tokens", "f"])
    return arrow_udf(f, "struct<tokens:bigint,f:binary>")(col(text))


@dataclass
class SoftModel:
    """Log-odds by (feature, domain), log priors, and the temperature."""

    domains: list[str]
    weights: np.ndarray
    prior: np.ndarray
    temperature: float = 1.0

    def logits(self, feats: list[np.ndarray]) -> np.ndarray:
        out = np.tile(self.prior, (len(feats), 1))
        for i, f in enumerate(feats):
            out[i] += self.weights[f].sum(axis=0) / self.temperature
        return out

    def posteriors(self, feats: list[np.ndarray]) -> np.ndarray:
        z = self.logits(feats)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _unpacked(arr: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", dtype=np.uint16) for x in arr]


def fit(feats: DataFrame, labelled: DataFrame) -> SoftModel | None:
    """Fit on ``feats(doc_id, f)`` and ``labelled(doc_id, domain)``. A third
    of the labelled rows (by id) is held out for the temperature. None
    without labelled rows."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(0))
    rows = cut(matching(feats, labelled.filter("domain IS NOT NULL"), "doc_id").select("f", "domain", fold.alias("fold")))
    sizes = {r["domain"]: (r["n"], r["h"]) for r in
             rows.groupBy("domain").agg(F.count_if(F.expr("fold <> 1")).alias("n"), F.count_if(F.expr("fold = 1")).alias("h")).collect()}
    domains = sorted(d for d, (n, _) in sizes.items() if n)
    if not domains:
        return None
    number = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(domains), FEATURES), dtype=np.int64)
        for b in batches:
            for d, f in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), strict=True):
                n[number[d], f] += 1
        k, f = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(f, pa.int32()), pa.array(n[k, f])], ["k", "f", "n"])

    # one row per (domain, feature): the model's size, whatever the input's
    found = (rows.filter("fold <> 1").select("domain", "f").mapInArrow(count, "k int, f int, n bigint")
             .groupBy("k", "f").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros((FEATURES, len(domains)))
    n[np.asarray(found["f"]), np.asarray(found["k"])] = np.asarray(found["n"])
    docs = np.array([sizes[d][0] for d in domains], dtype=np.float64)
    pseudo = SHRINK * docs.sum()
    back = (n.sum(axis=1) + 0.5) / (docs.sum() + 1.0)
    rate = (n + pseudo * back[:, None]) / (docs + pseudo)
    model = SoftModel(domains, np.log(rate / back[:, None]).astype(np.float32), np.log(docs / docs.sum()))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for b in batches:
            y = np.array([number.get(d, -1) for d in b.column(0).to_pylist()])
            x = [f for f, k in zip(_unpacked(b.column(1)), y, strict=True) if k >= 0]
            y = y[y >= 0]
            for i, t in enumerate(TEMPERATURES):
                p = SoftModel(domains, model.weights, model.prior, t).posteriors(x)
                total[i] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "loss"])

    held = (rows.filter("fold = 1").select("domain", "f").mapInArrow(losses, "i int, loss double")
            .groupBy("i").agg(F.sum("loss").alias("loss")).collect())
    if held:
        model.temperature = TEMPERATURES[min(held, key=lambda r: (r["loss"], r["i"]))["i"]]
    return model


def fit_rates(rows: DataFrame, target: np.ndarray, steps: int = 100, tolerance: float = 1e-9) -> list[float]:
    """``lambda`` for ``rows(tokens, p0, p1, ..)`` and the domain totals
    ``target``; all zeros without tokens. It ends when the projected gradient
    is ``tolerance`` of the tokens wanted; targets out of reach are met as
    well as least squares can."""
    k = len(target)
    t = F.col("tokens").cast("double")
    p = [F.col(f"p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = rate_column(lam, p)
        free = F.when(r > 0, t).otherwise(0.0)
        got = rows.select(t.alias("tokens"), r.alias("r"), free.alias("free"), *p).agg(
            *[F.sum(F.col("tokens") * F.col("r") * x) for x in p],
            *[F.sum(F.col("free") * p[i] * p[j]) for i, j in pairs],
            F.sum(F.col("tokens") * F.col("r") * F.col("r"))).first()
        got = [x or 0.0 for x in got]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:-1], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(got[:k]), gram, got[-1] / 2

    lam = np.zeros(k)
    now, gram, half = measure(lam)
    if not gram.any():
        return lam.tolist()
    ridge = RIDGE * np.trace(gram) / k
    scale = max(target.sum(), 1.0)
    value = lambda lam, half: half + ridge / 2 * lam @ lam - target @ lam
    for _ in range(steps):
        slope = target - now - ridge * lam
        if np.abs(slope).max() <= tolerance * scale:
            break
        step = np.linalg.solve(gram + np.eye(k) * ridge, slope)
        for _ in range(40):
            found = measure(lam + step)
            if value(lam + step, found[2]) <= value(lam, half) - 1e-4 * step @ slope:
                break
            step = step / 2
        else:
            break  # no step of any size helps: rounding
        lam = lam + step
        now, gram, half = found
    return lam.tolist()


def rate_column(lam: list[float] | np.ndarray, p: list[Column]) -> Column:
    """``max(0, 1 + posterior . lambda)``."""
    return F.greatest(F.lit(0.0), sum((x * F.lit(float(v)) for x, v in zip(p, lam, strict=True)), F.lit(1.0)))


def _posterior_column(model: SoftModel, f: Column) -> Column:
    return arrow_udf(lambda arr: _structs(model, _unpacked(arr)), _posterior_type(model))(f)


def _posterior_of_text(model: SoftModel, text: str) -> Column:
    return arrow_udf(lambda arr: _structs(model, [x for _, x in _pieces(arr)]), _posterior_type(model))(col(text))


def _posterior_type(model: SoftModel) -> str:
    return "struct<" + ",".join(f"p{i}:double" for i in range(len(model.domains))) + ">"


def _structs(model: SoftModel, feats: list[np.ndarray]) -> pa.Array:
    p = model.posteriors(feats) if feats else np.zeros((0, len(model.domains)))
    return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(p.shape[1])], [f"p{i}" for i in range(p.shape[1])])


def targets(model: SoftModel, weights: dict[str, float], total: float, present: np.ndarray | None = None) -> np.ndarray:
    """Token targets of the model's domains; a domain without a weight gets
    none, and weights of domains that no label names are shared out. With
    ``present``, the domains' expected tokens now, weights are multiples of
    their present shares."""
    w = np.array([max(weights.get(d, 0.0), 0.0) for d in model.domains])
    if present is not None:
        w = w * present
    return total * w / w.sum() if w.sum() > 0 else np.full(len(w), total / len(w))


def _targets(rows: DataFrame, model: SoftModel, weights: dict[str, float], total_share: float, multiples: bool) -> np.ndarray:
    found = rows.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(len(model.domains))]).first()
    found = [float(x or 0) for x in found]
    return targets(model, weights, found[0] * total_share, np.array(found[1:]) if multiples else None)


def copies_column(rate: Column, *key: Column) -> Column:
    """The rate rounded to a whole number of copies, up or down by a hash of
    the row, so that the expectation is the rate."""
    u = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from the labels' quality and toxicity, such as
    ``q1_t0``; rows with a null in either are left out."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"),
                                            F.col("toxic").cast("string")).alias("domain")).filter("domain IS NOT NULL")


def mixing_report(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_share: float = 1.0,
                  multiples: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, tokens, posteriors, rate, copies)`` of every row of ``docs``.

    ``weights`` are target token proportions by domain (or, as ``multiples``,
    by how much a domain's present proportion is to change), ``total_share``
    the wanted tokens as a share of the input's. A null or empty text has no
    tokens and the prior as its posteriors; repeated rows have equal rates;
    an empty table gives no rows. Without labelled documents every rate is 1
    and the posteriors are empty. Other columns are not read.
    """
    rows = cut(docs.select(col(doc_id).alias("doc_id"), _piece_column(text).alias("x")).select("doc_id", "x.*"))
    model = fit(rows, labelled)
    if model is None:
        return rows.select("doc_id", "tokens", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
                           .alias("posteriors"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    rows = cut(rows.select("doc_id", "tokens", F.xxhash64("f").alias("h"), _posterior_column(model, F.col("f")).alias("p"))
               .select("doc_id", "tokens", "h", "p.*"))
    p = [F.col(f"p{i}") for i in range(len(model.domains))]
    rate = rate_column(fit_rates(rows, _targets(rows, model, weights, total_share, multiples)), p)
    rows = rows.withColumn("rate", rate)
    post = F.map_from_arrays(F.array(*map(F.lit, model.domains)), F.array(*p))
    return rows.select("doc_id", "tokens", post.alias("posteriors"), "rate",
                       copies_column(F.col("rate"), F.col("doc_id"), F.col("h")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_share: float = 1.0,
        multiples: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs``, all columns, each row as often as its rate says."""
    rows = cut(docs.select(col(doc_id).alias("doc_id"), _piece_column(text).alias("x")).select("doc_id", "x.*"))
    model = fit(rows, labelled)
    if model is None:
        return docs
    post = cut(rows.select("tokens", _posterior_column(model, F.col("f")).alias("p")).select("tokens", "p.*"))
    lam = fit_rates(post, _targets(post, model, weights, total_share, multiples))
    q, c = free_name(docs, "_posterior"), free_name(docs, "_copy")
    out = docs.withColumn(q, _posterior_of_text(model, text))
    rate = rate_column(lam, [F.col(q)[f"p{i}"] for i in range(len(model.domains))])
    n = copies_column(rate, col(doc_id), F.xxhash64(col(text)))
    return (out.withColumn(c, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
            .select(*[col(k) for k in docs.columns]))
