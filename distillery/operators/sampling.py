"""Candidate filters and token choice over long-form logits.

Input: one row per ``(ctx, tok, lg)``. Order inside a context is logit
descending, ties on the lower token id. Filter order: temperature, top-k,
top-p (then renormalise).

A context holds at most one row per vocabulary entry. Spark cuts each
context to ``k`` rows before the shuffle (a partial window limit), so top-k
needs one exchange. Top-p cuts each context by a histogram before it ranks. Greedy choice is a partial aggregate (``max_by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distillery import options as O


def _order(lg: str, tok: str) -> list[Column]:
    return [F.col(lg).desc(), F.col(tok).asc()]


def top_k(df: DataFrame, k: int, ctx: str = "ctx", tok: str = "tok", lg: str = "lg",
          out: str = "rank") -> DataFrame:
    """Keep the ``k`` best candidates per context; adds ``rank``
    (1 = best). ``k = 0`` keeps everything (ranked)."""
    if k < 0:
        raise ValueError("k must be >= 0")
    full = Window.partitionBy(ctx).orderBy(*_order(lg, tok))
    if k == 0:
        return df.withColumn(out, F.row_number().over(full))
    return df.withColumn(out, F.row_number().over(full)).filter(F.col(out) <= k)


def with_probs(df: DataFrame, temperature: float, ctx: str = "ctx", lg: str = "lg",
               out: str = "p") -> DataFrame:
    """Softmax of ``lg / T`` over the rows present per context."""
    if not temperature > 0:
        raise ValueError("temperature must be > 0")
    w = Window.partitionBy(ctx)
    s = F.col(lg) / F.lit(float(temperature))
    return (df.withColumn("_e", F.exp(s - F.max(s).over(w)))
              .withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e"))


BINS, BIN = 256, 0.25  # of scaled logits below a context's best, in steps of BIN


def top_p(df: DataFrame, p: float, temperature: float = O.GEN_TEMPERATURE, ctx: str = "ctx",
          tok: str = "tok", lg: str = "lg", out: str = "p") -> DataFrame:
    """Nucleus filter then renormalise: keep a candidate while the mass
    ranked above it is below ``p`` (the best one always stays).

    A histogram of each context's mass by distance from its best logit (at
    most ``BINS`` rows a context, combined before the shuffle) tells how far
    down the nucleus can reach. Only candidates down to there are ranked; the
    rest of a context is neither shuffled by rank nor sorted.
    """
    if not 0 < p <= 1:
        raise ValueError("top_p must be within (0, 1]")
    if not temperature > 0:
        raise ValueError("temperature must be > 0")
    s = F.col(lg) / F.lit(float(temperature))
    best = df.groupBy(F.col(ctx).alias("_ctx")).agg(F.max(s).alias("_best"))
    near = df.join(best, F.col(ctx).eqNullSafe(F.col("_ctx"))).drop("_ctx")
    gap = F.col("_best") - s
    x = near.withColumn("_e", F.exp(-gap)).withColumn("_bin", F.least(F.floor(gap / BIN), F.lit(BINS - 1)).cast("int"))
    hist = x.groupBy(F.col(ctx).alias("_ctx"), "_bin").agg(F.sum("_e").alias("_mass"))
    w = Window.partitionBy("_ctx")
    above = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # a bin is out if the bins above it hold p already; a little slack, as the
    # exact rule below adds up candidate by candidate
    reach = (hist.withColumn("_all", F.sum("_mass").over(w)).withColumn("_above", F.coalesce(F.sum("_mass").over(above), F.lit(0.0)))
             .filter(F.col("_above") / F.col("_all") < F.lit(float(p) + 1e-9))
             .groupBy("_ctx").agg(F.max("_bin").alias("_last"), F.first("_all").alias("_all")))
    x = x.join(reach, F.col(ctx).eqNullSafe(F.col("_ctx")) & (F.col("_bin") <= F.col("_last")))
    x = x.withColumn("_p", F.col("_e") / F.col("_all"))
    run = Window.partitionBy(ctx).orderBy(*_order(lg, tok)).rowsBetween(Window.unboundedPreceding, 0)
    kept = x.withColumn("_cum", F.sum("_p").over(run)).filter(F.col("_cum") - F.col("_p") < F.lit(float(p)))
    return kept.withColumn(out, F.col("_p") / F.sum("_p").over(Window.partitionBy(ctx))).select(
        *[c for c in df.columns if c != out], out)


def filter_candidates(df: DataFrame, opts: O.SamplingOptions, **kw) -> DataFrame:
    """Temperature -> top-k -> top-p, renormalised probabilities in ``p``."""
    x = top_k(df, opts.top_k, **kw) if opts.top_k else df
    return top_p(x, opts.top_p, opts.temperature)


def greedy(df: DataFrame, ctx: str = "ctx", tok: str = "tok", lg: str = "lg") -> DataFrame:
    """The best token per context (ties: lower id)."""
    return df.groupBy(ctx).agg(
        F.max_by(F.col(tok), F.struct(F.col(lg), -F.col(tok))).alias(tok))


def uniform(seed: int, ctx: str = "ctx") -> Column:
    """Seeded uniform in [0, 1) per context from md5('{seed}:{ctx}')."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ctx).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(kept: DataFrame, seed: int, ctx: str = "ctx", tok: str = "tok", lg: str = "lg",
           p: str = "p") -> DataFrame:
    """Per context, the first kept candidate whose running mass
    reaches the seeded uniform (the last one if rounding leaves a gap)."""
    run = Window.partitionBy(ctx).orderBy(*_order(lg, tok)).rowsBetween(Window.unboundedPreceding, 0)
    x = (kept.withColumn("_cum", F.sum(p).over(run))
             .withColumn("_u", uniform(seed, ctx))
             .withColumn("_rk", F.row_number().over(Window.partitionBy(ctx).orderBy(*_order(lg, tok)))))
    hit = F.when(F.col("_cum") >= F.col("_u"), F.struct(F.col("_rk"), F.col(tok).alias("_t")))
    return x.groupBy(ctx).agg(
        F.coalesce(F.min(hit)["_t"], F.max_by(tok, "_rk")).alias(tok))


def choose_tokens(df: DataFrame, opts: O.SamplingOptions, ctx: str = "ctx", tok: str = "tok",
                  lg: str = "lg") -> DataFrame:
    """I13 / I14 by the generation settings: greedy when sampling is off,
    else temperature -> top-k -> top-p -> seeded draw. One row per context."""
    if not opts.do_sample:
        return greedy(df, ctx, tok, lg)
    x = top_k(df, opts.top_k, ctx, tok, lg) if opts.top_k else df
    kept = top_p(x, opts.top_p, opts.temperature, ctx, tok, lg)
    return sample(kept, opts.seed, ctx, tok, lg)
