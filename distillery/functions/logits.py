"""Array-form logit math as Spark higher-order functions.

Every expression works on one ``ARRAY<DOUBLE>`` row and stays inside the
JVM: no shuffle, no Python. Log-sum-exp subtracts the row maximum first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale(x, temperature: float) -> Column:
    """Logits / T."""
    if not temperature > 0:
        raise ValueError("temperature must be > 0")
    t = float(temperature)
    return F.transform(_c(x), lambda v: v.cast("double") / F.lit(t))


def _per_row(value: Column, like) -> Column:
    """``value`` repeated to the length of ``like``.

    A per-row scalar used inside a lambda would be re-evaluated for every
    element (quadratic in the vocabulary); zipping it in as an argument
    evaluates it once per row.
    """
    return F.array_repeat(value, F.size(_c(like)))


def logsumexp(x) -> Column:
    """``max + ln(sum(exp(x - max)))`` in two linear passes."""
    m = F.array_max(_c(x))
    shifted = F.zip_with(_c(x), _per_row(m, x), lambda v, mm: F.exp(v - mm))
    return m + F.log(F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v))


def log_softmax(x) -> Column:
    """``x - max - ln(sum(exp(x - max)))``."""
    return F.zip_with(_c(x), _per_row(logsumexp(x), x), lambda v, lse: v - lse)


def softmax(x) -> Column:
    """Probabilities along the vocabulary axis."""
    return F.transform(log_softmax(x), lambda v: F.exp(v))


def kl_terms(student, assistant, temperature: float) -> Column:
    """I4 (reduction ``none``): ``p_a * (log p_a - log p_s)`` per entry,
    KL(assistant || student) on temperature-scaled logits. A zero
    probability contributes 0."""
    lps = log_softmax(scale(student, temperature))
    lpa = log_softmax(scale(assistant, temperature))
    return F.zip_with(lpa, lps, lambda a, s: F.when(F.exp(a) == 0, F.lit(0.0))
                      .otherwise(F.exp(a) * (a - s)))


def array_sum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def weighted_index_sum(x) -> Column:
    """``sum(x[i] * (i + 1))``: a position-sensitive checksum of an array."""
    return F.aggregate(F.zip_with(_c(x), F.sequence(F.lit(1), F.size(_c(x))), lambda v, i: v * i),
                       F.lit(0.0), lambda acc, v: acc + v)


def argmax(x) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - F.lit(1)).cast("bigint")
