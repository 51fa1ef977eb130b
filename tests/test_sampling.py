import math

import pytest
from pyspark.sql import functions as F

from distillery.operators import sampling as P


def _cands(spark, rows):
    return spark.createDataFrame(rows, "ctx BIGINT, tok BIGINT, lg DOUBLE")


ROWS = [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 3.0), (0, 3, 0.5), (1, 0, 2.0), (1, 1, -1.0)]


def test_top_k_ties_and_bounds(spark):
    df = _cands(spark, ROWS)
    got = sorted((r.ctx, r.tok, r.rank) for r in P.top_k(df, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 1, 2)]
    assert P.top_k(df, 0).count() == 6 and P.top_k(df, 99).count() == 6


def test_top_p(spark):
    df = _cands(spark, ROWS)
    all_kept = P.top_p(df, 1.0, 1.0).collect()
    assert len(all_kept) == 6
    one = {r.ctx: (r.tok, r.p) for r in P.top_p(df, 0.01, 1.0).collect()}
    assert one[0] == (1, 1.0) and one[1] == (0, 1.0)     # below the largest: keeps one
    for ctx in (0, 1):
        s = sum(r.p for r in P.top_p(df, 0.9, 1.0).collect() if r.ctx == ctx)
        assert math.isclose(s, 1.0)


def test_greedy_and_seeded(spark):
    df = _cands(spark, ROWS)
    assert {r.ctx: r.tok for r in P.greedy(df).collect()} == {0: 1, 1: 0}
    kept = P.top_p(P.top_k(df, 3), 1.0, 1.0)
    a = {r.ctx: r.tok for r in P.sample(kept, 11).collect()}
    b = {r.ctx: r.tok for r in P.sample(kept, 11).collect()}
    assert a == b and set(a) == {0, 1}


def test_validation():
    with pytest.raises(ValueError):
        P.top_k(None, -1)
    with pytest.raises(ValueError):
        P.top_p(None, 0.0)


def test_choose_tokens_dispatch(spark):
    from distillery import options as O

    df = _cands(spark, ROWS)
    g = {r.ctx: r.tok for r in P.choose_tokens(df, O.SamplingOptions(do_sample=False)).collect()}
    assert g == {0: 1, 1: 0}
    s = {r.ctx: r.tok for r in P.choose_tokens(df, O.SamplingOptions(top_k=1, top_p=1.0, seed=3)).collect()}
    assert s == g                     # top-k 1 leaves only the best token
    t = {r.ctx: r.tok for r in P.choose_tokens(df, O.SamplingOptions(top_k=0, top_p=1.0, seed=3)).collect()}
    assert set(t) == {0, 1}


@pytest.mark.parametrize("p,t,scale", [(0.6, 1.0, 1.0), (0.95, 0.5, 3.0), (1.0, 1.0, 60.0), (1e-9, 1.0, 1.0), (0.9, 5.0, 0.001)])
def test_nucleus_of_whole_contexts(spark, p, t, scale):
    """Against ranking everything: ties, far tails, null contexts."""
    import random

    from distillery.operators.sampling import top_p

    rng = random.Random(8)
    rows = [(c, k, round(rng.gauss(0, scale), 3 if scale > 0.1 else 5)) for c in (1, 2, None) for k in range(200)]
    rows += [(4, k, 1.5) for k in range(50)] + [(5, 0, -700.0), (5, 1, 700.0)]
    want = {}
    for c in (1, 2, None, 4, 5):
        mine = sorted(((lg / t, k) for x, k, lg in rows if x == c), key=lambda v: (-v[0], v[1]))
        e = [math.exp(v - mine[0][0]) for v, _ in mine]
        z, cum, kept = sum(e), 0.0, []
        for (_, k), x in zip(mine, e):
            if kept and cum >= p:
                break
            kept.append((k, x))
            cum += x / z
        whole = sum(x for _, x in kept)
        want.update({(c, k): x / whole for k, x in kept if x / z > 1e-12 or len(kept) == 1})
    df = spark.createDataFrame(rows, "ctx INT, tok INT, lg DOUBLE").withColumn("other", F.lit("x"))
    out = top_p(df, p, t)
    assert out.columns == ["ctx", "tok", "lg", "other", "p"]
    got = {(r.ctx, r.tok): r.p for r in out.collect()}
    assert {k for k, v in got.items() if v > 1e-12} == {k for k, v in want.items() if v > 1e-12}
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items() if v > 1e-12)
