import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from distillery.functions import logits as L
from distillery.operators import scoring as S

# 2-D example in the shape of the reference smoke run: 3 rows x 4 classes.
RNG = np.random.default_rng(0)
STU = RNG.normal(size=(3, 4))
ASS = RNG.normal(size=(3, 4))


def _np_lsm(x):
    m = x.max(axis=-1, keepdims=True)
    return x - m - np.log(np.exp(x - m).sum(axis=-1, keepdims=True))


def _frame(spark, s=STU, a=ASS, labels=(1, 2, 3)):
    rows = [(i, 0, [float(v) for v in s[i]], [float(v) for v in a[i]], int(labels[i])) for i in range(len(s))]
    return spark.createDataFrame(rows, "sample_id BIGINT, pos BIGINT, student ARRAY<DOUBLE>, "
                                       "assistant ARRAY<DOUBLE>, label INT")


@pytest.mark.parametrize("T", [0.8, 0.5, 1.0])
def test_kl_matches_numpy(spark, T):
    lps, lpa = _np_lsm(STU / T), _np_lsm(ASS / T)
    kl = (np.exp(lpa) * (lpa - lps)).sum()
    r = S.kd_reductions(_frame(spark), T).first()
    assert math.isclose(r.batchmean, kl / 3 * T * T, rel_tol=1e-12)
    assert math.isclose(r.sum, kl * T * T, rel_tol=1e-12)
    assert math.isclose(r.mean, kl / 12 * T * T, rel_tol=1e-12)
    assert math.isclose(r.batchmean * 3, r.sum, rel_tol=1e-12)


def test_softmax_sums_to_one_and_large_logit(spark):
    df = spark.createDataFrame([([1000.0, 0.0, -5.0],), ([1.0, 1.0, 1.0],)], "x ARRAY<DOUBLE>")
    rows = df.select(L.softmax("x").alias("p"), L.log_softmax("x").alias("lp")).collect()
    assert math.isclose(sum(rows[0].p), 1.0) and math.isclose(rows[0].p[0], 1.0)
    assert all(math.isfinite(v) for v in rows[0].lp)
    assert all(math.isclose(v, 1 / 3) for v in rows[1].p)


def test_equal_logits_zero_kl_and_mismatch(spark):
    df = _frame(spark, STU, STU)
    assert abs(S.kd_reductions(df, 0.5).first().batchmean) < 1e-12
    bad = spark.createDataFrame([(0, 0, [1.0, 2.0], [1.0], 1)], "sample_id BIGINT, pos BIGINT, "
                                "student ARRAY<DOUBLE>, assistant ARRAY<DOUBLE>, label INT")
    assert S.with_kl(bad).first().kl is None
    assert S.vocab_mismatch(bad).count() == 1


def test_ce_and_combined(spark):
    # one sample, 3 positions; targets are the next labels
    rows = [(0, p, [float(v) for v in STU[p]], [float(v) for v in ASS[p]], lab)
            for p, lab in enumerate([-100, 2, 1])]
    df = spark.createDataFrame(rows, "sample_id BIGINT, pos BIGINT, student ARRAY<DOUBLE>, "
                                     "assistant ARRAY<DOUBLE>, label INT")
    lsm = _np_lsm(STU)
    ce = -(lsm[0][2] + lsm[1][1]) / 2
    r = S.ce_loss(df).first()
    assert math.isclose(r.ce, ce, rel_tol=1e-12) and r.n_valid == 2
    for w in (0.0, 0.3, 1.0):
        c = S.combined_loss(df, 0.5, w).first()
        assert math.isclose(c.loss, (1 - w) * c.ce + w * c.kd, rel_tol=1e-12)


def test_no_valid_label_gives_null(spark):
    df = _frame(spark, labels=(-100, -100, -100))
    assert S.ce_loss(df).first().ce is None


def test_temperature_validation():
    with pytest.raises(ValueError):
        L.scale("x", 0)
    with pytest.raises(ValueError):
        S.kd_long(None, 0.0)


def test_long_form_equals_array_form(spark):
    df = _frame(spark)
    a = S.kd_reductions(df, 0.7).first().batchmean
    b = S.kd_long(S.explode_logits(df), 0.7).first().kd
    assert math.isclose(a, b, rel_tol=1e-12)


def test_f_logits_batchmean(spark):
    from tests.conftest import SF_MID

    from distillery.plans import fixtures as FX

    r = S.kd_reductions(FX.logits(spark, SF_MID), 0.5).first()
    assert round(r.batchmean, 6) == 0.061321
    assert F is not None


@pytest.mark.parametrize("T", [0.5, 2.0])
def test_hof_and_arrow_paths_agree(spark, T):
    rows = [(0, p, [float(v) for v in STU[p]], [float(v) for v in ASS[p]], lab)
            for p, lab in enumerate([1, 2, 3])]
    rows.append((1, 0, [1.0, 2.0], [1.0], 0))      # width mismatch -> null KL
    df = spark.createDataFrame(rows, "sample_id BIGINT, pos BIGINT, student ARRAY<DOUBLE>, "
                                     "assistant ARRAY<DOUBLE>, label INT")
    a = {(r.sample_id, r.pos): r.kl for r in S.with_kl(df, T, method="hof").collect()}
    b = {(r.sample_id, r.pos): r.kl for r in S.with_kl(df, T, method="arrow").collect()}
    assert a[(1, 0)] is None and b[(1, 0)] is None
    for k in a:
        if a[k] is not None:
            assert math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-15)
    ca = S.ce_loss(df, method="hof").first()
    cb = S.ce_loss(df, method="arrow").first()
    assert math.isclose(ca.ce, cb.ce, rel_tol=1e-12) and ca.n_valid == cb.n_valid


def test_next_label_methods_agree(spark):
    from tests.conftest import SF_SMALL

    from distillery.plans import fixtures as FX

    lg = FX.logits(spark, SF_SMALL).select("sample_id", "pos", "label")
    a = {(r.sample_id, r.pos): r.target for r in S.with_next_label(lg).collect()}
    b = {(r.sample_id, r.pos): r.target for r in S.with_next_label(lg, method="join").collect()}
    c = {(r.sample_id, r.pos): r.target for r in S.with_next_label(lg, method="window").collect()}
    assert a == b == c and len(a) == 500


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.mark.parametrize("layout", ["sorted", "shuffled", "one", "hot"])
def test_shift_in_place(spark, tmp_root, layout):
    import random

    rng = random.Random(4)
    rows = [(s, p, rng.choice([None, *range(9)]), [float(s or 0), float(p or 0)]) for s in (1, 2, None, 7) for p in (None, 0, 1, 5, 9, 10)]
    if layout == "hot":  # one sample over many partitions
        rows = [(1, p, p * 3, [1.0]) for p in range(400)]
    want = {}
    for s, p, _, _ in rows:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0))
        at = [r[1] for r in mine].index(p)
        want[s, p] = mine[at + 1][2] if at + 1 < len(mine) else None
    if layout == "shuffled":
        rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sample_id BIGINT, pos BIGINT, label INT, student ARRAY<DOUBLE>")
    df = df.coalesce(1) if layout == "one" else df
    path = f"{tmp_root}/{layout}"
    if layout == "hot":
        df.repartitionByRange(9, "pos").sortWithinPartitions("pos").write.parquet(path)
    else:
        df.write.parquet(path)
    out = S.with_next_label(spark.read.parquet(path), stored=True)
    got = {(r.sample_id, r.pos): r.target for r in out.collect()}
    assert got == want and out.count() == len(rows)
    assert not any("student" in line for line in _exchanges(out))
    assert S.with_next_label(df.limit(0)).count() == 0
    again = S.with_next_label(df.withColumn("target", F.lit("old")).repartition(5))
    assert {(r.sample_id, r.pos): r.target for r in again.collect()} == want and again.columns.count("target") == 1


def test_losses_leave_logits_where_they_are(spark):
    from tests.conftest import SF_SMALL

    from distillery.plans import fixtures as FX

    stored = FX.stored_logits(spark, SF_SMALL)
    for df in (S.ce_loss(stored, stored=True), S.combined_loss(stored, stored=True)):
        df.collect()
        assert not any("student" in line for line in _exchanges(df))
    assert math.isclose(S.ce_loss(stored, stored=True).first().ce, S.ce_loss(FX.logits(spark, SF_SMALL)).first().ce, rel_tol=1e-12)


def test_loss_options_bounds():
    from distillery import options as O

    for bad in (0.0, -1.0, 1.5):
        with pytest.raises(ValueError):
            O.LossOptions(bad)
    with pytest.raises(ValueError):
        O.LossOptions(0.5, "avg")
    with pytest.raises(ValueError):
        O.LossOptions(0.5, "sum", 1.5)


def test_stored_target_scores_without_moving_logits(spark):
    rows = [(0, p, [float(v) for v in STU[p]], [float(v) for v in ASS[p]], lab, p != 1)
            for p, lab in enumerate([1, 2, 3])]
    df = spark.createDataFrame(rows, "sample_id BIGINT, pos BIGINT, student ARRAY<DOUBLE>, "
                                     "assistant ARRAY<DOUBLE>, label INT, counts BOOLEAN")
    stored = spark.createDataFrame(S.with_next_label(df).collect(), S.with_next_label(df).schema)
    assert S.ce_loss(stored, target="target").first() == S.ce_loss(df).first()
    one = S.combined_loss(stored, target="target", mask="counts")
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    assert math.isclose(one.first().kd, S.kd_reduce(df, mask="counts").first().kd, rel_tol=1e-12)
    assert one.first().ce == S.combined_loss(df).first().ce
