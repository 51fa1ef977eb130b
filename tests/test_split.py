import pytest

from distillery.operators.split import exact_split, held_out_count


@pytest.mark.parametrize("n,k", [(1, 1), (10, 1), (11, 2), (233, 24), (1000, 100)])
def test_exact_sizes_disjoint(spark, n, k):
    df = spark.range(0, n).withColumnRenamed("id", "row_idx")
    train, test = exact_split(df, "row_idx", 0.1, 19)
    tr = [r.row_idx for r in train.collect()]
    te = [r.row_idx for r in test.collect()]
    assert held_out_count(n, 0.1) == k
    assert len(te) == k and len(tr) == n - k
    assert sorted(tr + te) == list(range(n))


def test_split_matches_full_sort(spark):
    import hashlib

    df = spark.range(0, 500).withColumnRenamed("id", "row_idx")
    te = sorted(r.row_idx for r in exact_split(df, "row_idx", 0.1, 42)[1].collect())
    ranked = sorted(range(500), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert te == sorted(ranked[:50])


def test_split_validation(spark):
    df = spark.range(0, 5).withColumnRenamed("id", "row_idx")
    for ts, seed in [(0.0, 1), (1.0, 1), (0.1, 0)]:
        with pytest.raises(ValueError):
            exact_split(df, "row_idx", ts, seed)
