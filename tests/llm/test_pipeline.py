"""The pipeline's stages, one after another, against their contracts."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from distillery.llm import queries
from distillery.llm.shared import table
from distillery.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}

    before, after = map(ids, seen["quality classifier"])
    good = [i for i in before if i in labels and labels[i]["quality"] == 1]
    bad = [i for i in before if i in labels and labels[i]["quality"] == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.2 * len(bad)

    before, after = map(ids, seen["n-gram Jaccard join"])
    groups = {}
    rows = {r["doc_id"]: r["text"] for r in seen["n-gram Jaccard join"][0].collect()}
    from test_operators import brute_components

    for i, (_, c) in brute_components(rows).items():
        groups.setdefault(c, []).append(i)
    assert after == set(groups)

    # targets are multiples of the present shares: toxic documents come out
    # rarer against clean ones, which are repeated rather than thinned
    before, after = seen["mixing sources to target weights"]
    copies = Counter(r[0] for r in after.select("doc_id").collect())
    mean = lambda toxic: np.mean([copies[i] for i in ids(before) if i in labels and labels[i]["quality"] == 1
                                  and labels[i]["toxic"] == toxic])
    assert mean(1) < 0.6 * mean(0) and mean(0) > 1.2

    docs, pieces = seen["packing"]
    assert ids(pieces) == ids(docs)
    assert pieces.filter(F.col("start") == 0).count() == docs.count()


def test_registered_queries_and_entry():
    import __spark_entry__ as e

    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in queries.QUERIES}
    assert queries.QUERIES.keys() <= e.queries().keys() and e.queries()["pipeline"] is corpus_pipeline.run
    assert queries.ORACLE.keys() <= e.oracle_sql().keys()
