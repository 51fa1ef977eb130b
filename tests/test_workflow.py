"""End to end over files: datasets -> prompts -> answers (resumed) ->
splits -> collated batches -> scores."""

import json
import math

import pytest
from pyspark.sql import functions as F

from distillery import options as O
from distillery import workflow as W
from distillery.operators import corpus as C
from distillery.operators.generate import failing_generator, md5_generator
from distillery.plans import fixtures as FX
from distillery.sources import sinks
from tests.conftest import SF_SMALL


def test_end_to_end(spark, tmp_root):
    jsonl = f"{tmp_root}/datasets"
    for src in FX.corpus_sources(spark, SF_SMALL):
        rows = C.union_sources([src]).select("split", F.col("instruction").alias("text"), "row_key")
        sinks.write_jsonl_splits(rows.orderBy("split", "row_key"), f"{jsonl}/{src.name}")
    registry = [O.RegistryEntry(n, "text") for n in ("documents", "benchmark", "conversations")]

    prompts = W.prepare_prompts(spark, registry, jsonl, f"{tmp_root}/prompts.jsonl")
    assert W.prepare_prompts(spark, registry, jsonl, prompts) == prompts          # kept, not rebuilt
    p = spark.read.schema(W.PROMPT_SCHEMA).json(prompts)
    n = p.count()
    assert n == 23 and sorted(r.row_idx for r in p.collect()) == list(range(23))

    answers = f"{tmp_root}/teacher.jsonl"
    # an interrupted earlier run: answers for the first 10 prompts only
    first = p.filter("row_idx < 10").withColumn("output", F.lit("early")).withColumn("status", F.lit("ok"))
    sinks.append_jsonl(first.select("row_idx", "instruction", "output", "status"), answers)
    out = W.answer_prompts(spark, prompts, answers, failing_generator("ü"))
    assert out.count() == n and out.select("row_idx").distinct().count() == n
    assert out.filter("output = 'early'").count() == 10
    again = W.answer_prompts(spark, prompts, answers, md5_generator)          # nothing left to do
    assert again.count() == n
    counts = W.count_answers(spark, answers)
    assert sum(counts.values()) == n

    train, test = W.training_splits(spark, answers)
    n_ok = counts.get("ok", 0)
    assert test.count() == math.ceil(n_ok * 0.1) and train.count() + test.count() == n_ok
    assert train.join(test, "row_idx").count() == 0

    vocab = W.vocabulary(train, 500)
    batches = W.collate(train, vocab, max_length=16, batch_size=4)
    rows = batches.collect()
    assert len(rows) == train.count()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch_id, []).append(r)
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels)
        assert all((m == 0) == (lab == -100) for m, lab in zip(r.attention_mask, r.labels) if m == 0)
    for b, rs in by_batch.items():
        assert len({len(r.input_ids) for r in rs}) == 1 and len(rs) <= 4
        assert max(sum(r.attention_mask) for r in rs) == len(rs[0].input_ids) <= 16

    s = W.score_logits(FX.logits(spark, SF_SMALL)).first()
    assert s.ce > 0 and s.kd >= 0 and math.isclose(s.loss, 0.7 * s.ce + 0.3 * s.kd, rel_tol=1e-12)


def test_batch_files_and_blocks(spark, tmp_root):
    rows = [(i, f"instruction {i}") for i in range(6)]
    prompts = f"{tmp_root}/batch-prompts"
    spark.createDataFrame(rows, W.PROMPT_SCHEMA).write.json(prompts)
    W.write_batch_requests(spark, prompts, f"{tmp_root}/requests")
    sent = [json.loads(r.value) for r in spark.read.text(f"{tmp_root}/requests").collect()]
    assert sorted(r["custom_id"] for r in sent) == [f"{O.REQUEST_ID_PREFIX}{i}" for i in range(6)]

    def line(custom_id, content):
        return json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}})

    got = [(line(f"{O.REQUEST_ID_PREFIX}{i}", f"answer {i}"),) for i in (0, 1, 1)] + [(line("other", "x"),), ("not json",)]
    spark.createDataFrame(got, "value string").write.text(f"{tmp_root}/responses")
    out = f"{tmp_root}/batch-answers"
    for _ in range(2):                                                # reading the file again adds nothing
        a = W.read_batch_responses(spark, f"{tmp_root}/responses", prompts, out)
        assert sorted(map(tuple, a.collect())) == [(i, f"instruction {i}", f"answer {i}", "ok") for i in (0, 1)]
    # a run that dies in its second block keeps the first one
    def dies():
        def fn(ps):
            if any("instruction 3" in p for p in ps):
                import sys
                sys.exit(3)
            return [f"made {len(p)}" for p in ps]
        return fn

    with pytest.raises(Exception):  # noqa: B017, PT011
        W.answer_prompts(spark, prompts, out, dies, blocks=2, partitions=1)
    kept = {r.row_idx for r in spark.read.schema(W.ANSWER_SCHEMA).json(out).collect()}
    assert kept == {0, 1, 2, 4}
    done = W.answer_prompts(spark, prompts, out, md5_generator, blocks=2)
    assert sorted(r.row_idx for r in done.collect()) == list(range(6))
