"""Answer generation.

The generator is a user callable built by a factory once per task and
applied to fixed-size slices of prompts inside Arrow batches
(``mapInArrow``): the model call is the only Python in the plan. A slice
that raises is retried row by row so one bad row becomes an error row
(status ``error``) and the job continues.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distillery import options as O

Generator = Callable[[list], list]
Factory = Callable[[], Generator]


def _worker_store() -> dict:
    """A dict that lives as long as the Python worker process (kept in
    ``sys.modules`` so by-value pickled code finds the same object)."""
    import sys
    import types

    m = sys.modules.get("_distillery_worker_store")
    if m is None:
        m = types.ModuleType("_distillery_worker_store")
        m.store = {}
        sys.modules[m.__name__] = m
    return m.store


def _factory_key(factory: Factory) -> str:
    import hashlib

    from pyspark import cloudpickle

    return hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()


def generate(df: DataFrame, factory: Factory, prompt_col: str = "prompt",
             output_col: str = "output", status_col: str = "status",
             batch_size: int = O.GEN_BATCH_SIZE,
             error_prefix: str = O.GENERATION_ERROR_MARK, reuse: bool = True,
             partitions: int | None = None) -> DataFrame:
    """F1 + F2: add ``output`` and ``status`` ('ok' / 'error' / 'no_prompt').

    Work is spread by the input partitioning; call ``partition_by_shard``
    first to reproduce fixed contiguous shards. Every input column crosses
    Arrow both ways (the Python function is opaque to column pruning), so
    select only the key and prompt columns first. With ``reuse`` the built
    generator (e.g. a loaded model) is kept per Python worker process and
    shared by the tasks that worker runs. ``partitions`` spreads the rows
    round-robin over that many tasks first (one shuffle of the prompts), so
    an unsplittable or oversized input partition cannot put most model
    calls into one task.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    fields = [f for f in df.schema.fields if f.name not in (output_col, status_col)]
    schema = T.StructType(fields + [T.StructField(output_col, T.StringType()),
                                    T.StructField(status_col, T.StringType())])
    names = [f.name for f in fields]
    key = _factory_key(factory) if reuse else None

    def run(batches):
        if key is None:
            fn = factory()
        else:
            store = _worker_store()
            fn = store.get(key)
            if fn is None:
                fn = store[key] = factory()
        for batch in batches:
            prompts = batch.column(prompt_col).to_pylist()
            outs: list = [None] * len(prompts)
            stats: list = ["no_prompt"] * len(prompts)
            todo = [i for i, p in enumerate(prompts) if p is not None]
            for s in range(0, len(todo), batch_size):
                idx = todo[s:s + batch_size]
                try:
                    res = list(fn([prompts[i] for i in idx]))
                    if len(res) != len(idx):
                        raise ValueError(f"generator returned {len(res)} answers for {len(idx)} prompts")
                    for i, r in zip(idx, res):
                        outs[i], stats[i] = (None if r is None else str(r)), "ok"
                except Exception:  # noqa: BLE001 - isolate the failing rows
                    for i in idx:
                        try:
                            r = list(fn([prompts[i]]))[0]
                            outs[i], stats[i] = (None if r is None else str(r)), "ok"
                        except Exception as e:  # noqa: BLE001
                            outs[i], stats[i] = f"{error_prefix}{e}", "error"
            # the other columns are handed through as they came (exact values, nulls included)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(outs, pa.string()), pa.array(stats, pa.string())],
                [*names, output_col, status_col])

    if partitions:
        df = df.repartition(partitions)
    return df.mapInArrow(run, schema)


def md5_generator() -> Generator:
    """Test generator: the md5 hex digest of the exact prompt bytes."""
    import hashlib

    def fn(prompts):
        return [hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]

    return fn


def failing_generator(marker: str = "ü", message: str = "rejected") -> Factory:
    """Test generator factory: md5 answers, but raise for any prompt that
    contains ``marker``."""

    def factory():
        base = md5_generator()

        def fn(prompts):
            for p in prompts:
                if marker in p:
                    raise ValueError(message)
            return base(prompts)

        return fn

    return factory


def replay(df: DataFrame, answers: DataFrame, on: str = "instruction",
           answer_col: str = "output", order_col: str | None = "row_idx",
           status_col: str = "status") -> DataFrame:
    """answer from a stored answers table instead of generating.

    Answers are reduced to one per key first (the one with the lowest
    ``order_col``; partial aggregation, so a hot key costs no skew), then
    left-joined. Rows with no stored answer get status ``missing``.
    """
    if order_col:
        best = answers.groupBy(on).agg(F.min_by(answer_col, order_col).alias("_answer"))
    else:
        best = answers.groupBy(on).agg(F.min(answer_col).alias("_answer"))
    joined = df.join(best, on, "left")
    return (joined.withColumn(answer_col, F.col("_answer"))
                  .withColumn(status_col, F.when(F.col("_answer").isNull(), F.lit("missing"))
                                           .otherwise(F.lit("ok")))
                  .drop("_answer"))


MODES = ("inline", "batch", "replay")


def answer(df: DataFrame, mode: str, *, factory: Factory | None = None,
           answers: DataFrame | None = None, responses: DataFrame | None = None,
           idx_col: str = "row_idx", **kw) -> DataFrame:
    """one entry point for the ways answers are obtained.

    ``inline``: run ``factory`` (F1/F2); ``batch``: parse ``responses``
    lines against requests built from ``df`` (G1-G4), each with the
    ``idx_col`` of its request (null for an unknown id); ``replay``: join
    stored ``answers`` (F7). Missing inputs raise ValueError.
    """
    if mode == "inline":
        if factory is None:
            raise ValueError("inline mode needs a generator factory")
        return generate(df, factory, **kw)
    if mode == "batch":
        if responses is None:
            raise ValueError("batch mode needs response lines")
        from distillery.operators import batchfile as B

        found = B.attach_instructions(B.parse_responses(responses), B.build_requests(df, idx_col, **kw))
        return found.withColumn(idx_col, B.request_index("custom_id", "status").cast(df.schema[idx_col].dataType))
    if mode == "replay":
        if answers is None:
            raise ValueError("replay mode needs an answers table")
        return replay(df, answers, **kw)
    raise ValueError(f"unknown generation mode {mode!r}; expected one of {MODES}")
