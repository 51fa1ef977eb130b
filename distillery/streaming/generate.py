"""Incremental generation that survives restarts.

Structured Streaming replaces append-and-count resume: new input files are
picked up by a file source, answered by the same Arrow generator as batch
generation (F1), and committed to a file sink; the checkpoint records which
input was done, so a restart answers only what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from distillery.operators.generate import Factory, generate


def stream_generate(spark: SparkSession, source_path: str, schema: T.StructType, transform,
                    factory: Factory, sink_path: str, checkpoint_path: str, source_format: str = "parquet",
                    sink_format: str = "parquet", timeout_s: int | None = None, batch_size: int = 256,
                    max_files_per_trigger: int | None = None, options: dict | None = None,
                    trigger: dict | None = None) -> bool:
    """Run one ``availableNow`` pass: every input not yet processed is
    answered and committed, then the query stops.

    ``transform(df) -> df`` builds the ``prompt`` column from the input
    rows. ``source_path`` is a folder (``options`` may narrow it, e.g.
    ``pathGlobFilter``). ``trigger`` defaults to ``{"availableNow": True}``;
    pass e.g. ``{"processingTime": "1 minute"}`` for a long-running stream
    (then ``timeout_s`` bounds how long this call waits). By default it waits
    for the end; a query that has not ended after ``timeout_s`` is stopped and
    ``TimeoutError`` raised: what is committed stays, and the next call goes on.
    """
    reader = spark.readStream.schema(schema).format(source_format).options(**(options or {}))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = transform(reader.load(source_path))
    answered = generate(rows, factory, batch_size=batch_size)
    q = (answered.writeStream.format(sink_format)
         .option("path", sink_path).option("checkpointLocation", checkpoint_path)
         .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
    done = q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination() or True
    if not done:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(f"streaming generation failed: {q.exception()}")
    if not done:
        raise TimeoutError(f"not all input was answered within {timeout_s} s")
    return True


def read_results(spark: SparkSession, sink_path: str, fmt: str = "parquet") -> DataFrame:
    """The committed results of all passes (the sink's own log decides which
    files count, so a half-written pass is never read)."""
    return spark.read.format(fmt).load(sink_path)
