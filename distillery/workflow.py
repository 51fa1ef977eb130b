"""The reference's workflow as file-to-file Spark steps.

1. ``prepare_prompts``   registry of JSONL datasets -> prompt corpus (JSONL)
2. ``answer_prompts``    prompt corpus -> teacher answers (JSONL), resumable
3. ``training_splits``   teacher answers -> train / test with training text
4. ``collate``           text -> padded token batches with causal labels
5. ``score_logits``      stored student / assistant logits -> CE, KD, loss

Each step reads what the previous one committed, so a step can be re-run
or resumed on its own; each is a handful of lazy plans and one write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distillery import options as O
from distillery.functions.text import teacher_prompt, training_text
from distillery.operators import batchfile as B
from distillery.operators import corpus as C
from distillery.operators import order as D
from distillery.operators import scoring as S
from distillery.operators import split as SP
from distillery.operators import tokens as K
from distillery.operators.generate import Factory, answer, generate
from distillery.sources import datasets as DS
from distillery.sources import fs, sinks

PROMPT_SCHEMA = "row_idx BIGINT, instruction STRING"
ANSWER_SCHEMA = "row_idx BIGINT, instruction STRING, output STRING, status STRING"


def prepare_prompts(spark: SparkSession, registry: list[O.RegistryEntry], jsonl_dir: str, out_path: str,
                    limit: int = O.PROMPT_WORD_LIMIT, snapshot_dir: str | None = None) -> str:
    """A9 + B1-B4 + C1 + D1 -> A6/A7: the indexed prompt corpus, written
    once (a complete output is kept as is)."""
    if fs.is_complete(spark, out_path):
        return out_path
    sources = DS.registry_sources(spark, registry, jsonl_dir, snapshot_dir)  # schemas from the catalogue
    corpus = C.build_corpus(sources, limit)
    sinks.write_once(corpus.select("row_idx", "instruction"), out_path)
    return out_path


def answer_prompts(spark: SparkSession, prompts_path: str, out_path: str, factory: Factory,
                   system: str = O.TEACHER_SYSTEM_PROMPT, batch_size: int = O.GEN_BATCH_SIZE,
                   resume: bool = True, partitions: int | None = None, blocks: int = 1) -> DataFrame:
    """E1 + F1/F2 + D4 + A6: answer every prompt that has no answer yet
    (left-anti on ``row_idx`` against what is already written, so an
    interrupted run resumes and a finished one adds nothing). Prompts are
    spread round-robin over ``partitions`` tasks (default: the cluster's
    default parallelism) so model calls are balanced. The rows are answered
    and committed in ``blocks`` parts, by ``row_idx`` modulo their number: a
    run that fails keeps the parts it has finished. Returns the whole answers
    table after the last append."""
    if blocks < 1:
        raise ValueError("blocks must be >= 1")
    prompts = spark.read.schema(PROMPT_SCHEMA).json(prompts_path)
    parts = partitions or spark.sparkContext.defaultParallelism
    for block in range(blocks):
        todo = prompts.filter(F.pmod("row_idx", F.lit(blocks)) == block) if blocks > 1 else prompts
        if resume and fs.exists(spark, out_path):
            todo = D.resume_by_key(todo, spark.read.schema(ANSWER_SCHEMA).json(out_path), "row_idx")
        rows = todo.select("row_idx", "instruction", teacher_prompt("instruction", system).alias("prompt"))
        answered = generate(rows, factory, batch_size=batch_size, partitions=parts).select(
            "row_idx", "instruction", "output", "status")
        sinks.append_jsonl(answered, out_path)
    return spark.read.schema(ANSWER_SCHEMA).json(out_path)


def write_batch_requests(spark: SparkSession, prompts_path: str, out_path: str, **kw) -> None:
    """G1 to files: one request line per prompt."""
    prompts = spark.read.schema(PROMPT_SCHEMA).json(prompts_path)
    B.build_requests(prompts, **kw).select("request").write.text(out_path)


def read_batch_responses(spark: SparkSession, responses_path: str, prompts_path: str, out_path: str) -> DataFrame:
    """G2-G5 from files: response lines become answers with the ``row_idx``
    of their prompt, added unless that prompt is answered already; lines with
    an unknown id are left out. Returns the whole answers table."""
    prompts = spark.read.schema(PROMPT_SCHEMA).json(prompts_path)
    found = answer(prompts, "batch", responses=spark.read.text(responses_path)).filter("row_idx IS NOT NULL")
    best = found.groupBy("row_idx").agg(F.min(F.struct(F.col("status") != "ok", "instruction", "output", "status")).alias("a"))
    sinks.append_new_results(best.select("row_idx", "a.instruction", "a.output", "a.status"), out_path, key="row_idx")
    return spark.read.schema(ANSWER_SCHEMA).json(out_path)


def training_splits(spark: SparkSession, answers_path: str, test_size: float = O.TEST_SIZE,
                    seed: int = O.SFT_SPLIT_SEED, system: str = O.ASSISTANT_SYSTEM_PROMPT
                    ) -> tuple[DataFrame, DataFrame]:
    """H0 + H1 + E4: (train, test), each with the training ``text``."""
    t = SP.load_teacher(spark, answers_path, schema=SP.TEACHER_SCHEMA)
    t = t.withColumn("text", training_text("instruction", "output", system))
    return SP.exact_split(t, "row_idx", test_size, seed)


def collate(df: DataFrame, vocab: K.Vocab, max_length: int = O.SFT_MAX_LENGTH,
            batch_size: int = O.SFT_BATCH_SIZE, side: str = "left", keep_text: bool = True) -> DataFrame:
    """H6-H9 + B5: ids truncated to ``max_length``, batches of ``batch_size``
    rows in ``row_idx`` order padded to their longest row, attention mask
    and causal labels."""
    e = K.encode(df, vocab, "text", "input_ids", max_length)
    idx = D.with_row_index(e.select("row_idx", "text", "input_ids"), ["row_idx"], "_seq")
    b = D.assign_batches(idx, batch_size, pos="_seq")
    padded = K.pad_batches(b, "input_ids", "batch_id", side)
    out = padded.withColumn("labels", K.causal_labels("input_ids"))
    cols = (["text"] if keep_text else []) + ["batch_id", "input_ids", "attention_mask", "labels"]
    return out.select("row_idx", *cols)


def score_logits(logits: DataFrame, temperature: float = O.KD_TEMPERATURE, weight: float = O.KD_WEIGHT,
                 reduction: str = "batchmean") -> DataFrame:
    """I1-I9 on stored logits: one row ``ce``, ``kd``, ``loss``."""
    return S.combined_loss(logits, temperature, weight, reduction)


def vocabulary(texts: DataFrame, size: int = 32000) -> K.Vocab:
    """H4 + H5 built from training texts and collected (size-checked)."""
    return K.Vocab.load(K.build_vocab(texts, "text", size))


def count_answers(spark: SparkSession, answers_path: str) -> dict[str, int]:
    """Rows per status in the answers written so far."""
    df = spark.read.schema(ANSWER_SCHEMA).json(answers_path)
    return {r["status"]: int(r["n"]) for r in
            df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
