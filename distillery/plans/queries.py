"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each one runs a library operator over whole driver tables (or data Spark
derives from them). Column names match the oracle SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distillery import options as O
from distillery.functions import text as TX
from distillery.operators import corpus as C
from distillery.plans import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ----------------------------------------------------------------- corpus

def _union(spark, sf_dir):
    return C.union_sources(FX.corpus_sources(spark, sf_dir))


def _corpus(spark, sf_dir):
    return C.build_corpus(FX.corpus_sources(spark, sf_dir), O.PROMPT_WORD_LIMIT)


@query("corpus_union")
def q_corpus_union(spark, sf_dir):
    return _union(spark, sf_dir).select("dataset_ord", "dataset", "split", "row_key", "instruction")


@query("corpus_word_count")
def q_corpus_word_count(spark, sf_dir):
    return (C.corpus_word_counts(_union(spark, sf_dir))
            .select("dataset", "split", "row_key", "word_count"))


@query("corpus_filter")
def q_corpus_filter(spark, sf_dir):
    return (C.filter_corpus(_union(spark, sf_dir), O.PROMPT_WORD_LIMIT)
            .select("dataset", "split", "row_key", "instruction"))


@query("row_index")
def q_row_index(spark, sf_dir):
    return _corpus(spark, sf_dir).select("row_idx", "dataset", "split", "row_key", "instruction")


@query("prompt_teacher")
def q_prompt_teacher(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus -> teacher prompt: dataset, split, row_idx, instruction, prompt."""
    return (C.with_teacher_prompt(_corpus(spark, sf_dir))
            .select("dataset", "split", "row_idx", "instruction", "prompt"))


@query("prompt_assistant")
def q_prompt_assistant(spark, sf_dir):
    return _corpus(spark, sf_dir).select("row_idx", TX.assistant_prompt("instruction").alias("prompt"))


@query("prompt_student")
def q_prompt_student(spark, sf_dir):
    return _corpus(spark, sf_dir).select("row_idx", TX.student_prompt("instruction").alias("prompt"))


# ------------------------------------------------------- templates, rules

def _pairs(spark, sf_dir):
    return FX.pairs(spark, sf_dir)


@query("sft_text")
def q_sft_text(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_idx", TX.training_text("instruction", "output").alias("text"))


@query("chat_messages")
def q_chat_messages(spark, sf_dir):
    m = TX.chat_messages("instruction")
    return (_corpus(spark, sf_dir).select("row_idx", m.alias("m"))
            .select("row_idx", F.size("m").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
                    F.element_at("m", 1)["content"].alias("system_content"),
                    F.element_at("m", 2)["content"].alias("user_content")))


@query("chat_render")
def q_chat_render(spark, sf_dir):
    from distillery.operators.chat import conversation_messages

    msgs = conversation_messages(FX.conversation_turns(spark, sf_dir))
    return msgs.select("conv_id", F.size("messages").cast("bigint").alias("n_turns"),
                       TX.render_messages("messages").alias("text"))


@query("chat_turn_lines")
def q_chat_turn_lines(spark, sf_dir):
    """E7 turn by turn, without a conversation in one row."""
    from distillery.operators.chat import render_turn_lines

    return render_turn_lines(FX.conversation_turns(spark, sf_dir)).select("conv_id", "turn", "line")


@query("rules_quarantine")
def q_rules_quarantine(spark, sf_dir):
    from distillery.operators import rules as R

    rs = [R.min_length("text", 20), R.max_length("text", 1024), R.one_of("lang", ["en", "de", "fr"]),
          R.required("quality"), R.one_of("toxic", [0], optional=True)]
    v = R.validate(FX.rules_input(spark, sf_dir), rs)
    return v.select("doc_id", "is_valid", F.array_join("errors", ";").alias("errors"))


@query("system_prompt_check")
def q_system_prompt_check(spark, sf_dir):
    from distillery.operators import rules as R

    turns = FX.conversation_turns(spark, sf_dir).filter(F.col("role") == "system")
    v = R.validate(turns, R.system_prompt_rules("text"))
    return v.select("conv_id", "turn", "is_valid", F.array_join("errors", ";").alias("errors"))


# ------------------------------------------------- shards, batches, resume

WORLD = 4


def _sharded(spark, sf_dir):
    from distillery.operators import order as D

    c, n = C.build_corpus_and_count(FX.corpus_sources(spark, sf_dir), O.PROMPT_WORD_LIMIT)
    return D.assign_shards(c, n, WORLD)


@query("shard_assign")
def q_shard_assign(spark, sf_dir):
    return _sharded(spark, sf_dir).select("row_idx", "shard_id", "shard_pos")


@query("batch_assign")
def q_batch_assign(spark, sf_dir):
    from distillery.operators import order as D

    return (D.assign_batches(_sharded(spark, sf_dir), O.SFT_BATCH_SIZE)
            .select("row_idx", "shard_id", "batch_id"))


@query("shard_stats")
def q_shard_stats(spark, sf_dir):
    from distillery.operators import order as D

    return D.batch_stats(D.assign_batches(_sharded(spark, sf_dir), O.SFT_BATCH_SIZE))


def _earlier_run(spark, rows):
    """The output that an earlier, partial run committed."""
    from distillery.session import scratch_path
    from distillery.sources import progress

    path = scratch_path(spark, "partial")
    progress.append_part(rows.select("row_idx", "instruction"), path)
    return path


@query("resume_offset")
def q_resume_offset(spark, sf_dir):
    """An earlier run answered the first two datasets and was interrupted:
    count what it committed, from its log (A10), and resume after that many
    rows (D4, count mode)."""
    from distillery.operators import order as D
    from distillery.sources import progress

    c = _corpus(spark, sf_dir)
    path = _earlier_run(spark, c.filter(F.col("dataset_ord") < 2))
    return D.resume_by_count(c, progress.committed_rows(spark, path)).select("row_idx", "dataset", "instruction")


@query("resume_ranges")
def q_resume_ranges(spark, sf_dir):
    """Earlier runs committed parts of the corpus out of order; the row ranges
    in the log tell what is left (D4, range mode)."""
    from distillery.sources import progress

    c = _corpus(spark, sf_dir)
    path = _earlier_run(spark, c.filter(F.col("dataset_ord") == 1))
    progress.append_part(c.filter(F.col("split") == "de").select("row_idx", "instruction"), path)
    return progress.resume_by_ranges(c, progress.committed_ranges(spark, path)).select("row_idx", "dataset", "instruction")


@query("resume_anti")
def q_resume_anti(spark, sf_dir):
    """Skip instructions that already have a stored answer (D4, key mode)."""
    from distillery.operators import order as D

    produced = _pairs(spark, sf_dir).select("instruction")
    return D.resume_by_key(_corpus(spark, sf_dir), produced, "instruction").select(
        "row_idx", "dataset", "instruction")


# ------------------------------------------------------------- generation

def _prompts(spark, sf_dir):
    """Only the columns the answer needs: ``mapInArrow`` is opaque to column
    pruning, so everything selected here crosses Arrow twice."""
    return C.with_teacher_prompt(_corpus(spark, sf_dir)).select("row_idx", "instruction", "prompt")


@query("gen_md5")
def q_gen_md5(spark, sf_dir):
    from distillery.operators.generate import generate, md5_generator

    return generate(_prompts(spark, sf_dir), md5_generator).select("row_idx", "instruction", "output", "status")


@query("gen_error_rows")
def q_gen_error_rows(spark, sf_dir):
    from distillery.operators.generate import failing_generator, generate

    return (generate(_prompts(spark, sf_dir), failing_generator("ü"), batch_size=4)
            .select("row_idx", "instruction", "output", "status"))


@query("shard_merge")
def q_shard_merge(spark, sf_dir):
    """Contiguous shards generated in their own tasks and written as one
    folder per shard; merged into one committed folder in row order, after
    which the shards are gone (C2)."""
    from distillery.operators import order as D
    from distillery.operators.generate import generate, md5_generator
    from distillery.session import scratch_path
    from distillery.sources import sinks

    s = C.with_teacher_prompt(_sharded(spark, sf_dir)).select("row_idx", "shard_id", "instruction", "prompt")
    outs = generate(D.partition_by_shard(s, WORLD), md5_generator)
    path = scratch_path(spark, "shards")
    sinks.write_shards(outs.select("row_idx", "shard_id", "instruction", "output"), path)
    merged = sinks.merge_shards_to(spark, path, scratch_path(spark, "merged"))
    return merged.select("row_idx", "shard_id", "instruction", "output")


@query("gen_replay")
def q_gen_replay(spark, sf_dir):
    from distillery.operators.generate import replay

    answers = _pairs(spark, sf_dir).select("instruction", "output", "row_idx")
    return replay(_corpus(spark, sf_dir).select("row_idx", "instruction"), answers.withColumnRenamed(
        "row_idx", "answer_idx"), order_col="answer_idx").select("row_idx", "instruction", "output", "status")


# ------------------------------------------------------------ batch files

REQUEST_FIELDS = ("custom_id STRING, method STRING, url STRING, body STRUCT<model: STRING, "
                  "messages: ARRAY<STRUCT<role: STRING, content: STRING>>, temperature: DOUBLE, "
                  "top_p: DOUBLE>")


@query("batch_requests")
def q_batch_requests(spark, sf_dir):
    from distillery.operators.batchfile import build_requests

    r = build_requests(_corpus(spark, sf_dir))
    p = F.from_json("request", REQUEST_FIELDS).alias("p")
    return r.select("instruction", p).select(
        F.col("p.custom_id").alias("custom_id"), F.col("p.method").alias("method"),
        F.col("p.url").alias("url"), F.col("p.body.model").alias("model"),
        F.size("p.body.messages").cast("bigint").alias("n_messages"),
        F.element_at("p.body.messages", 1)["role"].alias("system_role"),
        F.element_at("p.body.messages", 1)["content"].alias("system_content"),
        F.element_at("p.body.messages", 2)["content"].alias("user_content"),
        F.col("p.body.temperature").alias("temperature"), F.col("p.body.top_p").alias("top_p"),
        (F.element_at("p.body.messages", 2)["content"] == F.col("instruction")).alias("same_text"))


def _batch_results(spark, sf_dir):
    from distillery.operators import batchfile as B

    p = _pairs(spark, sf_dir)
    lines = FX.response_lines_from(p)
    return B.attach_instructions(B.parse_responses(lines), B.build_requests(p))


@query("batch_responses")
def q_batch_responses(spark, sf_dir):
    return _batch_results(spark, sf_dir).select("custom_id", "instruction", "output", "status")


@query("batch_status")
def q_batch_status(spark, sf_dir):
    from distillery.operators.batchfile import status_counts

    return status_counts(_batch_results(spark, sf_dir))


# ------------------------------------------------------------------ split

def _split(spark, sf_dir):
    from distillery.operators.split import exact_split

    p = _pairs(spark, sf_dir).withColumn("text", TX.training_text("instruction", "output"))
    return exact_split(p, "row_idx", O.TEST_SIZE, O.SFT_SPLIT_SEED)


@query("split_test")
def q_split_test(spark, sf_dir):
    return _split(spark, sf_dir)[1].select("row_idx", "text")


@query("split_train")
def q_split_train(spark, sf_dir):
    return _split(spark, sf_dir)[0].select("row_idx", "text")


@query("teacher_load")
def q_teacher_load(spark, sf_dir):
    """Generated answers appended as JSONL (A6), loaded back for training
    with error rows dropped (H0)."""
    from distillery.operators.generate import failing_generator, generate
    from distillery.operators.split import load_teacher
    from distillery.session import scratch_path
    from distillery.sources import sinks

    out = generate(_prompts(spark, sf_dir), failing_generator("ü"))
    path = scratch_path(spark, "teacher")
    sinks.append_jsonl(out.select("instruction", "output", "row_idx", "status"), path)
    return load_teacher(spark, path).select("row_idx", "instruction", "output")


@query("split_plain_teacher")
def q_split_plain_teacher(spark, sf_dir):
    """H0 + H1 on a teacher file of plain instruction / output rows: it is
    numbered in the order of both texts, then split."""
    from distillery.operators.split import exact_split, load_teacher
    from distillery.session import scratch_path
    from distillery.sources import sinks

    path = scratch_path(spark, "plain")
    sinks.append_jsonl(_pairs(spark, sf_dir).select("instruction", "output"), path)
    train, test = exact_split(load_teacher(spark, path), "row_idx", O.TEST_SIZE, O.SFT_SPLIT_SEED)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "instruction", "output")
    return side(train, "train").unionByName(side(test, "test"))


# ----------------------------------------------------------------- tokens

VOCAB_SIZE = 4096


def _sft_texts(spark, sf_dir, pairs=None):
    p = pairs if pairs is not None else _pairs(spark, sf_dir)
    return p.select("row_idx", TX.training_text("instruction", "output").alias("text"))


def _vocab(spark, sf_dir, texts=None):
    from distillery.operators.tokens import build_vocab

    t = texts if texts is not None else _sft_texts(spark, sf_dir)
    return build_vocab(t, "text", VOCAB_SIZE)


def _token_inputs(spark, sf_dir):
    """Pairs, their training texts and the collected vocabulary, built once."""
    from distillery.operators.tokens import Vocab

    p = _pairs(spark, sf_dir)
    texts = _sft_texts(spark, sf_dir, p)
    return p, texts, Vocab.load(_vocab(spark, sf_dir, texts))


def _encoded(spark, sf_dir, max_length=O.SFT_MAX_LENGTH, inputs=None):
    from distillery.operators.tokens import encode

    _, texts, vocab = inputs or _token_inputs(spark, sf_dir)
    return encode(texts, vocab, "text", "input_ids", max_length)


@query("vocab")
def q_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query("encode")
def q_encode(spark, sf_dir):
    from distillery.operators.tokens import ids_text

    e = _encoded(spark, sf_dir)
    return e.select("row_idx", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    ids_text("input_ids").alias("ids"))


@query("truncate")
def q_truncate(spark, sf_dir):
    """KD tokenizer (max 512) over whole documents: long texts are cut."""
    from distillery.operators.tokens import encode, ids_text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    e = encode(docs, _token_inputs(spark, sf_dir)[2], "text", "input_ids", O.KD_MAX_LENGTH)
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    TX.word_count("text").alias("n_words"), ids_text("input_ids").alias("ids"))


def _padded(spark, sf_dir, inputs=None):
    from distillery.operators.tokens import pad_batches

    e = _encoded(spark, sf_dir, inputs=inputs).withColumn(
        "batch_id", F.floor(F.col("row_idx") / O.KD_BATCH_SIZE).cast("bigint"))
    return pad_batches(e, "input_ids", "batch_id", "left")


@query("pad_left")
def q_pad_left(spark, sf_dir):
    from distillery.operators.tokens import ids_text

    return _padded(spark, sf_dir).select("row_idx", "batch_id", F.size("input_ids").cast("bigint").alias("length"),
                                         ids_text("input_ids").alias("ids"), ids_text("attention_mask").alias("mask"))


@query("labels_causal")
def q_labels_causal(spark, sf_dir):
    from distillery.operators.tokens import causal_labels, ids_text

    return _padded(spark, sf_dir).select("row_idx", ids_text(causal_labels("input_ids")).alias("labels"))


@query("decode")
def q_decode(spark, sf_dir):
    from distillery.operators.tokens import decode

    inputs = _token_inputs(spark, sf_dir)
    return decode(_padded(spark, sf_dir, inputs), inputs[2], "input_ids", "decoded").select("row_idx", "decoded")


@query("drop_prompt_ids")
def q_drop_prompt_ids(spark, sf_dir):
    """Cut the student-prompt ids off the full training-text ids."""
    from distillery.operators.tokens import drop_prompt, encode, ids_text

    pairs, _, v = _token_inputs(spark, sf_dir)
    p = pairs.select("row_idx", TX.training_text("instruction", "output").alias("text"),
                     TX.student_prompt("instruction").alias("prompt"))
    p = encode(encode(p, v, "text", "full_ids", None), v, "prompt", "prompt_ids", None)
    ans = drop_prompt("full_ids", F.size("prompt_ids"))
    return p.select("row_idx", F.size("prompt_ids").cast("bigint").alias("n_prompt"),
                    F.size(ans).cast("bigint").alias("n_answer"), ids_text(ans).alias("ids"))


@query("drop_special_ids")
def q_drop_special_ids(spark, sf_dir):
    from distillery.operators.tokens import drop_special, ids_text

    return _padded(spark, sf_dir).select("row_idx", ids_text(drop_special("input_ids")).alias("ids"))


@query("token_profile")
def q_token_profile(spark, sf_dir):
    from distillery.operators.tokens import token_profile

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_profile(docs, "text", O.KD_MAX_LENGTH)


# ---------------------------------------------------------------- scoring

def _logits(spark, sf_dir):
    return FX.logits(spark, sf_dir)


@query("kd_softmax")
def q_kd_softmax(spark, sf_dir):
    from distillery.functions import logits as L

    p = L.softmax(L.scale("assistant", O.KD_TEMPERATURE))
    return _logits(spark, sf_dir).select("sample_id", "pos", p.alias("p")).select(
        "sample_id", "pos", F.round(F.array_max("p"), 6).alias("p_max"), L.argmax("p").alias("p_argmax"),
        F.round(L.weighted_index_sum("p"), 6).alias("p_check"), F.round(L.array_sum("p"), 6).alias("p_sum"))


@query("kd_log_softmax")
def q_kd_log_softmax(spark, sf_dir):
    from distillery.functions import logits as L

    lp = L.log_softmax(L.scale("student", O.KD_TEMPERATURE))
    return _logits(spark, sf_dir).select("sample_id", "pos", lp.alias("lp")).select(
        "sample_id", "pos", F.round(F.array_max("lp"), 6).alias("lp_max"),
        F.round(L.array_sum("lp"), 6).alias("lp_sum"))


@query("kd_pointwise")
def q_kd_pointwise(spark, sf_dir):
    from distillery.functions import logits as L

    t = L.kl_terms("student", "assistant", O.KD_TEMPERATURE)
    return _logits(spark, sf_dir).select("sample_id", "pos", t.alias("t")).select(
        "sample_id", "pos", F.round(L.array_sum("t"), 6).alias("kl"),
        F.round(F.array_max("t"), 6).alias("kl_max_term"))


@query("kd_reduce")
def q_kd_reduce(spark, sf_dir):
    from distillery.operators import scoring as S

    r = S.kd_reductions(_logits(spark, sf_dir), O.KD_TEMPERATURE)
    return r.select(*[F.round(c, 6).alias(c) for c in ("batchmean", "sum", "mean")])


def _mismatched(spark, sf_dir):
    """Logits whose assistant lacks an entry on some rows."""
    cut = F.slice("assistant", F.lit(1), F.size("assistant") - 1)
    return _logits(spark, sf_dir).withColumn(
        "assistant", F.when(F.col("label") == O.IGNORE_INDEX, cut).otherwise(F.col("assistant")))


@query("kd_mismatch")
def q_kd_mismatch(spark, sf_dir):
    """Rows whose assistant has another vocabulary size than the student are
    set aside (I4)."""
    from distillery.operators import scoring as S

    return S.vocab_mismatch(_mismatched(spark, sf_dir)).select(
        "sample_id", "pos", F.size("student").cast("bigint").alias("n_student"), F.size("assistant").cast("bigint").alias("n_assistant"))


@query("kd_mismatch_reduce")
def q_kd_mismatch_reduce(spark, sf_dir):
    """The KL reductions leave such rows out, of the denominators too."""
    from distillery.operators import scoring as S

    r = S.kd_reductions(_mismatched(spark, sf_dir), O.KD_TEMPERATURE)
    return r.select(*[F.round(c, 6).alias(c) for c in ("batchmean", "sum", "mean")])


@query("ce_loss")
def q_ce_loss(spark, sf_dir):
    from distillery.operators import scoring as S

    return S.ce_loss(FX.stored_logits(spark, sf_dir), stored=True).select(F.round("ce", 6).alias("ce"), "n_valid")


@query("combined_loss")
def q_combined_loss(spark, sf_dir):
    from distillery.operators import scoring as S

    r = S.combined_loss(FX.stored_logits(spark, sf_dir), O.KD_TEMPERATURE, O.KD_WEIGHT, stored=True)
    return r.select(F.round("ce", 6).alias("ce"), F.round("kd", 6).alias("kd"), F.round("loss", 6).alias("loss"))


@query("kd_long")
def q_kd_long(spark, sf_dir):
    from distillery.operators import scoring as S

    return S.kd_long(S.explode_logits(_logits(spark, sf_dir)), O.KD_TEMPERATURE).select(
        F.round("kd", 6).alias("batchmean"))


# --------------------------------------------------------------- sampling

TOP_K, TOP_P, SAMPLE_SEED = 20, 0.6, 7


def _cands(spark, sf_dir):
    return FX.candidates(spark, sf_dir)


@query("sample_top_k")
def q_sample_top_k(spark, sf_dir):
    from distillery.operators.sampling import top_k

    return top_k(_cands(spark, sf_dir), TOP_K).select("ctx", "tok", F.col("rank").cast("bigint").alias("rank"))


def _kept(spark, sf_dir):
    from distillery.operators.sampling import top_k, top_p

    return top_p(top_k(_cands(spark, sf_dir), TOP_K), TOP_P, O.KD_TEMPERATURE)


@query("sample_top_p")
def q_sample_top_p(spark, sf_dir):
    return _kept(spark, sf_dir).select("ctx", "tok", F.round("p", 6).alias("p"))


@query("sample_nucleus")
def q_sample_nucleus(spark, sf_dir):
    """I12 without top-k: whole contexts, cut by a histogram before ranking."""
    from distillery.operators.sampling import top_p

    return top_p(_cands(spark, sf_dir), TOP_P, O.KD_TEMPERATURE).select("ctx", "tok", F.round("p", 6).alias("p"))


@query("sample_greedy")
def q_sample_greedy(spark, sf_dir):
    from distillery.operators.sampling import greedy

    return greedy(_cands(spark, sf_dir))


@query("sample_seeded")
def q_sample_seeded(spark, sf_dir):
    from distillery.operators.sampling import sample

    return sample(_kept(spark, sf_dir), SAMPLE_SEED)


# -------------------------------------------------------- sources, sinks

@query("jsonl_roundtrip")
def q_jsonl_roundtrip(spark, sf_dir):
    """A4 + A6: the union written as one JSONL folder per split; A1 + A2:
    read back with the split taken from the folder name."""
    from distillery.session import scratch_path
    from distillery.sources import datasets as DS
    from distillery.sources import sinks

    u = _union(spark, sf_dir).select("split", "dataset", "row_key", "instruction")
    root = scratch_path(spark, "jsonl")
    sinks.write_jsonl_splits(u, f"{root}/corpus")
    schema = "dataset STRING, row_key BIGINT, instruction STRING"
    return DS.read_dataset(spark, root, "corpus", schema).select("split", "dataset", "row_key", "instruction")


@query("jsonl_null_split")
def q_jsonl_null_split(spark, sf_dir):
    """A4: rows without a split, with an empty one and with one called `null`
    are written to folders of their own and come back as they were."""
    from distillery.session import scratch_path
    from distillery.sources import datasets as DS
    from distillery.sources import sinks

    split = F.when(F.col("lang") == "fr", F.lit("null")).when(F.col("lang") == "es", F.lit("")).when(
        F.col("lang") != "de", F.col("lang"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(split.alias("split"), "doc_id", "text")
    root = scratch_path(spark, "nullsplit")
    sinks.write_jsonl_splits(rows, f"{root}/docs")
    return DS.read_dataset(spark, root, "docs").select("split", "doc_id", "text")


@query("registry_run")
def q_registry_run(spark, sf_dir):
    """A9 + A3 + B7: the three sources saved as JSONL datasets, with their
    schemas in the catalogue, and a fourth entry without a key, resolved from
    a registry and run through the corpus (file order inside each split,
    indexed by scan blocks)."""
    from distillery.session import scratch_path
    from distillery.sources import datasets as DS
    from distillery.sources import sinks

    root = scratch_path(spark, "registry")
    for src in FX.corpus_sources(spark, sf_dir):
        rows = C.union_sources([src]).select("split", F.col("instruction").alias("text"), "row_key")
        sinks.write_jsonl_splits(FX.in_table_order(rows, "row_key"), f"{root}/{src.name}")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("split", F.lit("train"))
    sinks.write_jsonl_splits(labels, f"{root}/labels")
    entries = [O.RegistryEntry("documents", "text"), O.RegistryEntry("labels", None),
               O.RegistryEntry("benchmark", "text"), O.RegistryEntry("conversations", "text")]
    corpus = C.build_corpus(DS.registry_sources(spark, entries, root))
    return corpus.select("row_idx", "dataset", "split", "instruction")


@query("manifest")
def q_manifest(spark, sf_dir):
    from distillery.sources.manifest import manifest, tags_text

    t = _pairs(spark, sf_dir).select("row_idx", "instruction", "output")
    m = manifest(t, "teacher", "teacher_outputs", tags={"version": "v1", "source": "teacher_outputs"},
                 digest="md5")
    return m.select("name", "source", "n_rows", "n_cols", tags_text("tags").alias("tags"), "digest")


@query("manifest_merge")
def q_manifest_merge(spark, sf_dir):
    """The manifest of a dataset after an append, from the record before
    and that of the appended rows."""
    from distillery.sources.manifest import manifest, merge_manifests, tags_text

    t = _pairs(spark, sf_dir).select("row_idx", "instruction", "output")
    tags = {"version": "v1", "source": "teacher_outputs"}
    half = F.col("row_idx") % 3 == 0
    old = manifest(t.filter(half), "teacher", "teacher_outputs", tags=tags, digest="md5")
    new = manifest(t.filter(~half), "part", "append", digest="md5")
    return merge_manifests(old, new).select("name", "source", "n_rows", "n_cols", tags_text("tags").alias("tags"), "digest")


@query("gen_stream")
def q_gen_stream(spark, sf_dir):
    """user turns streamed from the table file, answered and committed
    with a checkpoint (one availableNow pass), then read back."""
    from distillery.operators.generate import md5_generator
    from distillery.session import scratch_path
    from distillery.sources import fs
    from distillery.streaming.generate import read_results, stream_generate

    src = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(src).schema

    def prompts(df):
        return (df.filter(F.col("role") == "user")
                  .select("conv_id", "turn", F.col("text").alias("instruction"),
                          TX.teacher_prompt("text").alias("prompt")))

    root = scratch_path(spark, "stream")
    # the table is a folder of part files, or one file in the folder of all tables
    folder = fs.is_folder(spark, src)
    stream_generate(spark, src if folder else sf_dir, schema, prompts, md5_generator, f"{root}/out", f"{root}/ckpt",
                    options={} if folder else {"pathGlobFilter": "conversations.parquet"})
    return read_results(spark, f"{root}/out").select("conv_id", "turn", "instruction", "output", "status")


@query("sft_features")
def q_sft_features(spark, sf_dir):
    """B5 (SFT): training text plus token columns, nothing else."""
    from distillery.operators.filters import prune_for_sft
    from distillery.operators.tokens import ids_text

    e = _encoded(spark, sf_dir).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    f = prune_for_sft(e)
    return f.select("text", ids_text("input_ids").alias("ids"), ids_text("attention_mask").alias("mask"))


@query("kd_features")
def q_kd_features(spark, sf_dir):
    """B5 (KD): token columns only, KD length limit."""
    from distillery.operators.filters import prune_for_kd
    from distillery.operators.tokens import ids_text

    e = _encoded(spark, sf_dir, O.KD_MAX_LENGTH).withColumn(
        "attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    f = prune_for_kd(e)
    return f.select(ids_text("input_ids").alias("ids"), ids_text("attention_mask").alias("mask"))


@query("snapshot_roundtrip")
def q_snapshot_roundtrip(spark, sf_dir):
    """A5 + A3: a columnar snapshot of a source, resolved through the source
    order (no JSONL present -> snapshot) and saved as JSONL; the second
    resolve, without a snapshot, reads that."""
    from distillery.session import scratch_path
    from distillery.sources import datasets as DS
    from distillery.sources import sinks

    root = scratch_path(spark, "snap")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.col("text").alias("instruction"))
    sinks.write_snapshot(docs, f"{root}/snapshots/documents")
    DS.resolve_source(spark, O.RegistryEntry("documents"), f"{root}/jsonl", f"{root}/snapshots")
    df = DS.resolve_source(spark, O.RegistryEntry("documents"), f"{root}/jsonl")
    return df.select("doc_id", "lang", "instruction", "split")


@query("prompts_once")
def q_prompts_once(spark, sf_dir):
    """The prompt file is written once; a second run finds it complete
    and skips the step."""
    from distillery.session import scratch_path
    from distillery.sources import sinks

    path = scratch_path(spark, "prompts")
    corpus = _corpus(spark, sf_dir).select("row_idx", "instruction")
    first = sinks.write_once(corpus, path)
    second = sinks.write_once(corpus, path)
    if not first or second:
        raise RuntimeError("write_once did not skip a complete output")
    return spark.read.schema("row_idx BIGINT, instruction STRING").json(path)


@query("gen_dispatch")
def q_gen_dispatch(spark, sf_dir):
    """the same corpus answered inline (generator) and by replay
    (stored answers), and the pairs' instructions by batch response lines,
    through one entry point."""
    from distillery.operators.generate import answer, md5_generator

    c = _prompts(spark, sf_dir)
    answers = _pairs(spark, sf_dir).select("instruction", "output", F.col("row_idx").alias("answer_idx"))
    inline = answer(c, "inline", factory=md5_generator).select(
        F.lit("inline").alias("mode"), "row_idx", "output", "status")
    replayed = answer(c.select("row_idx", "instruction"), "replay", answers=answers, order_col="answer_idx").select(
        F.lit("replay").alias("mode"), "row_idx", "output", "status")
    p = _pairs(spark, sf_dir)
    batch = answer(p, "batch", responses=FX.response_lines_from(p)).select(
        F.lit("batch").alias("mode"), "row_idx", "output", "status")
    return inline.unionByName(replayed).unionByName(batch)


@query("batch_append")
def q_batch_append(spark, sf_dir):
    """Parsed batch results appended to the teacher output twice; the
    second append adds nothing (left-anti on custom_id)."""
    from distillery.session import scratch_path
    from distillery.sources import sinks

    res = _batch_results(spark, sf_dir).select("custom_id", "instruction", "output", "status")
    path = scratch_path(spark, "teacher-batch")
    sinks.append_new_results(res, path)
    sinks.append_new_results(res, path)
    return spark.read.schema(res.schema).json(path)


@query("encode_join")
def q_encode_join(spark, sf_dir):
    """H6 with the vocabulary as a table: blocks of rows look up their
    distinct words."""
    from distillery.operators.tokens import encode, ids_text

    texts = _sft_texts(spark, sf_dir)
    e = encode(texts, _vocab(spark, sf_dir, texts), "text", "input_ids", O.SFT_MAX_LENGTH)
    return e.select("row_idx", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    ids_text("input_ids").alias("ids"))


@query("decode_join")
def q_decode_join(spark, sf_dir):
    """H10 with the vocabulary as a table: blocks of rows look up their
    distinct ids."""
    from distillery.operators.tokens import decode

    inputs = _token_inputs(spark, sf_dir)
    vocab = inputs[2].frame(spark)
    return decode(_padded(spark, sf_dir, inputs), vocab, "input_ids", "decoded").select("row_idx", "decoded")


@query("kd_reduce_jvm")
def q_kd_reduce_jvm(spark, sf_dir):
    """I5 + I6 through the higher-order-function path (no Python)."""
    from distillery.operators import scoring as S

    r = S.kd_reductions(_logits(spark, sf_dir), O.KD_TEMPERATURE, method="hof")
    return r.select(*[F.round(c, 6).alias(c) for c in ("batchmean", "sum", "mean")])
