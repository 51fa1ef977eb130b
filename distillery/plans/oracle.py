"""DuckDB SQL equivalents of the registered queries (same column names).

Tables are the pre-registered views over the driver parquet files.
"""

from __future__ import annotations

from distillery import options as O
from distillery.functions.text import WORD_PATTERN_RE2

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _nl(s: str) -> str:
    """SQL expression for a text that may contain newlines."""
    parts = s.split("\n")
    return " || chr(10) || ".join(_q(p) for p in parts)


TEACHER = _nl(O.TEACHER_SYSTEM_PROMPT)
ASSISTANT = _nl(O.ASSISTANT_SYSTEM_PROMPT)


def words(c: str) -> str:
    """Python ``str.split()`` word count of ``c`` as BIGINT."""
    return "CAST(len(regexp_extract_all(" + c + ", '" + WORD_PATTERN_RE2 + "')) AS BIGINT)"


UNION = """
  SELECT 0 AS dataset_ord, 'documents' AS dataset, lang AS split,
         CAST(doc_id AS BIGINT) AS row_key, text AS instruction FROM documents
  UNION ALL
  SELECT 1, 'benchmark', 'train', CAST(item_id AS BIGINT), text FROM benchmark
  UNION ALL
  SELECT 2, 'conversations', 'train', CAST(conv_id * 1000 + turn AS BIGINT), text
  FROM conversations WHERE role = 'user'
"""

FILTERED = f"""
  SELECT * FROM ({UNION}) u
  WHERE instruction IS NOT NULL AND instruction <> ''
    AND {words('instruction')} <= {O.PROMPT_WORD_LIMIT}
"""

CORPUS = f"""
  SELECT *, row_number() OVER (ORDER BY dataset_ord, split NULLS LAST, row_key NULLS LAST) - 1 AS row_idx
  FROM ({FILTERED}) f
"""

ORACLE["corpus_union"] = f"SELECT dataset_ord, dataset, split, row_key, instruction FROM ({UNION}) u"
ORACLE["corpus_word_count"] = (
    f"SELECT dataset, split, row_key, {words('instruction')} AS word_count FROM ({UNION}) u")
ORACLE["corpus_filter"] = f"SELECT dataset, split, row_key, instruction FROM ({FILTERED}) f"
ORACLE["row_index"] = f"SELECT row_idx, dataset, split, row_key, instruction FROM ({CORPUS}) c"
ORACLE["prompt_teacher"] = f"""
  SELECT dataset, split, row_idx, instruction,
         'System: ' || {TEACHER} || chr(10) || 'User: ' || instruction || chr(10) || 'Assistant:' AS prompt
  FROM ({CORPUS}) c"""
ORACLE["prompt_assistant"] = f"""
  SELECT row_idx, 'User: ' || instruction || chr(10) || 'Assistant:' AS prompt FROM ({CORPUS}) c"""
ORACLE["prompt_student"] = f"""
  SELECT row_idx,
         'System: ' || {ASSISTANT} || chr(10) || 'User: ' || instruction || chr(10) || 'Assistant:' AS prompt
  FROM ({CORPUS}) c"""

PAIRS = """
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx,
         conv_id, turn, text AS instruction, nxt AS output
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr
        FROM conversations) t
  WHERE role = 'user' AND nr = 'assistant'
"""


def teacher_prompt(c: str) -> str:
    return f"'System: ' || {TEACHER} || chr(10) || 'User: ' || {c} || chr(10) || 'Assistant:'"


def training_text(i: str, o: str) -> str:
    return (f"'System: ' || {ASSISTANT} || chr(10) || 'User: ' || {i} || chr(10) || "
            f"'Assistant: ' || {o}")


ORACLE["sft_text"] = f"SELECT row_idx, {training_text('instruction', 'output')} AS text FROM ({PAIRS}) p"
ORACLE["chat_messages"] = f"""
  SELECT row_idx, CAST(2 AS BIGINT) AS n_messages, 'system,user' AS roles,
         {TEACHER} AS system_content, instruction AS user_content FROM ({CORPUS}) c"""
ORACLE["chat_render"] = """
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id"""
ORACLE["chat_turn_lines"] = """
  SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS line FROM conversations"""
ORACLE["rules_quarantine"] = """
  SELECT doc_id, errs = '' AS is_valid, errs AS errors FROM (
    SELECT d.doc_id, concat_ws(';',
      CASE WHEN d.text IS NULL OR length(d.text) < 20 THEN 'text:min_length:20' END,
      CASE WHEN d.text IS NULL OR length(d.text) > 1024 THEN 'text:max_length:1024' END,
      CASE WHEN d.lang IS NULL OR d.lang NOT IN ('en', 'de', 'fr') THEN 'lang:enum' END,
      CASE WHEN l.quality IS NULL THEN 'quality:required' END,
      CASE WHEN l.toxic IS NOT NULL AND l.toxic <> 0 THEN 'toxic:enum' END) AS errs
    FROM documents d LEFT JOIN labels l USING (doc_id)) t"""
ORACLE["system_prompt_check"] = """
  SELECT conv_id, turn, errs = '' AS is_valid, errs AS errors FROM (
    SELECT conv_id, turn, concat_ws(';',
      CASE WHEN text IS NULL OR length(text) < 20 THEN 'text:min_length:20' END,
      CASE WHEN text IS NULL OR length(text) > 1024 THEN 'text:max_length:1024' END) AS errs
    FROM conversations WHERE role = 'system') t"""

WORLD = 4
SHARDED = f"""
  SELECT c.*, CAST(floor(row_idx / ch) AS BIGINT) AS shard_id,
         CAST(row_idx - floor(row_idx / ch) * ch AS BIGINT) AS shard_pos
  FROM ({CORPUS}) c, (SELECT greatest(CAST(ceil(count(*) / {WORLD}) AS BIGINT), 1) AS ch FROM ({CORPUS}) x) k
"""
BATCHED = f"SELECT *, CAST(floor(shard_pos / {O.SFT_BATCH_SIZE}) AS BIGINT) AS batch_id FROM ({SHARDED}) s"
ORACLE["shard_assign"] = f"SELECT row_idx, shard_id, shard_pos FROM ({SHARDED}) s"
ORACLE["batch_assign"] = f"SELECT row_idx, shard_id, batch_id FROM ({BATCHED}) b"
ORACLE["shard_stats"] = f"""
  SELECT shard_id, batch_id, CAST(count(*) AS BIGINT) AS n_rows FROM ({BATCHED}) b GROUP BY 1, 2"""
ORACLE["resume_offset"] = f"""
  SELECT row_idx, dataset, instruction FROM ({CORPUS}) c
  WHERE row_idx >= (SELECT count(*) FROM ({CORPUS}) d WHERE dataset_ord < 2)"""
ORACLE["resume_ranges"] = f"""
  SELECT row_idx, dataset, instruction FROM ({CORPUS}) c
  WHERE dataset_ord <> 1 AND split IS DISTINCT FROM 'de'"""
ORACLE["resume_anti"] = f"""
  SELECT row_idx, dataset, instruction FROM ({CORPUS}) c
  WHERE NOT EXISTS (SELECT 1 FROM ({PAIRS}) p WHERE p.instruction = c.instruction)"""
ORACLE["gen_md5"] = f"""
  SELECT row_idx, instruction, md5({teacher_prompt('instruction')}) AS output, 'ok' AS status
  FROM ({CORPUS}) c"""
ORACLE["gen_error_rows"] = f"""
  SELECT row_idx, instruction,
         CASE WHEN contains(instruction, 'ü') THEN '{O.GENERATION_ERROR_MARK}rejected'
              ELSE md5({teacher_prompt('instruction')}) END AS output,
         CASE WHEN contains(instruction, 'ü') THEN 'error' ELSE 'ok' END AS status
  FROM ({CORPUS}) c"""
ORACLE["shard_merge"] = f"""
  SELECT row_idx, shard_id, instruction, md5({teacher_prompt('instruction')}) AS output
  FROM ({SHARDED}) s"""
ORACLE["gen_replay"] = f"""
  SELECT c.row_idx, c.instruction, a.output,
         CASE WHEN a.output IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM ({CORPUS}) c LEFT JOIN (
    SELECT instruction, arg_min(output, row_idx) AS output FROM ({PAIRS}) p GROUP BY instruction
  ) a ON a.instruction = c.instruction"""
ORACLE["batch_requests"] = f"""
  SELECT '{O.REQUEST_ID_PREFIX}' || CAST(row_idx AS VARCHAR) AS custom_id, '{O.BATCH_METHOD}' AS method,
         '{O.BATCH_URL}' AS url, '{O.BATCH_MODEL}' AS model, CAST(2 AS BIGINT) AS n_messages,
         'developer' AS system_role, {_q(O.BATCH_DEVELOPER_PROMPT)} AS system_content,
         instruction AS user_content, CAST({O.BATCH_TEMPERATURE} AS DOUBLE) AS temperature,
         CAST({O.BATCH_TOP_P} AS DOUBLE) AS top_p, true AS same_text
  FROM ({CORPUS}) c"""

RESPONSE_LINES = f"""
  SELECT row_idx AS line_no, CASE
    WHEN row_idx % 13 = 6 THEN '{{"custom_id": "request-' || row_idx
    WHEN row_idx % 7 = 3 THEN '{{"custom_id":"request-' || row_idx
      || '","response":null,"error":{{"code":"rate_limit"}}}}'
    WHEN row_idx % 11 = 5 THEN '{{"custom_id":"request-' || row_idx
      || '","response":{{"body":{{"choices":[]}}}},"error":{{}}}}'
    WHEN row_idx % 17 = 8 THEN '{{"custom_id":"missing-' || row_idx
      || '","response":{{"body":{{"choices":[{{"message":{{"content":"x"}}}}]}}}},"error":null}}'
    ELSE '{{"custom_id":"request-' || row_idx
      || '","response":{{"body":{{"choices":[{{"message":{{"content":"' || md5(output)
      || '"}}}}]}}}},"error":null}}' END AS value
  FROM ({PAIRS}) p
"""
BATCH_RESULTS = f"""
  WITH parsed AS (
    SELECT coalesce(json_extract_string(value, '$.custom_id'), '') AS custom_id,
           CAST(json_extract(value, '$.error') AS VARCHAR) AS err,
           coalesce(json_array_length(json_extract(value, '$.response.body.choices')), 0) AS n_choices,
           json_extract_string(value, '$.response.body.choices[0].message.content') AS content
    FROM ({RESPONSE_LINES}) l
    WHERE json_valid(value) AND json_type(CAST(value AS JSON)) = 'OBJECT'
  ), laddered AS (
    SELECT custom_id,
           CASE WHEN err IS NOT NULL AND err <> 'null' AND err NOT IN ('{{}}', '[]', '""', '0', '0.0', 'false')
                THEN 'error' WHEN n_choices > 0 THEN 'ok' ELSE 'no_content' END AS status0,
           err, content
    FROM parsed
  )
  SELECT l.custom_id,
         CASE WHEN r.row_idx IS NULL THEN '[Batch custom_id=' || l.custom_id || ']' ELSE r.instruction END
           AS instruction,
         CASE WHEN status0 = 'error' THEN '{O.ERROR_MARK}' || err
              WHEN status0 = 'ok' THEN content ELSE '{O.NO_CONTENT_MARK}' END AS output,
         CASE WHEN r.row_idx IS NULL THEN 'unknown_id' ELSE status0 END AS status
  FROM laddered l LEFT JOIN ({PAIRS}) r ON '{O.REQUEST_ID_PREFIX}' || CAST(r.row_idx AS VARCHAR) = l.custom_id
"""
ORACLE["batch_responses"] = f"SELECT custom_id, instruction, output, status FROM ({BATCH_RESULTS}) b"
ORACLE["batch_status"] = f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM ({BATCH_RESULTS}) b GROUP BY status"


def split_rank(idx: str, seed: int) -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || CAST({idx} AS VARCHAR)), {idx})"


SPLIT = f"""
  SELECT row_idx, {training_text('instruction', 'output')} AS text,
         {split_rank('row_idx', O.SFT_SPLIT_SEED)} AS rk,
         CAST(ceil(count(*) OVER () * {O.TEST_SIZE}) AS BIGINT) AS k
  FROM ({PAIRS}) p
"""
ORACLE["split_test"] = f"SELECT row_idx, text FROM ({SPLIT}) s WHERE rk <= k"
ORACLE["split_train"] = f"SELECT row_idx, text FROM ({SPLIT}) s WHERE rk > k"
ORACLE["split_plain_teacher"] = f"""
  SELECT CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS side, instruction, output FROM (
    SELECT instruction, output, {split_rank('i', O.SFT_SPLIT_SEED)} AS rk, CAST(ceil(count(*) OVER () * {O.TEST_SIZE}) AS BIGINT) AS k
    FROM (SELECT instruction, output, row_number() OVER (ORDER BY instruction, output) - 1 AS i FROM ({PAIRS}) p) n) s"""
ORACLE["teacher_load"] = f"""
  SELECT row_idx, instruction, md5({teacher_prompt('instruction')}) AS output
  FROM ({CORPUS}) c WHERE NOT contains(instruction, 'ü')"""

VOCAB_SIZE = 4096
SFT_TEXTS = f"SELECT row_idx, {training_text('instruction', 'output')} AS text FROM ({PAIRS}) p"
VOCAB = f"""
  SELECT token, CAST(token_id AS INTEGER) AS token_id, n FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id, n FROM (
      SELECT token, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT unnest(regexp_extract_all(text, '{WORD_PATTERN_RE2}')) AS token FROM ({SFT_TEXTS}) t) w
      WHERE token NOT IN ('{O.PAD_TOKEN}', '{O.UNK_TOKEN}')
      GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB_SIZE}) c) r
  UNION ALL SELECT '{O.PAD_TOKEN}', CAST(0 AS INTEGER), CAST(NULL AS BIGINT)
  UNION ALL SELECT '{O.UNK_TOKEN}', CAST(1 AS INTEGER), CAST(NULL AS BIGINT)
"""
ORACLE["vocab"] = VOCAB


def encoded(src: str, key: str, max_len: int | None, out: str = "ids") -> str:
    """Per ``key``: ``n_tokens`` and comma-joined ids of ``text``."""
    cut = f"[1:{max_len}]" if max_len else ""
    return f"""
  SELECT s.{key}, CAST(coalesce(e.n, 0) AS BIGINT) AS n_tokens, coalesce(e.{out}, '') AS {out},
         coalesce(e.id_list, []) AS id_list
  FROM ({src}) s LEFT JOIN (
    SELECT {key}, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS {out},
           list(id ORDER BY pos) AS id_list
    FROM (
      SELECT x.{key}, x.pos, coalesce(v.token_id, 1) AS id FROM (
        SELECT {key}, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
          SELECT {key}, regexp_extract_all(text, '{WORD_PATTERN_RE2}'){cut} AS w FROM ({src}) q) z) x
      LEFT JOIN ({VOCAB}) v ON v.token = x.token) y
    GROUP BY {key}) e ON e.{key} = s.{key}"""


ENCODED = encoded(SFT_TEXTS, "row_idx", O.SFT_MAX_LENGTH)
ORACLE["encode"] = f"SELECT row_idx, n_tokens, ids FROM ({ENCODED}) e"
DOCS = "SELECT doc_id, text FROM documents"
ORACLE["truncate"] = f"""
  SELECT e.doc_id, e.n_tokens, {words('d.text')} AS n_words, e.ids
  FROM ({encoded(DOCS, 'doc_id', O.KD_MAX_LENGTH)}) e JOIN documents d USING (doc_id)"""
PADDED = f"""
  SELECT row_idx, batch_id, L, n_tokens,
         list_concat(list_transform(range(L - n_tokens), lambda x: 0), id_list) AS pids,
         list_concat(list_transform(range(L - n_tokens), lambda x: 0), list_transform(range(n_tokens), lambda x: 1)) AS mask
  FROM (SELECT *, CAST(floor(row_idx / {O.KD_BATCH_SIZE}) AS BIGINT) AS batch_id,
               max(n_tokens) OVER (PARTITION BY CAST(floor(row_idx / {O.KD_BATCH_SIZE}) AS BIGINT)) AS L
        FROM ({ENCODED}) e) t
"""
ORACLE["pad_left"] = f"""
  SELECT row_idx, batch_id, CAST(L AS BIGINT) AS length, array_to_string(pids, ',') AS ids,
         array_to_string(mask, ',') AS mask FROM ({PADDED}) p"""
ORACLE["labels_causal"] = f"""
  SELECT row_idx, array_to_string(list_transform(pids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels
  FROM ({PADDED}) p"""
ORACLE["decode"] = f"""
  SELECT e.row_idx, coalesce(d.decoded, '') AS decoded FROM ({ENCODED}) e LEFT JOIN (
    SELECT row_idx, string_agg(v.token, ' ' ORDER BY pos) AS decoded FROM (
      SELECT row_idx, unnest(id_list) AS id, generate_subscripts(id_list, 1) AS pos FROM ({ENCODED}) x) u
    JOIN ({VOCAB}) v ON v.token_id = u.id WHERE u.id <> 0 GROUP BY row_idx) d USING (row_idx)"""
PROMPTS_TEXTS = f"""
  SELECT row_idx, {training_text('instruction', 'output')} AS text,
         'System: ' || {ASSISTANT} || chr(10) || 'User: ' || instruction || chr(10) || 'Assistant:' AS prompt
  FROM ({PAIRS}) p"""
ORACLE["drop_prompt_ids"] = f"""
  SELECT f.row_idx, p.n_tokens AS n_prompt, CAST(f.n_tokens - p.n_tokens AS BIGINT) AS n_answer,
         array_to_string(f.id_list[p.n_tokens + 1:], ',') AS ids
  FROM ({encoded(PROMPTS_TEXTS, 'row_idx', None)}) f
  JOIN ({encoded(f"SELECT row_idx, prompt AS text FROM ({PROMPTS_TEXTS}) z", 'row_idx', None)}) p USING (row_idx)"""
ORACLE["drop_special_ids"] = f"""
  SELECT row_idx, array_to_string(list_filter(pids, lambda x: x <> 0), ',') AS ids FROM ({PADDED}) p"""
LENGTHS = f"SELECT {words('text')} AS f, least({words('text')}, {O.KD_MAX_LENGTH}) AS k FROM documents WHERE text IS NOT NULL"
RANKED_LENGTHS = f"SELECT k, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM ({LENGTHS}) t"
ORACLE["token_profile"] = f"""
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(k) AS BIGINT) AS min_len, CAST(max(k) AS BIGINT) AS max_len,
         round(avg(k), 6) AS mean_len, round(avg(CASE WHEN f > {O.KD_MAX_LENGTH} THEN 1.0 ELSE 0.0 END), 6)
           AS share_truncated,
         {", ".join(f"(SELECT CAST(min(k) AS BIGINT) FROM ({RANKED_LENGTHS}) q WHERE 100 * r >= {p} * n) AS p{p}" for p in (50, 90, 99))}
  FROM ({LENGTHS}) t"""

T = O.KD_TEMPERATURE
LOGITS = """
  SELECT CAST(floor(a.vec_id / 4) AS BIGINT) AS sample_id, CAST(a.vec_id % 4 AS BIGINT) AS pos,
         a.embedding AS s, b.embedding AS a,
         CASE WHEN a.vec_id % 10 = 0 THEN -100 ELSE a.label END AS label
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
"""
LONG = f"""
  SELECT sample_id, pos, label, CAST(unnest(s) AS DOUBLE) / {T} AS s, CAST(unnest(a) AS DOUBLE) / {T} AS a,
         generate_subscripts(s, 1) - 1 AS tok
  FROM ({LOGITS}) l
"""
LSE = f"""
  SELECT sample_id, pos, ms + ln(zs) AS lse_s, ma + ln(za) AS lse_a FROM (
    SELECT sample_id, pos, ms, ma, sum(exp(s - ms)) AS zs, sum(exp(a - ma)) AS za FROM (
      SELECT *, max(s) OVER w AS ms, max(a) OVER w AS ma FROM ({LONG}) x
      WINDOW w AS (PARTITION BY sample_id, pos)) y
    GROUP BY sample_id, pos, ms, ma) z
"""
PROBS = f"""
  SELECT x.sample_id, x.pos, x.tok, x.label, x.s - l.lse_s AS lps, x.a - l.lse_a AS lpa
  FROM ({LONG}) x JOIN ({LSE}) l USING (sample_id, pos)
"""
ORACLE["kd_softmax"] = f"""
  SELECT sample_id, pos, round(max(exp(lpa)), 6) AS p_max,
         CAST(arg_max(tok, exp(lpa)) AS BIGINT) AS p_argmax,
         round(sum(exp(lpa) * (tok + 1)), 6) AS p_check, round(sum(exp(lpa)), 6) AS p_sum
  FROM ({PROBS}) p GROUP BY sample_id, pos"""
ORACLE["kd_log_softmax"] = f"""
  SELECT sample_id, pos, round(max(lps), 6) AS lp_max, round(sum(lps), 6) AS lp_sum
  FROM ({PROBS}) p GROUP BY sample_id, pos"""
TERMS = f"SELECT *, CASE WHEN exp(lpa) = 0 THEN 0.0 ELSE exp(lpa) * (lpa - lps) END AS term FROM ({PROBS}) p"
ORACLE["kd_pointwise"] = f"""
  SELECT sample_id, pos, round(sum(term), 6) AS kl, round(max(term), 6) AS kl_max_term
  FROM ({TERMS}) t GROUP BY sample_id, pos"""
ORACLE["kd_reduce"] = f"""
  SELECT round(sum(term) / count(DISTINCT sample_id) * {T * T}, 6) AS batchmean,
         round(sum(term) * {T * T}, 6) AS sum, round(sum(term) / count(*) * {T * T}, 6) AS mean
  FROM ({TERMS}) t"""
ORACLE["kd_mismatch"] = f"""
  SELECT sample_id, pos, CAST(len(s) AS BIGINT) AS n_student, CAST(len(a) - 1 AS BIGINT) AS n_assistant
  FROM ({LOGITS}) l WHERE label = {O.IGNORE_INDEX}"""
ORACLE["kd_mismatch_reduce"] = f"""
  SELECT round(sum(term) / count(DISTINCT sample_id) * {T * T}, 6) AS batchmean, round(sum(term) * {T * T}, 6) AS sum,
         round(sum(term) / count(*) * {T * T}, 6) AS mean
  FROM ({TERMS}) t WHERE label <> {O.IGNORE_INDEX}"""
CE = f"""
  SELECT l.sample_id, l.pos, l.target, -(l.s_raw[l.target + 1] - l.lse) AS ce FROM (
    SELECT sample_id, pos, lead(label) OVER (PARTITION BY sample_id ORDER BY pos) AS target,
           list_transform(s, lambda v: CAST(v AS DOUBLE)) AS s_raw,
           list_max(list_transform(s, lambda v: CAST(v AS DOUBLE)))
             + ln(list_sum(list_transform(s, lambda v: exp(CAST(v AS DOUBLE)
                  - list_max(list_transform(s, lambda u: CAST(u AS DOUBLE))))))) AS lse
    FROM ({LOGITS}) g) l
  WHERE l.target IS NOT NULL AND l.target <> -100
"""
ORACLE["ce_loss"] = f"SELECT round(avg(ce), 6) AS ce, CAST(count(ce) AS BIGINT) AS n_valid FROM ({CE}) c"
ORACLE["combined_loss"] = f"""
  SELECT round(c.ce, 6) AS ce, round(k.kd, 6) AS kd, round({1 - O.KD_WEIGHT} * c.ce + {O.KD_WEIGHT} * k.kd, 6) AS loss
  FROM (SELECT avg(ce) AS ce FROM ({CE}) x) c,
       (SELECT sum(term) / count(DISTINCT sample_id) * {T * T} AS kd FROM ({TERMS}) t) k"""
ORACLE["kd_long"] = f"""
  SELECT round(sum(term) / count(DISTINCT sample_id) * {T * T}, 6) AS batchmean FROM ({TERMS}) t"""

CANDS = """
  SELECT vec_id AS ctx, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS tok,
         CAST(unnest(embedding) AS DOUBLE) AS lg FROM embeddings
"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY lg DESC, tok) AS rk FROM ({CANDS}) c"
TOPK = f"SELECT * FROM ({RANKED}) r WHERE rk <= 20"


def nucleus(src: str) -> str:
    """Candidates ``src`` cut to mass 0.6, with renormalised ``p``."""
    return f"""
  SELECT *, p0 / sum(p0) OVER (PARTITION BY ctx) AS p FROM (SELECT * FROM (
    SELECT *, sum(p0) OVER (PARTITION BY ctx ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM (SELECT *, e / sum(e) OVER (PARTITION BY ctx) AS p0 FROM (
      SELECT *, exp(lg / {T} - max(lg / {T}) OVER (PARTITION BY ctx)) AS e FROM ({src}) k) a) b) c
  WHERE cum - p0 < 0.6) n"""


KEPT = nucleus(TOPK)
ORACLE["sample_top_k"] = f"SELECT ctx, tok, CAST(rk AS BIGINT) AS rank FROM ({TOPK}) k"
ORACLE["sample_top_p"] = f"SELECT ctx, tok, round(p, 6) AS p FROM ({KEPT}) k"
ORACLE["sample_nucleus"] = f"SELECT ctx, tok, round(p, 6) AS p FROM ({nucleus(RANKED)}) k"
ORACLE["sample_greedy"] = f"SELECT ctx, tok FROM ({RANKED}) r WHERE rk = 1"
ORACLE["sample_seeded"] = f"""
  WITH c AS (
    SELECT ctx, tok, rk,
           sum(p) OVER (PARTITION BY ctx ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
           CAST(('0x' || substr(md5('7:' || CAST(ctx AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u
    FROM ({KEPT}) k)
  SELECT ctx, coalesce(arg_min(tok, rk) FILTER (WHERE cum >= u), arg_max(tok, rk)) AS tok
  FROM c GROUP BY ctx"""

ORACLE["jsonl_roundtrip"] = f"SELECT split, dataset, row_key, instruction FROM ({UNION}) u"
ORACLE["registry_run"] = f"SELECT row_idx, dataset, split, instruction FROM ({CORPUS}) c"
ORACLE["manifest"] = f"""
  SELECT 'teacher' AS name, 'teacher_outputs' AS source, CAST(count(*) AS BIGINT) AS n_rows,
         CAST(3 AS BIGINT) AS n_cols, 'source=teacher_outputs;version=v1' AS tags,
         CAST(coalesce(sum(CAST(('0x' || substr(md5(concat_ws(chr(31),
           coalesce(CAST(row_idx AS VARCHAR), chr(0)), coalesce(instruction, chr(0)),
           coalesce(output, chr(0)))), 1, 15)) AS BIGINT)), 0) % 4611686018427387904 AS BIGINT) AS digest
  FROM ({PAIRS}) p"""
ORACLE["manifest_merge"] = ORACLE["manifest"]
ORACLE["jsonl_null_split"] = """
  SELECT CASE lang WHEN 'fr' THEN 'null' WHEN 'es' THEN '' WHEN 'de' THEN NULL ELSE lang END AS split, doc_id, text
  FROM documents"""
ORACLE["gen_stream"] = f"""
  SELECT conv_id, turn, text AS instruction, md5({teacher_prompt('text')}) AS output, 'ok' AS status
  FROM conversations WHERE role = 'user'"""

ORACLE["sft_features"] = f"""
  SELECT s.text, e.ids, array_to_string(list_transform(e.id_list, lambda x: 1), ',') AS mask
  FROM ({ENCODED}) e JOIN ({SFT_TEXTS}) s USING (row_idx)"""
ORACLE["kd_features"] = f"""
  SELECT ids, array_to_string(list_transform(id_list, lambda x: 1), ',') AS mask
  FROM ({encoded(SFT_TEXTS, 'row_idx', O.KD_MAX_LENGTH)}) e"""

ORACLE["snapshot_roundtrip"] = "SELECT doc_id, lang, text AS instruction, 'train' AS split FROM documents"
ORACLE["prompts_once"] = f"SELECT row_idx, instruction FROM ({CORPUS}) c"
ORACLE["gen_dispatch"] = f"""
  SELECT 'inline' AS mode, row_idx, output, status FROM ({ORACLE['gen_md5']}) a
  UNION ALL
  SELECT 'replay' AS mode, row_idx, output, status FROM ({ORACLE['gen_replay']}) b
  UNION ALL
  SELECT 'batch' AS mode, CASE WHEN status <> 'unknown_id'
    THEN CAST(substr(custom_id, {len(O.REQUEST_ID_PREFIX) + 1}) AS BIGINT) END AS row_idx, output, status
  FROM ({ORACLE['batch_responses']}) c"""
ORACLE["batch_append"] = ORACLE["batch_responses"]
ORACLE["encode_join"] = ORACLE["encode"]
ORACLE["decode_join"] = ORACLE["decode"]
ORACLE["kd_reduce_jvm"] = ORACLE["kd_reduce"]
