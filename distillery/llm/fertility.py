"""Quality rules by tokeniser fertility (operator 4).

Each whole text is measured with a public vocabulary: characters per token,
the share of byte-fallback tokens, and the entropy of its tokens. Clean
prose of one language or script, and of about one length, stays in a narrow
band of each; a text is rejected when it falls outside the bands of its
group: language or script, and octave of its characters without white space,
which no token count moves. Octaves with few texts are taken together; a
language with few is judged by its script, and a script with few by the whole
corpus, so that every text has bands. The bands come
from the quartiles of all documents of the group, so they follow the corpus
and a quarter of bad texts does not move them: from ``q25 - reach * (q75 -
q25)`` to ``q75 + reach * (q75 - q25)``, the spread being at least ``floor``
of the median. On the harmless side (more characters per token, more
entropy) the reach is ``far_reach``.

The plain counts (words, symbols, repeated lines and words) come from the
same pass over the UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.shared import col, cut, free_name

# Fixed values of the contract
SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SHORT_REACH = 2.0

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
_FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
           "n_repeat_words": "bigint", "n_tokens": "bigint", "chars_per_token": "double", "byte_share": "double",
           "token_entropy": "double", "script": "string"}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
# scripts told apart by the lead byte of a code point
_SCRIPT_NAMES = np.array(["none", "latin", "greek_cyrillic", "middle_east", "indic_other", "east_asian", "astral"])
_SCRIPT = np.zeros(256, dtype=np.int64)
_SCRIPT[[*range(65, 91), *range(97, 123)]] = 1
_SCRIPT[0xC3:0xC9] = 1
_SCRIPT[0xCD:0xD4] = 2
_SCRIPT[0xD6:0xDE] = 3
_SCRIPT[0xE0:0xE3] = 4
_SCRIPT[0xE3:0xF0] = 5
_SCRIPT[0xF0:0xF5] = 6


@dataclass(frozen=True)
class FertilityRules:
    """``vocabulary``: a sentencepiece model with byte fallback. Bands come
    from groups of at least ``min_group`` texts; only a corpus that has fewer
    in all makes a smaller one, with wider bands. Texts of under
    ``min_tokens`` tokens have bands that reach ``SHORT_REACH`` as far."""

    vocabulary: str
    reach: float = 4.0
    far_reach: float = 12.0
    floor: float = 0.02
    min_tokens: int = 50
    min_group: int = 50


def _measure(arr: pa.Array, path: str) -> pa.Array:
    out: dict[str, list] = {k: [] for k in _FIELDS}
    cache, is_byte = vocab.held(("fertility", path), lambda: _word_cache(path))
    for _, part in ta.slices(arr):
        for k, v in _slice(*ta.raw(part), cache, is_byte).items():
            out[k].append(v)
    kinds = {"bigint": np.int64, "double": np.float64, "string": object}
    cols = [pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, kinds[t]), _arrow[t]) for k, t in _FIELDS.items()]
    return pa.StructArray.from_arrays(cols, list(_FIELDS))


def _word_cache(path: str) -> tuple[vocab.WordCache, np.ndarray]:
    model = vocab.pieces(path)
    return (vocab.WordCache(lambda w: model.encode(w, num_threads=1), 150_000),
            np.array([model.is_byte(i) for i in range(model.vocab_size())]))


_arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _slice(data: np.ndarray, off: np.ndarray, cache: vocab.WordCache, is_byte: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    starts, ends, at = ta.word_spans(data, off)
    words = np.diff(at)
    owner = np.repeat(np.arange(n), words)
    doc = np.repeat(np.arange(n), np.diff(off))
    inside = ~ta.WHITESPACE[data]
    chars = np.bincount(doc, weights=ta.LEAD[data] & inside, minlength=n).astype(np.int64)
    h = ta.span_hashes(data, starts, ends)
    slots = cache.lookup(h, data, starts, ends)
    ids, lens = cache.gather(slots)
    tok_owner = np.repeat(owner, lens)
    n_tokens = np.bincount(tok_owner, minlength=n)
    n_bytes = np.bincount(tok_owner, weights=is_byte[ids], minlength=n)
    key = np.sort(tok_owner * len(is_byte) + ids)
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(cuts, len(key))).astype(np.float64)
    log_sum = np.bincount(key[cuts] // len(is_byte), weights=counts * np.log2(counts), minlength=n) if len(key) else np.zeros(n)
    t = np.maximum(n_tokens, 2)
    entropy = np.log2(t) - log_sum / t  # of the text's own token counts
    script = np.bincount(doc * len(_SCRIPT_NAMES) + _SCRIPT[data], minlength=n * len(_SCRIPT_NAMES)).reshape(n, -1)
    script[:, 0] = 0
    return {"n_words": words, "word_chars": chars,
            "n_symbols": np.bincount(doc, weights=_SYMBOL[data], minlength=n).astype(np.int64),
            "n_dup_lines": _dup_lines(data, off, starts), "n_repeat_words": _repeat_words(h, at),
            "n_tokens": n_tokens, "chars_per_token": chars / np.maximum(n_tokens, 1),
            "byte_share": n_bytes / np.maximum(n_tokens, 1),
            "token_entropy": np.where(n_tokens > 1, entropy / np.log2(t), 0.0),
            "script": _SCRIPT_NAMES[np.where(script.any(axis=1), script.argmax(axis=1), 0)].astype(object)}


def _dup_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines between newlines that hold a word and equal an earlier line."""
    n = len(off) - 1
    newlines = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], newlines + 1]), kind="stable")
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(newlines, off)) + 1)
    # a line ends at its newline or at the end of its text
    end = np.sort(np.concatenate([newlines, off[1:]]), kind="stable")
    keep = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end, doc = begin[keep], end[keep], doc[keep]
    h = ta.span_hashes(data, begin, end)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n)


def _repeat_words(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words inside runs of five words that occur at least twice in the text."""
    n = np.diff(at)
    out = np.zeros(len(n), dtype=np.int64)
    long = np.flatnonzero(n >= WINDOW_WORDS)
    if not len(long):
        return out
    win, win_at = ta.windows(h, at, WINDOW_WORDS)
    for i in long:
        w = win[win_at[i]: win_at[i + 1]]
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(w) + WINDOW_WORDS, dtype=np.int64)
            hit = np.zeros(len(w), dtype=bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            pos = np.flatnonzero(hit)
            twice[pos] += 1
            twice[pos + WINDOW_WORDS] -= 1
            out[i] = (np.cumsum(twice) > 0).sum()
    return out


def measures(text: str, rules: FertilityRules) -> Column:
    """A struct of all counts and measures of a text column."""
    path = rules.vocabulary
    kind = "struct<" + ",".join(f"{k}:{v}" for k, v in _FIELDS.items()) + ">"
    return arrow_udf(lambda a: _measure(a, path), kind)(col(text))


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _runs(octaves: dict[int, int], least: int) -> dict[int, int]:
    """The run of each octave, by its first one: octaves with fewer than
    ``least`` texts join the next, the last ones the run before."""
    starts, n, open_ = [], 0, None
    for o in sorted(octaves):
        open_ = o if open_ is None else open_
        n += octaves[o]
        if n >= least:
            starts.append(open_)
            n, open_ = 0, None
    if open_ is not None and not starts:
        starts.append(open_)
    return {o: max(x for x in starts if x <= o) for o in octaves}


def _groups(cells: dict[tuple[str, str, int], int], least: int) -> tuple[dict[tuple, tuple], set[tuple]]:
    """The group of each cell (name, script, octave) of the corpus, and all
    ``(cell, group)`` where the cell is evidence for the group. A group is
    (level, name of the level, first octave)."""
    of: dict[tuple, tuple] = {}
    proof: set[tuple] = set()
    for level in range(3):
        by: dict[str, dict[int, int]] = {}
        member = {c: (c[0], c[1], "")[level] for c in cells}
        for c, n in cells.items():
            octaves = by.setdefault(member[c], {})
            octaves[c[2]] = octaves.get(c[2], 0) + n
        dense = {k: _runs(o, least) for k, o in by.items() if level == 2 or sum(o.values()) >= least}
        group = {c: (level, member[c], dense[member[c]][c[2]]) for c in cells if member[c] in dense}
        of = {**group, **of}
        proof |= {(c, g) for c, g in group.items()}
        if len(of) == len(cells):
            break
    used = set(of.values())
    return of, {(c, g) for c, g in proof if g in used}


def bands(measured: DataFrame, rules: FertilityRules) -> dict[str, dict[str, tuple[float, float]]]:
    """Bands by cell from ``measured(grp, n_words, n_repeat_words, ...)``:
    approximate quartiles over all texts of the cell's group that pass the
    base rules; short texts find theirs under the cell's name and ``SHORT``.
    One row per cell reaches the driver; cells are languages and scripts by
    octave."""
    judged = measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    cells = {_cell(r["grp"]): r["n"] for r in judged.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not cells:
        return {}
    of, proof = _groups(cells, rules.min_group)
    number = {g: i for i, g in enumerate(sorted(set(of.values())))}
    side = measured.sparkSession.createDataFrame([(_name(c), number[g]) for c, g in sorted(proof)], "grp string, no int")
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    rows = (judged.join(F.broadcast(side), "grp").groupBy("no")
            .agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, q, 10_000).alias(m) for m in MEASURES]).collect())
    found: dict[int, list[dict]] = {}
    for r in rows:
        wide = max(1.0, (rules.min_group / r["n"]) ** 0.5)
        found[r["no"]] = [{}, {}]
        for m in MEASURES:
            low, mid, high = r[m]
            spread = max(high - low, rules.floor if m == "byte_share" else rules.floor * abs(mid))
            up = rules.reach if m == "byte_share" else rules.far_reach
            for by, reach in zip(found[r["no"]], (wide, wide * SHORT_REACH), strict=True):
                by[m] = (low - rules.reach * reach * spread, high + up * reach * spread)
    return {_name(c) + end: by for c, g in of.items() for end, by in zip(("", SHORT), found[number[g]], strict=True)}


def in_bands(grp: Column, m: Column, found: dict, rules: FertilityRules) -> Column:
    """True if every measure lies in the band of its group; short texts have
    wider ones. A group without bands passes: none of a corpus is."""
    if not found:
        return F.lit(True)
    ok = F.lit(True)
    at = F.when(m["n_tokens"] < rules.min_tokens, F.concat(grp, F.lit(SHORT))).otherwise(grp)
    for name in MEASURES:
        entries = [x for g, by in found.items() for x in (F.lit(g), F.array(*map(F.lit, by[name])))]
        band = F.element_at(F.create_map(*entries), at)
        ok = ok & F.coalesce(m[name].between(band[0], band[1]), F.lit(True))
    return ok


SHORT = ":short"
LANGUAGES = 1000  # a language with a smaller share of the texts is judged by its script


def _language(df: DataFrame, lang: str | None, m: Column) -> Column:
    """The language of a text, or its script where there is none."""
    return m["script"] if lang is None or lang not in df.columns else F.coalesce(col(lang).cast("string"), m["script"])


def known_languages(rows: DataFrame) -> list[str]:
    """The languages of ``rows(language)`` with at least one text of
    ``LANGUAGES``: there can be no more than that many. Others are judged by
    their script."""
    counts = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    return [r["language"] for r in counts.filter(F.col("n") * LANGUAGES >= whole).collect()]


def _group(language: Column, m: Column, known: list[str]) -> Column:
    """The cell of a text: the language, if it is a known one, else the
    script; the script; and the octave of the characters."""
    name = F.when(language.isin(known), language).otherwise(m["script"])
    return F.concat_ws(":", name, m["script"], F.floor(F.log2(F.greatest(m["word_chars"], F.lit(1)))).cast("string"))


def _cell(grp: str) -> tuple[str, str, int]:
    name, script, octave = grp.rsplit(":", 2)
    return name, script, int(octave)


def _name(cell: tuple[str, str, int]) -> str:
    return ":".join(map(str, cell))


def fertility_report(df: DataFrame, rules: FertilityRules, text: str = "text", doc_id: str = "doc_id",
                     lang: str | None = "lang") -> DataFrame:
    """One row per row of ``df``: id, counts, measures, ``base_failed`` and
    ``kept``.

    A null or blank text has no words and fails the base rules; repeated
    rows are judged alike, each for itself; an empty table gives no rows;
    columns other than id, text and language are not read. A null language
    is replaced by the script.
    """
    rows = df.withColumn(name := free_name(df, "_fertility"), measures(text, rules))
    m = F.col(name)
    rows = cut(rows.select(col(doc_id).alias("doc_id"), F.col(f"{name}.*"), _language(df, lang, m).alias("language")))
    cell = F.struct("script", "word_chars")
    rows = rows.withColumn("grp", _group(F.col("language"), cell, known_languages(rows)))
    found = bands(rows, rules)
    whole = F.struct("n_tokens", *MEASURES)
    return (rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
            .withColumn("kept", ~F.col("base_failed") & in_bands(F.col("grp"), whole, found, rules)))


def keep_fluent(df: DataFrame, rules: FertilityRules, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of ``df``, all columns, that pass. The first pass measures
    all rows for the bands, the second judges each row in place."""
    name = free_name(df, "_fertility")
    measured = df.withColumn(name, measures(text, rules))
    m = F.col(name)
    rows = cut(measured.select(_language(measured, lang, m).alias("language"), *[f"{name}.{x}" for x in (
        "script", "word_chars", "n_words", "n_repeat_words", "n_tokens", *MEASURES)]))
    known = known_languages(rows)
    found = bands(rows.withColumn("grp", _group(F.col("language"), F.struct("script", "word_chars"), known)), rules)
    good = (~base_failed(m["n_words"], m["n_repeat_words"])
            & in_bands(_group(_language(measured, lang, m), m, known), m, found, rules))
    return measured.filter(good).drop(name)
