"""Mixture-controlled packing (operator 9).

Documents are tokenised once and dealt by hash into buckets of about
``bucket_tokens`` tokens, so that each bucket holds a share of every
source. Inside a bucket the sources are queues, served by deficit round
robin: every window adds each source's target share to its credit, and the
queue with the most credit is served next, until the window is full.
A served piece ends at the window's end, at its document's end, or once
its source's credit is spent (but not below ``min_piece`` tokens); credit
may go negative and is carried on.

Windows run on across buckets. A bucket's first position and the credits
carried into it follow from prefix sums of token counts by (bucket, source),
because a bucket serves all of its documents; so buckets are packed in
parallel and no sequence but the last one is padded. What a source got too
little (or too much) of in all earlier buckets is its deficit: it is paid back
evenly over the bucket's windows, not at once. A window keeps to the targets,
to within a piece, as long as every source of its bucket has tokens left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.shared import col, cut

SEQUENCE = 2048
END_ID = 1
BUCKET_TOKENS = 1 << 20
MIN_PIECE = 512
_GROUP = 4096  # buckets whose prefix sum one window takes


def _encode_column(text: str, path: str):
    """``struct<n, ids>``: token count and compressed little-endian ids."""
    def f(arr: pa.Array) -> pa.Array:
        cache = vocab.held(("packing", path), lambda: vocab.WordCache(vocab.lowercase_bpe(path)))
        n, blobs = [], []
        for _, part in ta.slices(arr):
            for ids in document_ids(part, cache, path):
                n.append(len(ids))
                blobs.append(_shrink(ids))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["n", "ids"])
    return arrow_udf(f, "struct<n:bigint,ids:binary>")(col(text))


def document_ids(part: pa.Array, cache: vocab.WordCache, path: str) -> list[np.ndarray]:
    """Ids of each text, the end id included."""
    data, off = ta.raw(part)
    starts, ends, at = vocab.piece_spans(data, off)
    slots = cache.lookup(ta.span_hashes(ta.LOWER[data], starts, ends), data, starts, ends)
    ids, lens = cache.gather(slots)
    cum = np.concatenate([[0], np.cumsum(lens)])[at]
    # a special token's string may be cut by pieces: such texts go in whole
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) else np.zeros(0, int)
    whole = set((np.searchsorted(off, special, side="right") - 1).tolist())
    out = []
    for i in range(len(part)):
        own = ids[cum[i]: cum[i + 1]]
        if i in whole:
            own = vocab.tokenizer(path).encode(part[i].as_py(), add_special_tokens=False).ids
        out.append(np.append(np.asarray(own, dtype=np.uint32), np.uint32(END_ID)))
    return out


def _shrink(ids: np.ndarray) -> bytes:
    """One tag byte (bytes per id), the count, then the compressed ids."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return (b"4" if wide else b"2") + len(raw).to_bytes(8, "little") + pa.compress(raw, "lz4_raw", asbytes=True)


def _grow(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[1:9], "little")
    raw = pa.decompress(blob[9:], size, "lz4_raw", asbytes=True)
    return np.frombuffer(raw, dtype="<u4" if blob[:1] == b"4" else "<u2").astype("<u4")


def serve(queues: list[list[int]], credit: np.ndarray, share: np.ndarray, position: int,
          length: int = SEQUENCE, min_piece: int = MIN_PIECE) -> list[tuple[int, int, int, int, int]]:
    """Deficit round robin over ``queues`` of document lengths. Returns
    pieces ``(queue, document in queue, start, length, position)``, gapless
    from ``position`` on."""
    head = [0] * len(queues)
    begun = [0] * len(queues)  # tokens of the head document served
    credit = credit.astype(np.float64).copy()
    open_ = np.array([len(q) > 0 for q in queues])
    out = []
    room = length - position % length
    credit += share * room
    while open_.any():
        s = int(np.argmax(np.where(open_, credit, -np.inf)))
        left = queues[s][head[s]] - begun[s]
        others = np.count_nonzero(open_) > 1
        take = min(left, room, max(min_piece, math.ceil(credit[s])) if others else left)
        out.append((s, head[s], begun[s], take, position))
        position += take
        room -= take
        credit[s] -= take
        begun[s] += take
        if begun[s] == queues[s][head[s]]:
            head[s] += 1
            begun[s] = 0
            open_[s] = head[s] < len(queues[s])
        if room == 0:
            room = length
            credit += share * room
    return out


_PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, source string, ids array<int>")


def pack(df: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, text: str = "text",
         doc_id: str = "doc_id", source: str = "source", bucket_tokens: int = BUCKET_TOKENS,
         min_piece: int = MIN_PIECE, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens.

    ``weights``: target token proportions by source; by default each
    source's share of all tokens, so that every part of the output mirrors
    the corpus, whatever its bucket was dealt. A source without a weight gets
    none of the credit and is served when the others of its bucket are used
    up. A null or empty text
    is its end id alone; null ids and sources are kept (a null source is a
    queue of its own); repeated rows are packed once each; an empty table
    gives no pieces.
    """
    rows = cut(df.select(col(doc_id).cast("bigint").alias("doc_id"), col(source).cast("string").alias("source"),
                         _encode_column(text, tokenizer).alias("t")).select("doc_id", "source", "t.*"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_tokens))

    key = F.xxhash64("doc_id", "n", "source")
    rows = rows.withColumn("h", key).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = cut(rows.groupBy("bucket", "source").agg(F.sum("n").alias("n")).withColumn("g", F.expr(f"bucket div {_GROUP}")))
    # one row per source: its share of the output that is wanted
    by_source = sums.groupBy(F.col("source").alias("src")).agg(F.sum("n").alias("n"))
    if weights is None:
        wanted = by_source.select("src", (F.col("n") / F.lit(max(total, 1))).alias("share"))
    else:
        given = df.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        present = by_source.join(given, F.col("src").eqNullSafe(F.col("name")), "left").select("src", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        scale = present.agg(F.sum("weight")).first()[0] or 1.0
        wanted = present.select("src", (F.col("weight") / F.lit(scale)).alias("share"))
    # tokens of all earlier buckets: inside groups of buckets by a window, the
    # few group totals on the driver
    by_bucket = sums.groupBy("bucket", "g").agg(F.sum("n").alias("n"))
    groups = sorted(tuple(r) for r in by_bucket.groupBy("g").agg(F.sum("n")).collect())
    before, acc = [], 0
    for g, n in groups:
        before.append((int(g), acc))
        acc += n
    spark = df.sparkSession
    first = spark.createDataFrame(before, "g bigint, first bigint")
    prior = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = (by_bucket.join(F.broadcast(first), "g")
             .select("bucket", (F.col("first") + F.coalesce(F.sum("n").over(prior), F.lit(0))).alias("begin")))
    # the same by source: groups before, then buckets before inside the group
    within = Window.partitionBy("source", "g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (sums.groupBy("source", "g").agg(F.sum("n").alias("n"))
               .select(F.col("source").alias("s"), F.col("g").alias("h"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("early")))
    plan = (sums.withColumn("late", F.coalesce(F.sum("n").over(within), F.lit(0)))
            .join(earlier, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("h")))
            .join(wanted, F.col("source").eqNullSafe(F.col("src"))).drop("src")
            .join(begin, "bucket").select(F.col("bucket").alias("at_bucket"), "begin", F.col("source").alias("src"),
                                          (F.col("early") + F.col("late")).alias("served"), "share"))

    def fill(docs: pa.Table, at: pa.Table) -> pa.Table:
        return _fill(docs, at, min_piece, with_ids)

    kind = _PIECES if with_ids else _PIECES.removesuffix(", ids array<int>")
    return (rows.groupBy("bucket").cogroup(cut(plan).groupBy("at_bucket")).applyInArrow(fill, kind))


def _fill(docs: pa.Table, at: pa.Table, min_piece: int, with_ids: bool) -> pa.Table:
    if not docs.num_rows:
        return pa.table({n: pa.array([], t) for n, t in _out(with_ids)})
    plan = {s: (share, served) for s, share, served in zip(at["src"].to_pylist(), at["share"].to_pylist(), at["served"].to_pylist(), strict=True)}
    begin = at["begin"][0].as_py()
    docs = docs.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
    names = docs["source"].to_pylist()
    sources = sorted(set(names), key=lambda s: (s is not None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    queues: list[list[int]] = [[] for _ in sources]
    rows_of: list[list[int]] = [[] for _ in sources]
    sizes = docs["n"].to_pylist()
    for r, (s, n) in enumerate(zip(names, sizes, strict=True)):
        queues[number[s]].append(n)
        rows_of[number[s]].append(r)
    # the share of each window: the target, and an even part of the deficit
    # that is carried in; a source that is ahead by more than the bucket waits
    whole = sum(sizes)
    share = np.array([max(0.0, plan[s][0] + (plan[s][0] * begin - plan[s][1]) / whole) for s in sources])
    share = share / share.sum() if share.sum() > 0 else np.array([sum(q) / whole for q in queues])
    credit = np.zeros(len(sources))
    pieces = serve(queues, credit, share, begin, min_piece=min_piece)
    by_row: dict[int, list[int]] = {}
    for k, (s, d, *_) in enumerate(pieces):
        by_row.setdefault(rows_of[s][d], []).append(k)
    crc, parts = [0] * len(pieces), [None] * len(pieces)
    blobs = docs["ids"]
    for r, ks in by_row.items():
        ids = _grow(blobs[r].as_py())
        for k in ks:
            part = ids[pieces[k][2]: pieces[k][2] + pieces[k][3]]
            crc[k] = zlib.crc32(part.tobytes())
            if with_ids:
                parts[k] = part.astype(np.int32)
    row = [rows_of[p[0]][p[1]] for p in pieces]
    ids_of, pos = docs["doc_id"].to_pylist(), [p[4] for p in pieces]
    cols = [[ids_of[r] for r in row], [p[2] for p in pieces], [p[3] for p in pieces], crc, [sizes[r] for r in row],
            [x // SEQUENCE for x in pos], [x % SEQUENCE for x in pos], [names[r] for r in row]]
    if with_ids:
        cols.append(parts)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_out(with_ids), cols, strict=True)})


def _out(with_ids: bool) -> list[tuple[str, pa.DataType]]:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return [(n, pa.int64()) for n in names] + [("source", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
