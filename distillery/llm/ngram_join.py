"""N-gram Jaccard self-join by prefix trees (operator 2).

Two texts link when the Jaccard similarity of their sets of distinct
5-word shingles is at least 3/4. The join keeps one class per distinct
set and finds the links between classes:

1. *Signatures.* One pass gives each text its set size and a 128-bit key of
   its set; equal sets form one class (a grouped minimum, combined before
   the shuffle, so a hot group of copies costs one row per task).
2. *Unique-shingle filter.* A linked text shares all but a quarter of its
   shingles. Half of the hash space is exchanged as packed 32-bit values,
   dealt by hash range, to count for each class the shingles that no other
   class has. A class with more than n/4 of them links with nothing. (A
   collision only lets a class pass.)
3. *Global order.* For the classes that pass, the document frequency of each
   shingle fixes the order: rare first, then by hash. Shingles of
   frequency 1 cannot match and are only counted.
4. *Prefixes.* Linked sets share a shingle among their first floor(n/4)+1.
   Classes that share one form candidate groups (connected components over
   star edges, never all pairs).
5. *Tries.* Each candidate group is joined by a path-compressed prefix tree
   of its ordered sets. A probe walks the tree level by level, shares the
   overlap of common prefixes, and prunes subtrees whose remaining lengths
   cannot reach the required overlap. Groups above ``block`` classes are
   cut into blocks: some pivots are compared with all members first, and
   block pairs are joined unless all of their classes are linked already,
   so a large group of copies stays linear and no task holds a whole one.
6. Only links that join two parts are returned; components follow.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from distillery.llm import textarrays as ta
from distillery.llm import vocab
from distillery.llm.components import connected_components
from distillery.llm.shared import KeyFilter, col, cut, free_name, small_side

SHINGLE_WORDS = 5
RANGE_TOKENS = 2_000_000   # shingles a task counts at once
SLOT_COUNTS = 4_000_000    # counts a task adds up at once
FLUSH_BYTES = 8 << 20      # packed shingles a map task holds before it hands them on
BLOCK = 256                # classes in one trie
PIVOTS = 8                 # members of a large group that are compared with all of it

_SIG = "struct<n:bigint,k1:bigint,k2:bigint>"
_SET = "struct<k1:bigint,toks:array<bigint>>"


def _keys(s: np.ndarray) -> tuple[int, int]:
    return int(ta.mix(s, 1).sum(dtype=np.uint64)), int(ta.mix(s, 0x5851F42D4C957F2D).sum(dtype=np.uint64))


def _signature(text: pa.Array) -> pa.Array:
    vocab.let_go()
    n, k1, k2 = [], [], []
    for s in ta.shingle_sets(text, SHINGLE_WORDS):
        a, b = _keys(s)
        n.append(len(s))
        k1.append(a)
        k2.append(b)
    as_long = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), as_long(k1), as_long(k2)], ["n", "k1", "k2"])


def _shingle_set(text: pa.Array) -> pa.Array:
    vocab.let_go()
    sets = list(ta.shingle_sets(text, SHINGLE_WORDS))
    k1 = np.array([_keys(s)[0] for s in sets], dtype=np.uint64).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(k1), _lists(sets, np.int64)], ["k1", "toks"])


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(kind)))


_PACK = "r int, keys binary, lens binary, toks binary"


def _packed(sets: Iterator[tuple[int, np.ndarray]], ranges: int, shift: int, narrow: bool) -> Iterator[pa.RecordBatch]:
    """Deal hashes by range of the hash space into packed rows. ``shift``:
    leading zero bits of all hashes; ``narrow``: keep the low 32 bits."""
    bounds = np.array([(b << 64) // ranges >> shift for b in range(1, ranges)], dtype=np.uint64)
    kind = np.uint32 if narrow else np.uint64
    held: list[list] = [[[], [], []] for _ in range(ranges)]
    size = 0

    def flush():
        used = [r for r in range(ranges) if held[r][0]]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()),
                 pa.array([np.array(held[r][0], dtype=np.uint64).tobytes() for r in used], pa.binary()),
                 pa.array([np.array(held[r][1], dtype=np.uint32).tobytes() for r in used], pa.binary()),
                 pa.array([np.concatenate(held[r][2]).tobytes() for r in used], pa.binary())],
                ["r", "keys", "lens", "toks"])
        for h in held:
            h[:] = [[], [], []]

    for key, s in sets:
        cuts = np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]])
        vals = s.astype(kind)
        for r in np.flatnonzero(np.diff(cuts)):
            h = held[r]
            h[0].append(key)
            h[1].append(cuts[r + 1] - cuts[r])
            h[2].append(vals[cuts[r]: cuts[r + 1]])
        size += vals.nbytes + 12 * min(ranges, len(s))
        if size > FLUSH_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _unpack(t: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, lens, hashes)`` of a range, one entry per key. What the last
    range left behind is handed back first."""
    vocab.let_go()
    ta.release()
    join = lambda c, k: np.concatenate([np.frombuffer(x.as_py(), dtype=k) for x in t[c]])
    keys, lens, toks = join("keys", np.uint64), join("lens", np.uint32).astype(np.int64), join("toks", kind)
    _, first = np.unique(keys, return_index=True)
    if len(first) < len(keys):
        keep = np.zeros(len(keys), dtype=bool)
        keep[first] = True
        toks = toks[np.repeat(keep, lens)]
        keys, lens = keys[keep], lens[keep]
    return keys, lens, toks


def _ranges(tokens: int) -> int:
    return max(1, math.ceil(tokens / RANGE_TOKENS))


class RowFilter(KeyFilter):
    """Chooses rows by their keys inside tasks, each key once a task."""

    def __init__(self, keys: DataFrame, rows: int):
        super().__init__(keys, rows)
        self.whole = np.zeros(self.bits // 8, dtype=np.uint8)
        for b, m in self.parts:
            self.whole[b * len(m): (b + 1) * len(m)] = np.frombuffer(m, dtype=np.uint8)
        self.parts = []

    def hits(self, keys: pa.Array) -> np.ndarray:
        p = np.asarray(keys) & np.int64(self.bits - 1)
        return (self.whole[p >> 3] >> (p & 7)) & 1 == 1

    def first_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """``(row_key, text)`` of the rows that pass, each key once a task."""
        seen: set[int] = set()
        for b in batches:
            keys = np.asarray(b.column(0))
            at = [i for i in np.flatnonzero(self.hits(b.column(0))).tolist()
                  if (k := int(keys[i])) not in seen and not seen.add(k)]
            if at:
                take = pa.array(at, pa.int64())
                yield b.column(0).take(take), b.column(1).take(take)

    def tokens(self, sig: DataFrame, tasks: int) -> int:
        """Shingles of all rows of ``sig(row_key, n)`` that ``first_rows``
        hands on: a repeated row at most once in each of ``tasks``."""
        mine = sig.filter("n > 0").filter(arrow_udf(lambda k: pa.array(self.hits(k)), "boolean")("row_key"))
        per = mine.groupBy("row_key").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"))
        return per.agg(F.sum(F.col("n") * F.least("c", F.lit(tasks)))).first()[0] or 0


def unshared_counts(rows: DataFrame, chosen: RowFilter, classes: int, tokens: int) -> DataFrame:
    """``(k1, unshared)``: sampled shingles of a class that no other has.
    ``rows(row_key, text)``, ``tokens``: the shingles of the rows that
    ``chosen`` passes. Ranges hand their counts on packed, dealt by key into
    slots."""
    ranges = _ranges(tokens // 2)
    slots = max(1, math.ceil(classes * ranges / SLOT_COUNTS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            vocab.let_go()
            for _, text in chosen.first_rows(batches):
                for s in ta.shingle_sets(text, SHINGLE_WORDS):
                    if len(s):
                        yield _keys(s)[0], s[: np.searchsorted(s, np.uint64(1 << 63))]
        return _packed(sets(), ranges, 1, True)

    def count(t: pa.Table) -> pa.Table:
        keys, lens, toks = _unpack(t, np.uint32)
        pair = (toks.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(keys), dtype=np.uint64), lens)
        pair.sort()
        high = pair >> np.uint64(32)
        alone = np.ones(len(pair), dtype=bool)
        same = high[1:] == high[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        n = np.bincount((pair[alone] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(keys))
        slot = np.where(n > 0, (keys % np.uint64(slots)).astype(np.int64), -1)
        order = np.argsort(slot, kind="stable")
        at = np.searchsorted(slot[order], np.arange(slots + 1))
        parts = [order[at[i]: at[i + 1]] for i in range(slots)]
        return pa.table({"slot": pa.array(range(slots), pa.int32()),
                         "keys": pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                         "counts": pa.array([n[p].astype(np.uint32).tobytes() for p in parts], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        join = lambda c, k: np.concatenate([np.frombuffer(x.as_py(), dtype=k) for x in t[c]])
        keys, inv = np.unique(join("keys", np.uint64), return_inverse=True)
        n = np.bincount(inv, weights=join("counts", np.uint32), minlength=len(keys))
        return pa.table({"k1": keys.view(np.int64), "unshared": n.astype(np.int64)})

    packed = rows.mapInArrow(deal, _PACK)
    return (packed.groupBy("r").applyInArrow(count, "slot int, keys binary, counts binary")
            .groupBy("slot").applyInArrow(add, "k1 bigint, unshared bigint"))


def _sets_of(rows: DataFrame, chosen: RowFilter) -> DataFrame:
    """``(k1, toks)``: the shingle sets of the texts of ``rows(row_key,
    text)`` that ``chosen`` passes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in chosen.first_rows(batches):
            yield pa.RecordBatch.from_struct_array(_shingle_set(text))
    return rows.mapInArrow(sets, "k1 bigint, toks array<bigint>").filter("size(toks) > 0")


def ordered_sets(sets: DataFrame, sizes: DataFrame, tokens: int) -> DataFrame:
    """``sets(k1, toks)``, repeats allowed, and ``sizes(k1, n)`` -> ``(k1, n,
    toks)`` with the shared shingles only, rare first."""
    ranges = _ranges(tokens)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                k1 = np.asarray(b.column(0)).view(np.uint64)
                off, flat = np.asarray(b.column(1).offsets), np.asarray(b.column(1).values).view(np.uint64)
                for i in range(len(k1)):
                    yield int(k1[i]), flat[off[i]: off[i + 1]]
        return _packed(each(), ranges, 0, False)

    def count(t: pa.Table) -> pa.Table:
        keys, lens, toks = _unpack(t, np.uint64)
        _, inv, df = np.unique(toks, return_inverse=True, return_counts=True)
        df = df[inv]
        shared = df > 1
        owner = np.repeat(np.arange(len(keys)), lens)[shared]
        per = np.bincount(owner, minlength=len(keys))
        off = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        return pa.table({"k1": keys.view(np.int64),
                         "toks": pa.ListArray.from_arrays(off, pa.array(toks[shared].view(np.int64))),
                         "dfs": pa.ListArray.from_arrays(off, pa.array(df[shared].astype(np.int32)))})

    def rare_first(toks: pa.Array, dfs: pa.Array) -> pa.Array:
        off, t, d = np.asarray(toks.offsets), np.asarray(toks.values), np.asarray(dfs.values)
        out = []
        for i in range(len(toks)):
            a, b = t[off[i]: off[i + 1]], d[off[i]: off[i + 1]]
            out.append(a[np.lexsort((a, b))])
        return _lists(out, np.int64)

    packed = sets.select("k1", "toks").mapInArrow(deal, _PACK)
    parts = (packed.groupBy("r").applyInArrow(count, "k1 bigint, toks array<bigint>, dfs array<int>")
             .groupBy("k1").agg(F.collect_list(F.struct("toks", "dfs")).alias("p")))
    return (parts.select("k1", arrow_udf(rare_first, "array<bigint>")(F.flatten("p.toks"), F.flatten("p.dfs")).alias("toks"))
            .join(sizes, "k1").select("k1", "n", "toks"))


class Trie:
    """Path-compressed prefix tree of ordered sets, as arrays.

    A node holds a run of at most ``run`` tokens that all sets below it
    share; every set ends in a leaf node of its own without tokens.
    ``rest`` is the largest number of tokens below a node, ``size`` the
    smallest set size under it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, run: int = 24):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        seqs, lens = [sets[i] for i in order], np.array([len(sets[i]) for i in order])
        least = np.asarray(sizes)[order]
        parent, leaf, rest, size, runs = [], [], [], [], []

        def node(up, of, below, small, toks):
            parent.append(up)
            leaf.append(of)
            rest.append(below)
            size.append(small)
            runs.append(toks)
            return len(parent) - 1

        # (parent, first set, last set + 1, depth): sets that agree up to depth
        todo = [(-1, 0, len(seqs), 0)]
        while todo:
            up, lo, hi, depth = todo.pop()
            while lo < hi and lens[lo] == depth:  # the shortest come first
                node(up, order[lo], 0, least[lo], seqs[lo][:0])
                lo += 1
            if lo == hi:
                continue
            heads = np.array([seqs[i][depth] for i in range(lo, hi)])
            for part in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(heads)) + 1):
                i, j = int(part[0]), int(part[-1]) + 1
                a, b = seqs[i][depth: depth + run], seqs[j - 1][depth: depth + run]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                end = depth + (int(differ[0]) if len(differ) else m)
                v = node(up, -1, int(lens[i:j].max()) - end, least[i:j].min(), seqs[i][depth:end])
                todo.append((v, i, j, end))
        self.leaf, self.rest, self.size = (np.array(x, dtype=np.int64) for x in (leaf, rest, size))
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        self.toks = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
        up = np.array(parent, dtype=np.int64)
        self.kids = np.argsort(up, kind="stable")
        self.kid_at = np.searchsorted(up[self.kids], np.arange(-1, len(up) + 1))

    def children(self, nodes: np.ndarray) -> np.ndarray:
        lo, hi = self.kid_at[nodes + 1], self.kid_at[nodes + 2]
        return self.kids[_ragged(lo, hi - lo)]

    def probe(self, present: np.ndarray, rank: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that link with a probe of ``n`` shingles: ``(set numbers,
        overlaps)``. ``present[token]`` tells membership, ``rank`` is the
        probe's number of shared tokens."""
        nodes = self.children(np.array([-1]))
        over = np.zeros(len(nodes), dtype=np.int64)
        hits, sizes = [], []
        while len(nodes):
            length = self.start[nodes + 1] - self.start[nodes]
            got = np.concatenate([[0], np.cumsum(present[self.toks[_ragged(self.start[nodes], length)]])])
            ends = np.cumsum(length)
            over = over + got[ends] - got[ends - length]
            done = self.leaf[nodes] >= 0
            if done.any():
                hits.append(self.leaf[nodes[done]])
                sizes.append(over[done])
            most = np.minimum(over + self.rest[nodes], rank)
            alive = 7 * most >= 3 * (n + self.size[nodes])
            nodes, over = nodes[alive], over[alive]
            kids = self.kid_at[nodes + 2] - self.kid_at[nodes + 1]
            over = np.repeat(over, kids)
            nodes = self.children(nodes)
        z = np.zeros(0, dtype=np.int64)
        return (np.concatenate(hits), np.concatenate(sizes)) if hits else (z, z)


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + length[i] - 1``, one after another."""
    total = int(length.sum())
    skip = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(length) else np.zeros(0, int)
    return skip + np.arange(total)


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect parts: sets of side 0 form the trie; they probe it
    themselves unless there is a side 1, which then probes. ``group``:
    sets with the same number of at least 0 are linked already."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):
        if g >= 0:
            root[find(i)] = find(first.setdefault(g, i))
    vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    # the order inside a block is the global one restricted to its sets: the
    # ordered lists are kept as they are, only renamed to small numbers
    local = [flat[at[i]: at[i + 1]] for i in range(len(sets))]
    inner = np.flatnonzero(side == 0)
    probes = np.flatnonzero(side == 1) if (side == 1).any() else inner
    tree = Trie([local[i] for i in inner], sizes[inner])
    present = np.zeros(len(vocab) + 1, dtype=bool)
    out = []
    for p in probes.tolist():
        present[local[p]] = True
        hits, over = tree.probe(present, len(local[p]), int(sizes[p]))
        present[local[p]] = False
        for h, o in zip(inner[hits].tolist(), over.tolist(), strict=True):
            if h != p and 7 * o >= 3 * (int(sizes[p]) + int(sizes[h])):
                a, b = find(h), find(p)
                if a != b:
                    root[a] = b
                    out.append((h, p))
    return out


def _join_block(t: pa.Table) -> pa.Table:
    toks = t["toks"].combine_chunks()
    off, flat = np.asarray(toks.offsets), np.asarray(toks.values)
    k1 = np.asarray(t["k1"].combine_chunks())
    sets = [flat[off[i]: off[i + 1]] for i in range(len(k1))]
    links = trie_links(sets, np.asarray(t["n"].combine_chunks()), np.asarray(t["side"].combine_chunks()),
                       np.asarray(t["grp"].combine_chunks()))
    return pa.table({"u": pa.array([int(k1[a]) for a, _ in links], pa.int64()),
                     "v": pa.array([int(k1[b]) for _, b in links], pa.int64())})


def _links(classes: DataFrame) -> DataFrame:
    """``classes(k1, n, toks)`` -> edges ``(u, v)`` that span every component."""
    prefix = F.expr("greatest(0, cast(floor(n / 4) + 1 - (n - size(toks)) as int))")
    keyed = classes.select("k1", F.explode(F.slice("toks", F.lit(1), prefix)).alias("t"))
    star = keyed.groupBy("t").agg(F.min("k1").alias("root"), F.max("k1").alias("last")).filter("root <> last")
    groups = connected_components(keyed.join(star, "t").filter("k1 <> root")
                                  .select(F.col("k1").alias("u"), F.col("root").alias("v")).distinct())
    groups = groups.select(F.col("node").alias("k1"), F.col("component").alias("comp"))
    members = cut(classes.join(groups, "k1"))
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    members = cut(members.join(sizes, "comp"))

    # groups of at most BLOCK classes: one trie each
    small = members.filter(F.col("m") <= BLOCK).select(
        F.struct("comp", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("kind")).alias("task"),
        "k1", "n", "toks", F.lit(0).alias("side"), F.lit(-1).cast("bigint").alias("grp"))
    edges = small.groupBy("task").applyInArrow(_join_block, "u bigint, v bigint")

    big = members.filter(F.col("m") > BLOCK)
    if big.isEmpty():
        return edges
    # pivots: per salt the member with the largest share of shared shingles
    pivots = (big.groupBy("comp", F.pmod(F.xxhash64("k1"), F.lit(PIVOTS)).alias("salt"))
              .agg(F.max(F.struct(F.expr("size(toks) / n"), "k1")).alias("p"))
              .select("comp", F.col("p.k1").alias("k1")))
    pivots = pivots.join(big.drop("comp", "m"), "k1").select(
        "comp", F.col("k1").alias("pk"), F.col("n").alias("pn"), F.col("toks").alias("ptoks"))
    stars = cut(big.join(pivots, "comp").filter("k1 <> pk AND 4 * n >= 3 * pn AND 4 * pn >= 3 * n")
                .filter(7 * F.size(F.array_intersect("toks", "ptoks")) >= 3 * (F.col("n") + F.col("pn")))
                .select(F.col("k1").alias("u"), F.col("pk").alias("v")))
    parts = connected_components(stars).select(F.col("node").alias("k1"), F.col("component").alias("grp"))
    big = big.join(parts, "k1", "left")
    main = (big.filter("grp IS NOT NULL").groupBy("comp", "grp").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("comp").agg(F.max(F.struct("c", "grp")).alias("top")))
    big = big.join(main, "comp", "left").withColumn("linked", F.expr("coalesce(grp = top.grp, false)"))
    counts = big.groupBy("comp").agg(F.expr("cast(ceil(count_if(NOT linked) / %d) as int)" % BLOCK).alias("bu"),
                                     F.expr("cast(ceil(count_if(linked) / %d) as int)" % BLOCK).alias("bl"))
    big = cut(big.join(counts, "comp").filter("bu > 0")
              .withColumn("i", F.expr("cast(pmod(xxhash64(k1, 7), if(linked, bl, bu)) as int)"))
              .withColumn("grp", F.coalesce("grp", F.lit(-1).cast("bigint"))))
    # open blocks meet each other and every linked block; linked ones never meet
    task = F.expr("""
        CASE WHEN linked THEN
          transform(sequence(0, bu - 1), j -> struct(j AS a, i AS b, 1 AS kind, 1 AS side))
        ELSE concat(
          transform(sequence(0, bu - 1), j -> struct(least(i, j) AS a, greatest(i, j) AS b, 0 AS kind,
                                                     if(i <= j, 0, 1) AS side)),
          if(bl > 0, transform(sequence(0, bl - 1), j -> struct(i AS a, j AS b, 1 AS kind, 0 AS side)),
             array())) END""")
    blocks = big.select("comp", "k1", "n", "toks", "grp", F.explode(task).alias("x")).select(
        F.struct("comp", "x.a", "x.b", "x.kind").alias("task"), "k1", "n", "toks", F.col("x.side").alias("side"), "grp")
    return edges.unionByName(stars).unionByName(blocks.groupBy("task").applyInArrow(_join_block, "u bigint, v bigint"))


def near_duplicate_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, row_key, n_shingles, component_id, root)``, one row per row
    of ``df``. ``component_id`` is the smallest ``doc_id`` that links reach.

    A null or blank text has no shingles and links with nothing, so its
    component is its own id (null if that is null). Repeated rows and equal
    texts share a component. Null ids are kept and never chosen as a
    component id while its group has another. ``row_key`` is a hash of id and
    text. ``root`` tells groups apart where ids do not (null ids, one id on
    different texts); it is null without shingles. An empty table gives no
    rows; other columns are not read.
    """
    rows = df.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    row_key = F.xxhash64("doc_id", "text")
    sig = cut(rows.select("doc_id", row_key.alias("row_key"), arrow_udf(_signature, _SIG)("text").alias("s"))
              .select("doc_id", "row_key", "s.*"))
    classes = cut(sig.filter("n > 0").groupBy("k1", "k2")
                  .agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n")))
    count = classes.count()
    # one row of a class is dealt, not its copies; ranges are sized by what is
    # dealt: the chosen rows, and a few others that the bitmap lets pass
    keyed = rows.select(row_key.alias("row_key"), "text")
    chosen = RowFilter(classes.select("row_key"), count)
    alone = unshared_counts(keyed, chosen, count, chosen.tokens(sig, sig.rdd.getNumPartitions()))
    left = cut(classes.join(alone, "k1", "left").filter("coalesce(unshared, 0) <= floor(n / 4)")
               .select("k1", "row_key", "n"))
    # the texts of these classes are not moved, only their sets are
    sets = cut(_sets_of(keyed, RowFilter(left.select("row_key"), left.count())))
    tokens = sets.agg(F.sum(F.size("toks"))).first()[0] or 0
    ordered = cut(ordered_sets(sets, classes.select("k1", "n"), tokens).filter("size(toks) >= n - floor(n / 4)"))
    groups = connected_components(_links(ordered)).select(F.col("node").alias("k1"), F.col("component").alias("root"))
    own = classes.select("k1", "k2", "least_id").join(groups, "k1", "left").withColumn(
        "root", F.coalesce("root", "k1"))
    least = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = own.join(least, "root").select("k1", "k2", "component_id", "root")
    return (sig.join(of_class, ["k1", "k2"], "left")
            .select("doc_id", "row_key", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "root"))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row of each near-duplicate group: the one with the
    smallest id (nulls last), then the smallest row key; of rows with equal
    id and text, one. Rows without shingles are all kept.

    Texts stay where they are: a bitmap of the keys that go (or are repeated)
    keeps all other rows, and a bitmap of what the first one lets pass by
    mistake drops all but a few of the rest. Only rows that both let pass are
    looked up, and only those that repeat are compared with each other.
    """
    found = cut(near_duplicate_components(df, text, doc_id).filter("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    # by root: unlinked texts may share a component id, or have none
    best = found.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.row_key").alias("row_key"), F.lit(True).alias("stays"))
    keys = cut(found.groupBy("row_key").agg((F.count(F.lit(1)) > 1).alias("again")).join(best, "row_key", "left")
               .select("row_key", "again", F.coalesce("stays", F.lit(False)).alias("stays")))
    noted = keys.filter("again OR NOT stays")
    first = KeyFilter(noted, noted.count())
    doubt = cut(first.mark(keys.filter("stays"), F.col("row_key"), "hit").filter("again OR hit"))
    second = KeyFilter(doubt, doubt.count())
    gone = cut(second.mark(keys.filter("NOT stays"), F.col("row_key"), "hit").filter("hit").select("row_key"))

    key, a, b = (free_name(df, n) for n in ("_row_key", "_first", "_second"))
    blank = F.coalesce(F.length(F.regexp_replace(col(text), "[\\x20\\x09-\\x0D]+", "")), F.lit(0)) == 0
    judged = df.withColumn(key, F.xxhash64(col(doc_id), col(text)))
    judged = second.mark(first.mark(judged, col(key), a), col(key), b)
    kept = judged.filter(~col(a) | blank)
    asked = judged.filter(col(a) & col(b) & ~blank).join(
        small_side(gone.withColumnRenamed("row_key", key), gone.count(), 16), key, "left_anti").dropDuplicates([key])
    return kept.select(*map(col, df.columns)).unionByName(asked.select(*map(col, df.columns)))
