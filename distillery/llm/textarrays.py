"""Vectorised text helpers over Arrow string buffers, used inside tasks.

A text column arrives as Arrow batches; these helpers work on its UTF-8
bytes with numpy, so no Python object is made per word. Null texts count
as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
# every byte that starts a code point
LEAD = np.ones(256, dtype=bool)
LEAD[0x80:0xC0] = False

_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = x + np.uint64(salt) if salt else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(arr: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """``(start row, part)`` with at most ``max_bytes`` of text each; a row
    that is longer on its own gets its own part. After the last part the
    memory freed meanwhile goes back to the system."""
    if len(arr) == 0:
        return
    off = offsets(arr)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(arr))
        yield lo, arr.slice(lo, hi - lo)
        lo = hi
    release()



def release() -> None:
    """Hand freed memory back. Python workers outlive their tasks, so what
    they hold on to is missing to the stages that follow."""
    gc.collect()  # functions shipped by value are cyclic garbage after their task
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def offsets(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buf = arr.buffers()[1]
    if buf is None or len(arr) == 0:
        return np.zeros(len(arr) + 1, dtype=np.int64)
    off = np.frombuffer(buf, dtype=np.int64 if wide else np.int32)
    return off[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets from 0)``; a null has the length 0."""
    if arr.null_count:
        arr = arr.fill_null("")
    off = offsets(arr)
    buf = arr.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]: off[-1]]
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: byte starts, byte ends, and per text the
    offsets into them."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    word = ~WHITESPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending, disjoint spans): a
    polynomial over random byte values, taken from prefix sums block by
    block so that memory stays bounded, then mixed with the length."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + _BLOCK, side="right")), i + 1)
        hi = ends[j - 1]
        up, down = _powers(int(hi - lo))
        s = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=s[1:])
        out[i:j] = (s[ends[i:j] - lo] - s[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _MUL)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _BLOCK)
        made = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if n > 4 * _BLOCK:  # one huge span: do not keep its table
            return made[0], made[1]
        _pow[:] = made
    return _pow[0], _pow[1]


def windows(words: np.ndarray, doc_off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and per text the
    offsets into them. A text with fewer words, but at least one, has one
    run: all its words."""
    n = np.diff(doc_off)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    run_off = np.concatenate([[0], np.cumsum(runs)])
    if run_off[-1] == 0:
        return np.zeros(0, dtype=np.uint64), run_off
    first = np.repeat(doc_off[:-1] - run_off[:-1], runs) + np.arange(run_off[-1])
    length = np.repeat(np.minimum(n, size), runs)
    h = length.astype(np.uint64) * _MUL
    for k in range(size):
        inside = length > k
        w = words[np.minimum(first + k, len(words) - 1)]
        h = np.where(inside, mix(h * np.uint64(0x100000001B3) + w), h)
    return h, run_off


def shingle_sets(arr: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for _, part in slices(arr):
        data, off = raw(part)
        data = LOWER[data]
        starts, ends, doc_off = word_spans(data, off)
        h, run_off = windows(span_hashes(data, starts, ends), doc_off, size)
        for i in range(len(part)):
            yield np.unique(h[run_off[i]: run_off[i + 1]])
