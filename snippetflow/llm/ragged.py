"""Vectorised kernels over a batch of texts held as one byte array and offsets.

All of them run inside Spark tasks on Arrow batches.  Words and shingles are
known by 64-bit hashes: a sum of random byte values times powers of an odd
number, modulo 2^64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
GRAM_VALUES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", int(MULT)), ("down", _inverse(int(MULT)))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offs


def chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets from 0) of runs of rows of at most ``limit``
    bytes, or of one longer row: bounds the working memory, never the text."""
    data, offs = buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """(start, end, first word of each row): words are maximal runs of bytes
    for which ``inside`` holds, never across rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    on = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(on & ~before)
    end = np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, inside: np.ndarray, values: np.ndarray = FOLDED_VALUES):
    start, end, first = words(data, offs, inside)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first
    return span_hash(prefix_hash(data, values), start, end), start, end, first


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h (the caller masks row ends)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j:j + m] * GRAM_VALUES[j]
    return mix(out + U64(n))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by block prefixes and suffixes."""
    n = len(a)
    if n < w:
        return a[:0]
    if w == 1:
        return a.copy()
    if w <= 8:
        out = a[:n - w + 1].copy()
        for j in range(1, w):
            np.minimum(out, a[j:n - w + 1 + j], out=out)
        return out
    pad = -n % w
    top = np.iinfo(a.dtype).max
    b = np.concatenate([a, np.full(pad, top, a.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def sliding_max(a: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~a, w)
