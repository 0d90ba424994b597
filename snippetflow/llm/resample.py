"""Importance resampling towards a target distribution (operator 13).

Each document is a bag of hashed features: all runs of 1 to ``max_run``
consecutive words, crc32 modulo ``buckets``.  A bucket's gain is the scaled log of how
much more often it is met in the target than in all documents, floored to an
integer; a document's weight is the floored mean gain of its features, and a
seeded Gumbel term turns the highest scores into a draw without replacement.

Bit-sliced aggregation: a document's bucket counts are written as planes of
``buckets`` bits, plane j holding bit j of every count, and the gains as planes of
their bits, positive and negative apart.  The sum of count times gain is then the sum over
pairs of planes of popcount(document plane AND gain plane) times a power of two: whole numbers
throughout, so a weight depends neither on the order of the features nor on the batches.

Two scans read the text.  The first sums ``buckets`` counts in each task and then
over tasks; these sums alone (``buckets`` rows, whatever the corpus) reach the driver, and the gain planes go back
with the code.  The second needs no shuffle.  Ranks come from one range partition
of the narrow scores, never from a window over all rows.

Defined cases: null and empty texts have no features, weight 0 and no rank;
a null doc_id hashes as the empty string and comes last among equal scores; repeated
rows are scored each; rows equal in score and doc_id are drawn in any order;
an empty table gives no rows, an empty target gains from its add-one counts alone;
columns other than the named ones are ignored by ``importance`` and kept by ``resample``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, ship_code
from snippetflow.operators.clean import dense_row_ids
from snippetflow.session import cut_lineage

BUCKETS = 10_000
MAX_RUN = 2
SCALE = 1000
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: Rows whose planes are built at once, and bytes of a word that are hashed beside other words' bytes.
BLOCK_ROWS = 128
WORD_BYTES = 64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def _byte(state: np.ndarray, byte) -> np.ndarray:
    return CRC[(state ^ byte) & 0xFF] ^ (state >> 8)


def _crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 registers after the bytes data[start:start + size]: a byte of every
    span at a time, longest spans first; what is beyond WORD_BYTES goes span by span."""
    short = (WORD_BYTES + 1 - np.minimum(size, WORD_BYTES + 1)).astype(np.uint8)      # 0: longer than WORD_BYTES
    order = np.argsort(short, kind="stable")
    s, at, sizes = state[order], start[order], size[order]
    live = np.cumsum(np.bincount(short, minlength=WORD_BYTES + 2))[WORD_BYTES::-1]     # spans longer than 0, 1, 2, ... bytes
    for p, n in enumerate(live[:WORD_BYTES]):
        if not n:
            break
        s[:n] = _byte(s[:n], data[at[:n] + p])
    for i in range(int(live[WORD_BYTES])):
        rest = data[at[i] + WORD_BYTES:at[i] + sizes[i]].tobytes()
        s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, offs: np.ndarray, buckets: int, max_run: int):
    """(row, bucket) of every feature, and the number of words of each row."""
    start, end, first = R.words(data, offs, R.ALNUM)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    folded, size = FOLD[data], end - start
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    rows, got = [], []
    for run in range(1, max_run + 1):
        if run > 1:        # the runs that end one word later, within their row
            state = _byte(state[:-1], np.uint8(32))
        state = _crc_on(state, folded, start[run - 1:], size[run - 1:])
        inside = row[:len(state)] == row[run - 1:]
        rows.append(row[:len(state)][inside])
        got.append((state[inside] ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets)
        if not len(state):
            break
    return np.concatenate(rows), np.concatenate(got), n_words


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN, text_col: str = "text") -> np.ndarray:
    """How often each bucket is met in the whole table: one sum per task, then one per bucket."""
    ship_code()

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, offs in R.chunks(b.column(0)):
                total += np.bincount(features(data, offs, buckets, max_run)[1], minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = pick(df, text=text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of add-one shares), a whole number for each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
                     for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def bit_rows(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(on), -(-on.shape[1] // 64) * 64), bool)
    wide[:, :on.shape[1]] = on
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, bits of the buckets whose gain has it)."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            out.append((sign << k, bit_rows(((size >> k) & 1).astype(bool)[None])[0]))
    return out


def sums(row: np.ndarray, bucket: np.ndarray, n_rows: int, planes: list, buckets: int) -> np.ndarray:
    """Sum of count times gain for each row, from bit planes alone."""
    total = np.zeros(n_rows, np.int64)
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    row, bucket = key // buckets, key % buckets
    for lo in range(0, n_rows, BLOCK_ROWS):
        a, b = np.searchsorted(row, [lo, lo + BLOCK_ROWS])
        own, at, n = row[a:b] - lo, bucket[a:b], count[a:b]
        for j in range(int(n.max(initial=0)).bit_length()):
            has = (n >> j & 1).astype(bool)
            who, own_j = np.unique(own[has], return_inverse=True)
            on = np.zeros((len(who), buckets), bool)
            on[own_j, at[has]] = True
            plane = bit_rows(on)
            part = np.zeros(len(who), np.int64)
            for power, gain in planes:
                part += power * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
            total[lo + who] += part << j
    return total


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN, scale: int = SCALE,
               seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document; ``row`` is its place in the scan."""
    planes = gain_planes(gains(bucket_counts(docs, buckets, max_run, text), bucket_counts(target, buckets, max_run, target_text), scale))

    def weigh(batches):
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, data, offs in R.chunks(b.column(2)):
                n = len(offs) - 1
                row, bucket, words = features(data, offs, buckets, max_run)
                own = np.bincount(row, minlength=n)
                n_words[lo:lo + n], n_features[lo:lo + n] = words, own
                weight[lo:lo + n] = sums(row, bucket, n, planes, buckets) // np.maximum(own, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             names=["row", "doc_id", "n_words", "n_features", "weight"])

    ship_code()
    rows = pick(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(weigh, f"row long, doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    gumbel = F.floor(F.lit(-float(scale)) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    return got.withColumn("score", F.col("weight") + gumbel)


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``importance`` with the rank (1, 2, 3, ...) of the floor(percent * N / 100) highest scores among
    the N documents of at least ``min_words`` words; null for those not drawn."""
    scored = cut_lineage(importance(docs, target, **options))
    long = F.col("n_words") >= min_words
    n = scored.where(long).count()
    placed = dense_row_ids(scored, [long.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], out="place")
    return placed.withColumn("rank", F.when(long & (F.col("place") < percent * n // 100), F.col("place") + 1)).drop("place")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    drawn = ranked(docs, target, **options).where("rank is not null").select(F.col("row").alias("_drawn"))
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(drawn, F.col("_row") == F.col("_drawn"), "left_semi").drop("_row")
