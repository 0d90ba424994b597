"""Quality by an interpolated modified Kneser-Ney model over raw characters (operator 8).

The n-grams are of characters as they stand in the text (no classes, no fixed
alphabet, case kept), so their number grows with the trusted text.  Each task
counts its 5-grams; the counts are summed by 5-gram, and continuation counts,
discounts, sums of contexts and probabilities follow by aggregations and joins
sharded on the n-gram or context.  The model stays a table: nothing of it but
the discounts of each order and the number of characters reaches the driver.

Texts are cut into blocks of consecutive rows of about ``BLOCK_BYTES``.  The distinct
n-grams of a block are joined with the model, sharded by n-gram; what is found is sent to the block,
where each text is scored as a whole: the probability of the longest n-gram found, times the
back-off weights of the contexts above it.  An unseen character has a share of the
uniform distribution over all characters seen and one more.

Defined cases and the rule for what is kept are those of ``quality``; U+0000
and the place before a text are different symbols.  N-grams meet by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import bit_of, bitmap, pick, ship_code, slots
from snippetflow.llm.quality import QUANTILE, _discounts, judge
from snippetflow.session import cut_lineage, drop_table

ORDER = 5
CHUNK_BYTES = 1 << 19
GRAMS = 1 << 20
BLOCK_BYTES = 1 << 25
SENT = 1 << 16              # names to a batch
LEVEL = 9                   # of the compression of block texts on their way
SHARD_TEXT = 48 << 20       # bytes of text whose blocks make one task
SYMBOLS = [f"s{i}" for i in range(ORDER)]


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each character, first character of each row); numbers start at 1 and differ for different characters."""
    start = (data & 0xC0) != 0x80
    start[offs[:-1][np.diff(offs) > 0]] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(data)))
    sym = data[at].astype(np.int64)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        sym[more] = sym[more] << 8 | data[at[more] + j]
    return sym + 1, np.searchsorted(at, offs)


def distinct(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names of the distinct 5-grams; a row of symbols each; which of them ends at each character; first character of each row)."""
    sym, first = symbols(data, offs)
    rows, lead = len(offs) - 1, ORDER - 1
    padded = np.zeros(len(sym) + lead * rows, np.uint32)
    at = np.arange(len(sym)) + lead * (np.repeat(np.arange(rows), np.diff(first)) + 1)
    padded[at] = sym
    v = R.mix(padded.astype(np.uint64) * R.MULT)
    h = np.full(max(0, len(v) - lead), ORDER, np.uint64)
    for j in range(ORDER):
        h += v[lead - j:len(v) - j] * R.GRAM_VALUES[j]
    enc = pa.array(R.mix(h[at - lead]).view(np.int64)).dictionary_encode()
    which = enc.indices.to_numpy(zero_copy_only=False)
    some = np.zeros(len(enc.dictionary), np.int64)
    some[which] = at
    return enc.dictionary.to_numpy(), padded[some[:, None] + np.arange(-lead, 1)], which, first


def keys(grams: np.ndarray) -> np.ndarray:
    """The 64-bit name of each row of symbols."""
    k = grams.shape[1]
    h = np.full(len(grams), k, np.uint64)
    for j in range(k):
        h += R.mix(grams[:, k - 1 - j].astype(np.uint64) * R.MULT) * R.GRAM_VALUES[j]
    return R.mix(h).view(np.int64)


class Bag:
    """Distinct 5-grams and their counts; merged whenever more than ``GRAMS`` rows came in."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key, grams, n):
        self.parts.append((key, grams, n))
        self.size += len(key)
        if self.size > GRAMS:
            self.merge()
            self.size = 0

    def merge(self):
        key, grams, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key, at, which = np.unique(key, return_index=True, return_inverse=True)
        self.parts = [(key, grams[at], np.bincount(which, n, len(key)).astype(np.int64))]
        return self.parts[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bag = Bag()

    def out():
        _, grams, n = bag.merge()
        return pa.RecordBatch.from_arrays([pa.array(grams[:, j].astype(np.int64)) for j in range(ORDER)] + [pa.array(n)], names=[*SYMBOLS, "n"])
    for b in batches:
        for _, data, offs in R.chunks(b.column(0), CHUNK_BYTES):
            key, grams, which, _ = distinct(data, offs)
            bag.add(key, grams, np.bincount(which, minlength=len(key)))
            if len(bag.parts[0][0]) > 2 * GRAMS:
                yield out()
                bag = Bag()
    if bag.parts:
        yield out()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = np.stack([c.to_numpy() for c in b.columns[:-1]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys(grams)), b.columns[-1]], names=["key", "x"])


def train(trusted: DataFrame) -> tuple[DataFrame, float]:
    """(key, p, back): for n-grams of every order the probability of the last character
    after those before it, and the back-off weight of the n-gram as a context; the
    probability of an unseen character."""
    ship_code()
    schema = ", ".join(f"{s} long" for s in SYMBOLS) + ", n long"
    tables = {ORDER: cut_lineage(trusted.mapInArrow(_count, schema).groupBy(*SYMBOLS).agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):
        # in how many contexts of one character more the n-gram was seen
        tables[k] = cut_lineage(tables[k + 1].groupBy(*SYMBOLS[-k:]).agg(F.count(F.lit(1)).alias("n")))
    uniform = 1 / (tables[1].count() + 1)
    unseen, lower, rows, done = uniform, None, [], list(tables.values())
    for k in range(1, ORDER + 1):
        t = tables[k]
        d1, d2, d3 = _discounts(t)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        sums = [F.sum("n").alias("total"), F.sum(off).alias("taken")]
        if k == 1:
            total, taken = t.agg(*sums).first()
            unseen = uniform * taken / total if total else uniform
            t = t.select(*SYMBOLS[-1:], ((F.col("n") - off + taken * uniform) / total).alias("p")) if total else t.select(*SYMBOLS[-1:], F.lit(0.0).alias("p"))
        else:
            # the context of s0 s1 .. is all but the last symbol, its shorter form all but the first
            ctx = cut_lineage(t.groupBy(*SYMBOLS[-k:-1]).agg(*sums))
            done.append(ctx)
            named = ctx.select(*SYMBOLS[-k:-1], (F.col("taken") / F.col("total")).alias("x")).mapInArrow(_named, "key long, x double")
            rows.append(named.select("key", F.lit(None).cast("double").alias("p"), F.col("x").alias("back")))
            t = t.withColumn("own", F.col("n") - off).join(ctx.hint("merge"), SYMBOLS[-k:-1]).join(lower.withColumnRenamed("p", "low").hint("merge"), SYMBOLS[1 - k:])
            t = t.select(*SYMBOLS[-k:], ((F.col("own") + F.col("taken") * F.col("low")) / F.col("total")).alias("p"))
        lower = cut_lineage(t)
        done.append(lower)
        rows.append(lower.mapInArrow(_named, "key long, x double").select("key", F.col("x").alias("p"), F.lit(None).cast("double").alias("back")))
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    model = cut_lineage(every.groupBy("key").agg(F.max("p").alias("p"), F.max("back").alias("back")))
    for t in done:      # the model is one table now
        drop_table(t)
    return model, unseen


def _blocks(batches: Iterator[pa.RecordBatch], at: int, block_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch and the block of each of its rows: a function of the place in the scan only."""
    task, seen = TaskContext.get().partitionId(), 0
    for b in batches:
        _, offs = R.buffers(b.column(at))
        yield b, (task << 32) + (seen + offs[:-1] - offs[0]) // block_bytes
        seen += int(offs[-1] - offs[0])


def _runs(b: pa.RecordBatch, block: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, its rows of the batch)."""
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield int(block[lo]), b.slice(lo, hi - lo)


def _wanted(at: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bag = -1, Bag()

        def out():
            key, grams, _ = bag.merge()
            # one order after the other, in small batches: a block's names never stand in memory together
            for k in range(1, ORDER + 1):
                got = np.unique(np.concatenate([keys(grams[:, ORDER - k:]), keys(grams[:, ORDER - 1 - k:ORDER - 1])])) if k < ORDER else key
                for lo in range(0, len(got), SENT):
                    part = got[lo:lo + SENT]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part)], names=["block", "key"])
        for b, block in _blocks(batches, at, block_bytes):
            for name, part in _runs(b, block):
                if name != now:
                    if bag.parts:
                        yield from out()
                    now, bag = name, Bag()
                for _, data, offs in R.chunks(part.column(at), CHUNK_BYTES):
                    key, grams, which, _ = distinct(data, offs)
                    bag.add(key, grams, np.ones(len(key), np.int8))
        if bag.parts:
            yield from out()
    return run


def _dealt(at: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in _blocks(batches, at, block_bytes):
            for name, part in _runs(b, block):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])
    return run


def _scored(unseen: float):
    def run(parts: pa.Table, found: pa.Table) -> pa.Table:
        key = found.column("key").to_numpy()
        order = np.argsort(key)
        # one entry more, of what is not found
        key = np.append(key[order], np.iinfo(np.int64).max)
        p = np.append(found.column("p").to_numpy()[order], np.nan).astype(np.float64)
        back = np.append(found.column("back").to_numpy()[order], np.nan).astype(np.float64)

        def look(names):
            at = np.searchsorted(key, names)
            return np.where(key[at] == names, at, len(key) - 1)

        def log_p(grams):
            prob = np.full(len(grams), unseen)
            for k in range(1, ORDER + 1):
                if k > 1:
                    weight = back[look(keys(grams[:, ORDER - k:ORDER - 1]))]
                    prob *= np.where(np.isnan(weight), 1, weight)
                own = p[look(keys(grams[:, ORDER - k:]))]
                prob = np.where(np.isnan(own), prob, own)
            return np.log(prob)

        # 5-grams of the block met so far
        known, known_log = np.array([np.iinfo(np.int64).max]), np.zeros(1)
        out = []
        for rows in parts.column("rows"):
            for b in pa.ipc.open_stream(rows.as_buffer()):
                n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                for lo, data, offs in R.chunks(b.column("text"), CHUNK_BYTES):
                    name, grams, which, first = distinct(data, offs)
                    new = np.flatnonzero(known[np.searchsorted(known, name)] != name)
                    if len(new):
                        known, at = np.unique(np.concatenate([known, name[new]]), return_index=True)
                        known_log = np.concatenate([known_log, log_p(grams[new])])[at]
                    full = np.flatnonzero(np.diff(first) > 0)
                    n[lo:lo + len(first) - 1] = np.diff(first)
                    if len(full):
                        total[lo + full] = np.add.reduceat(known_log[np.searchsorted(known, name)][which], first[:-1][full])
                out.append(pa.table([b.column("doc_id"), b.column("lang"), pa.array(n), pa.array(total)], names=["doc_id", "lang", "n_symbols", "log_prob"]))
        return pa.concat_tables(out)
    return run


def _listed(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))).select([0, 1])
    return run


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of each table written here go when it is written, not at some later garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    if was is not None:         # where Spark knows the setting
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is not None:
            spark.conf.set(name, was)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
          good: str = "quality", quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols, log_prob, perplexity, threshold, kept."""
    ship_code()
    d = pick(docs, doc_id=doc_id, lang=lang, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    trusted = cut_lineage(pick(labels, doc_id=doc_id, good=good).where("good > 0 and doc_id is not null").select("doc_id").distinct())
    # texts that are surely not trusted stay where they are; the trusted ids grow with the labels, so the rest is merged at every size
    some = d.select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(_listed(bitmap(trusted, "doc_id")), f"doc_id {kind}, text string")
    with _tidy(docs.sparkSession):
        model, unseen = train(some.join(trusted.hint("merge"), "doc_id", "left_semi").select("text"))
    found = d.mapInArrow(_wanted(2, block_bytes), "block long, key long").join(model.hint("merge"), "key").select("block", "key", F.col("p").cast("float").alias("p"), F.col("back").cast("float").alias("back"))
    # as many tasks as the text needs, whatever the session's setting
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(slots(docs.sparkSession), -(-size // SHARD_TEXT))
    dealt = d.mapInArrow(_dealt(2, block_bytes), "block long, rows binary").repartition(tasks, "block")
    found = found.repartition(tasks, "block")
    scored = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _scored(unseen), f"doc_id {kind}, lang string, n_symbols long, log_prob double")
    return judge(scored, trusted, quantile)
