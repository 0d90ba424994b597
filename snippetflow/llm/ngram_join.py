"""N-gram Jaccard join: near duplicates by rare-first prefix filtering (operator 4).

A document is the set of its distinct word shingles, known by 64-bit hashes.
Documents of equal sets form a class; classes are joined, not their copies.

1. Order.  Shingles that lie in more than ``often`` prefixes are counted over all
   documents; the ``most`` most frequent (8 MB at the default) come last, by
   frequency, all others first, by hash.  Any such order gives the whole result, so the bound
   on the table only costs time.
2. Candidates.  Two sets of Jaccard similarity t or more share a shingle among the first
   ``n - ceil(t n) + 1`` of each in that order.  Prefix shingles are sent to shards of their
   hash; classes that meet under one are compared by length and by position.  Pairs are listed
   while a shingle has no more than ``each`` of them for a class; one that has more
   links its classes by a forest of them, so what is sent never grows with the square of its classes.
3. Sketches.  A set's sketch has, for each of as many cells of its hashes as it has shingles or more, whether the
   number of its shingles there is odd; two sketches differ in no more cells than their sets in
   shingles.  A listed pair whose sketches differ in too many cells goes, before it can link unlike documents.
4. Clusters.  Connected candidates are verified together, each pair once: within a cluster the
   sets' shingles are ordered by their frequency there, pairs that share a prefix
   shingle pass the length, positional and suffix filters, and the rest are intersected.
   A cluster of more than ``block`` classes is split into cells by length and hash, and each
   pair of cells that can hold a link is a task of its own.

Verified links give the components (large star, small star) and each document's number
of links; links between classes are summed where they are found, never listed.

Defined cases: null, empty or wordless text has no shingles, no links and its own component;
repeated rows are copies of each other; null ids never name a component that has another
id; an empty table gives no rows; only the named columns are read by ``near_groups``, all
are kept by ``drop_near_copies``.  Rows are known by their position in the
scan, so the input must be a table that is read alike each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import bit_of, bitmap, components, pick, ship_code, slots
from snippetflow.session import cut_lineage

WORDS = 5
PERCENT = 80
OFTEN = 8
MOST = 500_000
BLOCK = 512
EACH = 4
SKETCH = 256              # cells of a sketch at least
BUCKET_BYTES = 8 << 20
PAIRS = 1_000_000         # entries compared at a time
SHARD_TEXT = 32 << 20
POST = np.dtype([("t", "<u8"), ("k", "<u8"), ("n", "<u4"), ("at", "<u4")])


def sets(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, _, _, first = R.word_hashes(data, offs, R.NOT_SPACE)
    grams = R.gram_hashes(h, words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a:b - words + 1])
        elif b > a:
            # the whole sequence as one; a longer length than its own keeps it apart from shingles
            yield R.gram_hashes(h[a:b], b - a)
        else:
            yield grams[:0]


def class_key(s: np.ndarray) -> int:
    x = int(R.mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)) + int(R.mix(s).sum(dtype=np.uint64)) * int(R.MULT) + len(s)
    return int(R.mix(np.array([x % (1 << 64)], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """One bit for each cell of the set's hashes: whether it holds an odd number of them."""
    cells = max(SKETCH, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In so many shingles at least the sets of two sketches differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):             # half as many cells: two cells of the longer one are one
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _classes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, bits = [], [], []
            for _, data, offs in R.chunks(b.column(2)):
                for s in sets(data, offs, words):
                    n.append(len(s))
                    key.append(class_key(s) if len(s) else None)
                    bits.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bits, pa.binary())],
                                             names=["row", "doc_id", "n", "k", "sketch"])
    return run


def _shards(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(a: np.ndarray, h: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """a as one row for each shard of h."""
    shard = _shards(R.mix(h), n_shards)        # prefixes hold small hashes: mixed, they are even again
    by = np.argsort(shard, kind="stable")
    a, cut = a[by], np.searchsorted(shard[by], np.arange(n_shards + 1))
    full = np.flatnonzero(np.diff(cut) > 0)
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([a[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())], names=["shard", "load"])


def _prefix_counts(words: int, percent: int, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, parts = set(), []
            for _, data, offs in R.chunks(b.column(0)):
                for s in sets(data, offs, words):
                    if len(s) and (key := class_key(s)) not in seen:
                        seen.add(key)
                        parts.append(s[:prefix_size(len(s), percent)])
            if parts:
                t, n = np.unique(np.concatenate(parts), return_counts=True)
                # those met once as such, the others once for each time
                t = np.repeat(t, n)
                yield _packed(t, t, n_shards)
    return run


def _frequent(often: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("load").to_pylist()])
        t, n = np.unique(t, return_counts=True)
        t, n = t[n > often], n[n > often]
        return pa.table({"t": pa.array(t.view(np.int64)), "n": pa.array(n, pa.int64())})
    return run


def in_order(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The sorted set s in rare-first order."""
    if not len(hot):
        return s
    place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    late = np.where(hot[place] == s, rank[place], 0)
    return s[np.lexsort((s, late))] if late.any() else s


def _postings(words: int, percent: int, n_shards: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for b in batches:
            seen, parts, keys, sizes, lens = set(), [], [], [], []
            for _, data, offs in R.chunks(b.column(0)):
                for s in sets(data, offs, words):
                    if len(s) and (key := class_key(s)) not in seen:
                        seen.add(key)
                        p = in_order(s, hot, rank)[:prefix_size(len(s), percent)]
                        parts.append(p)
                        keys.append(key)
                        sizes.append(len(s))
                        lens.append(len(p))
            if not parts:
                continue
            lens = np.array(lens)
            a = np.empty(int(lens.sum()), POST)
            a["t"] = np.concatenate(parts)
            a["k"] = np.repeat(np.array(keys, np.int64).view(np.uint64), lens)
            a["n"] = np.repeat(np.array(sizes), lens)
            a["at"] = R.ranges(np.zeros(len(lens), np.int64), lens)
            yield _packed(a, a["t"], n_shards)
    return run


def _blocks(left: np.ndarray) -> list[tuple[int, int]]:
    """Cuts entries that meet ``left`` others each into runs of about PAIRS meetings."""
    if not len(left):
        return []
    at = np.searchsorted(np.cumsum(left), np.arange(0, int(left.sum()) + PAIRS, PAIRS))
    cuts = np.unique(np.concatenate([[0], at, [len(left)]])).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def meetings(n: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries that pass the length and the positional filter, a bounded number at a time: those of the same
    shingle, whose entries begin at ``first`` and are in order of n, the set's length; ``at`` is the shingle's place in the set."""
    # the first shared place of similar sets leaves the longer set at most this long, and the shorter one
    most = (100 * n - (100 + percent) * at) // percent
    group = np.repeat(np.arange(len(first)), size)
    end = np.searchsorted(group * (1 << 34) + n, group * (1 << 34) + np.clip(most, 0, (1 << 33)), side="right")
    left = np.maximum(0, end - np.arange(len(n)) - 1)
    for u, v in _blocks(left):
        i = np.repeat(np.arange(u, v), left[u:v])
        j = R.ranges(np.arange(u, v) + 1, left[u:v])
        ok = n[i] <= most[j]
        yield i[ok], j[ok]


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least entry that each entry reaches, with the pairs (x, y) besides what ``root`` has."""
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def _candidates(percent: int, each: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x, POST) for x in table.column("load").to_pylist()])
        a = a[np.lexsort((a["k"], a["n"], a["t"]))]
        same = np.zeros(len(a), bool)
        same[1:] = (a["t"][1:] == a["t"][:-1]) & (a["k"][1:] == a["k"][:-1])
        a = a[~same]                    # copies from other batches
        first = np.flatnonzero(np.r_[True, a["t"][1:] != a["t"][:-1]]) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(a)))
        k, n, at = a["k"].view(np.int64), a["n"].astype(np.int64), a["at"].astype(np.int64)
        none = np.zeros(0, np.int64)
        pairs, forest = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]

        def add(out: list, x: np.ndarray, y: np.ndarray):
            out.append(np.unique(np.stack([np.minimum(k[x], k[y]), np.maximum(k[x], k[y])], axis=1), axis=0))

        # shingles that cannot have more pairs than are listed
        few = size <= 2 * each + 1
        f, z = first[few & (size > 1)], size[few & (size > 1)]
        i = R.ranges(f, z)
        for x, y in meetings(n[i], at[i], np.cumsum(z) - z, z, percent):
            add(pairs, i[x], i[y])
        for u, m in zip(first[~few].tolist(), size[~few].tolist(), strict=True):
            got, count, root = [(none, none)], 0, None
            for x, y in meetings(n[u:u + m], at[u:u + m], np.zeros(1, np.int64), np.array([m]), percent):
                count += len(x)
                if root is None and count <= each * m:
                    got.append((x, y))
                    continue
                if root is None:
                    root = np.arange(m)
                    for p, q in got:
                        root = joined(root, p, q)
                root = joined(root, x, y)
            if root is None:
                add(pairs, u + np.concatenate([x for x, _ in got]), u + np.concatenate([y for _, y in got]))
            else:
                far = np.flatnonzero(root != np.arange(m))
                add(forest, u + root[far], u + far)
        pairs, forest = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(forest), axis=0)
        both = np.concatenate([pairs, forest])
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "dense": pa.array(np.arange(len(both)) >= len(pairs))})
    return run


def _alike(percent: int):
    """Pairs whose sketches do not rule out that they are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy()
            gap = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(b.column(3), b.column(4), strict=True)], np.int64)
            b = b.filter(pa.array((100 + percent) * (total - gap) >= 2 * percent * total))
            yield b.select(["a", "b"])
    return run


def _sets_of(words: int, shared):
    """Texts whose bit is set -> their sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for b in batches:
            b = b.filter(pa.array(bits[b.column(1).to_numpy()] > 0))
            load = [s.tobytes() for _, data, offs in R.chunks(b.column(2)) for s in sets(data, offs, words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(load, pa.binary())], names=["row", "load"])
    return run


def similar(members: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar sets; only between sides 0 and 1 where a member is on side 0 or 1, any pair where all are on side 2."""
    n = np.array([len(m) for m in members])
    own = np.repeat(np.arange(len(members)), n)
    _, ids, df = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    # order: frequency here, then hash; shingles met once cannot link but take their places
    order = np.lexsort((ids, df[ids], own))
    sorted_ids = ids[order]
    start = np.cumsum(n) - n
    want = n - -(-percent * n // 100) + 1
    at = R.ranges(start, want)
    pos = at - np.repeat(start, want)
    who, tok = np.repeat(np.arange(len(members)), want), sorted_ids[at]
    many = df[tok] > 1
    who, tok, pos = who[many], tok[many], pos[many]
    by = np.lexsort((who, tok))
    who, tok, pos = who[by], tok[by], pos[by]
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(tok)))
    gone = np.zeros(0, np.int64)
    codes = [gone]
    # each place meets the later places of its shingle, a bounded number of entries at a time
    left = np.repeat(first + size, size) - np.arange(len(tok)) - 1
    for u, v in _blocks(left):
        i = np.repeat(np.arange(u, v), left[u:v])
        j = R.ranges(np.arange(u, v) + 1, left[u:v])
        a, b = who[i], who[j]
        ok = (side[a] == 2) | (side[a] != side[b])
        small, big = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok &= 100 * small >= percent * big
        rest = 1 + np.minimum(n[a] - pos[i] - 1, n[b] - pos[j] - 1)
        ok &= (100 + percent) * rest >= percent * (n[a] + n[b])
        codes.append(np.unique(np.minimum(a, b)[ok] * len(members) + np.maximum(a, b)[ok]))
    code = np.unique(np.concatenate(codes))
    a, b = code // len(members), code % len(members)
    # suffix filter: the sets' counts in 32 ranges of the order bound what they can share
    part = (ids * 32) // max(1, len(df))
    counts = np.zeros((len(members), 32), np.int32)
    np.add.at(counts, (own, part), 1)
    keep = np.zeros(len(a), bool)
    for u in range(0, len(a), 100_000):
        x, y = a[u:u + 100_000], b[u:u + 100_000]
        most = np.minimum(counts[x], counts[y]).sum(axis=1)
        keep[u:u + 100_000] = (100 + percent) * most >= percent * (n[x] + n[y])
    a, b = a[keep], b[keep]
    got = np.zeros(len(a), np.int64)
    mark = np.zeros(len(df), np.int64)
    rows, begin = np.unique(a, return_index=True)
    for r, u, v in zip(rows.tolist(), begin.tolist(), np.append(begin, len(a))[1:].tolist(), strict=True):
        mine = ids[start[r]:start[r] + n[r]]
        mark[mine] = 1
        for w in range(u, v, 512):
            other = b[w:min(v, w + 512)]
            where = R.ranges(start[other], n[other])
            got[w:w + len(other)] = np.add.reduceat(mark[ids[where]], np.cumsum(n[other]) - n[other])
        mark[mine] = 0
    yes = 100 * got >= percent * (n[a] + n[b] - got)
    return a[yes], b[yes]


def _verify(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("k", "ascending"), ("side", "ascending")])
        task = np.array(table.column("task").to_pylist(), object)
        k = table.column("k").to_numpy()
        docs = table.column("docs").to_numpy()
        side = table.column("side").to_numpy()
        load = table.column("load").to_pylist()
        cut = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)] if len(task) else [0]
        out_k, out_links, out_to = [], [], []
        for u, v in zip(cut[:-1], cut[1:], strict=True):
            once = np.r_[True, k[u + 1:v] != k[u:v - 1]]        # a repeated row of the representative
            at = u + np.flatnonzero(once)
            a, b = similar([np.frombuffer(load[i], np.uint64) for i in at], side[at], percent)
            links = np.zeros(len(at), np.int64)
            np.add.at(links, a, docs[at[b]])
            np.add.at(links, b, docs[at[a]])
            root = list(range(len(at)))

            def find(i: int, root=root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
            met = np.flatnonzero(links)
            out_k.append(k[at[met]])
            out_links.append(links[met])
            out_to.append(k[at[[find(i) for i in met.tolist()]]] if len(met) else k[:0])
        none = np.zeros(0, np.int64)
        return pa.table({"k": pa.array(np.concatenate([none, *out_k])), "links": pa.array(np.concatenate([none, *out_links])),
                         "to": pa.array(np.concatenate([none, *out_to]))})
    return run


def _tasks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(k, docs, n, row, task, side): each class in each pair of cells it belongs to."""
    step = float(np.log(100 / percent))
    m = members.withColumn("len", F.floor(F.log("n") / step + 1e-9).cast("int"))
    cells = m.groupBy("cluster", "len").agg(F.count(F.lit(1)).alias("size"))
    total = cells.groupBy("cluster").agg(F.sum("size").alias("total"))
    cells = cut_lineage(cells.join(total, "cluster").withColumn("cells", F.ceil(F.col("size") / block).cast("int")))
    small = m.join(total.where(F.col("total") <= block), "cluster", "left_semi").select(
        "k", "docs", "n", "row", F.concat_ws(":", "cluster").alias("task"), F.lit(2).alias("side"))
    big = cells.where(F.col("total") > block)

    def beside(by: int, name: str) -> DataFrame:
        return big.select("cluster", (F.col("len") - by).alias("len"), F.col("cells").alias(name))

    x = m.join(big.select("cluster", "len", "cells"), ["cluster", "len"]).join(beside(1, "up"), ["cluster", "len"], "left").join(
        beside(-1, "down"), ["cluster", "len"], "left")
    x = x.withColumn("cell", F.pmod(F.xxhash64("k"), F.col("cells")).cast("int"))

    def span(col: str):
        return F.when(F.coalesce(F.col(col), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(col) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def task(l1, c1, l2, c2):
        return F.concat_ws(":", "cluster", l1, c1, l2, c2)

    up, down = F.col("len") + 1, F.col("len") - 1
    targets = F.concat(
        F.transform(span("cells"), lambda c: F.struct(
            task(F.col("len"), F.least(c, F.col("cell")), F.col("len"), F.greatest(c, F.col("cell"))).alias("task"),
            F.when(c == F.col("cell"), 2).when(F.col("cell") < c, 0).otherwise(1).alias("side"))),
        F.transform(span("up"), lambda c: F.struct(task(F.col("len"), F.col("cell"), up, c).alias("task"), F.lit(0).alias("side"))),
        F.transform(span("down"), lambda c: F.struct(task(down, c, F.col("len"), F.col("cell")).alias("task"), F.lit(1).alias("side"))))
    return small.union(x.select("k", "docs", "n", "row", F.explode(targets).alias("t")).select("k", "docs", "n", "row", "t.task", "t.side"))


def _edges(posts: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int, each: int) -> DataFrame:
    """(a, b): classes that may be similar, or that a forest of a shingle with very many pairs links."""
    pairs = posts.groupBy("shard").applyInArrow(_candidates(percent, each), "a long, b long, dense boolean")
    pairs = cut_lineage(pairs.groupBy("a", "b").agg(F.max("dense").alias("dense")))
    listed = pairs.where("not dense").select("a", "b")
    ends = listed.select(F.col("a").alias("k")).union(listed.select("b")).distinct()
    # merged at every size: the sketches grow with the documents
    met = cut_lineage(classes.join(ends.hint("merge"), "k").select("k", "n", "row").join(sketches.hint("merge"), "row").select("k", "n", "sketch"))

    def of(name: str) -> DataFrame:
        return met.select(F.col("k").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    wide = listed.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select("a", "b", F.expr("n_a + n_b"), "sketch_a", "sketch_b")
    return wide.mapInArrow(_alike(percent), "a long, b long").union(pairs.where("dense").select("a", "b"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT,
                often: int = OFTEN, most: int = MOST, block: int = BLOCK, each: int = EACH) -> DataFrame:
    """row, doc_id, n_shingles, component_id, n_links (documents linked with it) and
    stays (the first document of its component) of each row."""
    ship_code()
    spark = docs.sparkSession
    d = pick(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    kind = d.schema["doc_id"].dataType.simpleString()
    t = cut_lineage(d.select("row", "doc_id", "text").mapInArrow(_classes(words), f"row long, doc_id {kind}, n long, k long, sketch binary"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(slots(spark), -(-total // SHARD_TEXT))
    counts = d.select("text").mapInArrow(_prefix_counts(words, percent, n), "shard int, load binary")
    hot = counts.groupBy("shard").applyInArrow(_frequent(often), "t long, n long").orderBy(F.desc("n"), "t").limit(most).toArrow()
    hot_t, hot_n = hot.column("t").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    by = np.argsort(hot_t)
    shared = spark.sparkContext.broadcast((hot_t[by], hot_n[by]))
    posts = d.select("text").mapInArrow(_postings(words, percent, n, shared), "shard int, load binary")
    classes = t.where("n > 0").groupBy("k").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("docs"),
                                                F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "row")).alias("best"))
    classes = cut_lineage(classes.select("k", "n", "docs", F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row")))
    clusters = components(_edges(posts, classes, t.select("row", "sketch"), percent, each))
    members = cut_lineage(classes.join(clusters.withColumnRenamed("node", "k").withColumnRenamed("comp", "cluster"), "k"))
    # only documents that may be members send their sets; the join leaves the members
    maybe = spark.sparkContext.broadcast(bitmap(members, "row"))
    loads = d.select("row", bit_of("row").alias("bit"), "text").mapInArrow(_sets_of(words, maybe), "row long, load binary")
    tasks = cut_lineage(_tasks(members, percent, block))
    # as many buckets of tasks as the sets to be sent need, however often each is sent
    buckets = max(slots(spark), -(-(tasks.agg(F.sum(F.col("n") * 8)).first()[0] or 0) // BUCKET_BYTES))
    # merged at every size: the tasks grow with the documents
    found = tasks.hint("merge").join(loads, "row").withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets))).select("bucket", "task", "k", "docs", "side", "load")
    found = cut_lineage(found.groupBy("bucket").applyInArrow(_verify(percent), "k long, links long, to long"))
    comps = components(found.select(F.col("k").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "k")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    c = classes.join(comps, "k", "left").join(links, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    c = cut_lineage(c.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("docs") - 1))
    first = c.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "row")).alias("first"))
    c = c.join(first, "comp").select("k", "n_links", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    out = t.drop("sketch").join(c, "k", "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), ((F.col("n") == 0) | (F.col("row") == F.col("first_row"))).alias("stays"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each component, with all its columns."""
    gone = cut_lineage(near_groups(docs, text, doc_id, **options).where("not stays").select(F.col("row").alias("_row")))
    names = docs.columns
    rows = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    # merged at every size: what goes grows with the documents
    return rows.join(gone.hint("merge"), "_row", "left_anti").drop("_row").toDF(*names)
