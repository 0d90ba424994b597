"""Repeated substrings by a logarithmic family of sampled suffix arrays (operator 5).

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else.  Of each such window the leftmost least 50-byte gram (by hash) is its anchor;
equal windows have equal anchors at equal places, so only suffixes at anchors
need to be indexed, about one in sixty.  Each task sorts the suffixes of its
batch of documents by their first gram and the hash of all their windows: the
batch's suffix array.  Arrays are cut by ranges of the gram's hash and sent to
the shard of their range.  A shard inserts one array after the other into a family of
levels: the array is scanned against every level for suffixes of the same gram,
which marks both sides, then becomes the smallest level itself, and levels of
like size are merged, so a suffix is merged a logarithmic number of times.

Suffixes whose windows are all equal to another's are settled there.  Where a gram
has different surroundings, the surroundings are compared window by window: by shards
of grams, or, for a gram with more than ``hot`` surroundings (a line that
very many documents share), by aggregation over the windows' hashes, so that no task
ever holds such a group.  Copies within a batch are sent once.

The results are exact but for collisions of 64-bit hashes of windows.

Defined cases: null counts as empty; texts shorter than ``length`` bytes keep all;
repeated rows are repeats of each other and lose all their bytes; matches
never cross texts; windows of periodic texts that repeat themselves go too; an
empty table gives no rows; only the named columns are read.  The row key
is the position in the scan, so the input must be a table that is read alike each time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, ship_code, slots
from snippetflow.session import cut_lineage

LENGTH = 200
GRAM = 50
HOT = 20_000
SHARD_TEXT = 48 << 20       # bytes of text whose suffixes make one shard
ALL, SOME = 1, 2            # every window is repeated; windows are to be compared


def records(length: int, gram: int) -> tuple[np.dtype, np.dtype]:
    """Types of an index entry and of a settled suffix: a place within a window takes one byte where it fits."""
    place = "u1" if length - gram < 256 else "<u4"
    return (np.dtype([("g", "<u8"), ("c", "<u8"), ("row", "<u4"), ("lo", "<u4"), ("back", place), ("more", place), ("twice", "u1")]),
            np.dtype([("row", "<u4"), ("lo", "<u4"), ("more", place)]))


def anchors(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray, length: int, gram: int):
    """The sampled suffixes of a chunk of texts: (place, first window, last window,
    hash of the gram at the place), one for each run of windows of ``length``
    bytes whose leftmost least gram is at the place."""
    none = np.zeros(0, np.int64)
    per = length - gram + 1
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    n = len(data) - gram + 1
    g = R.mix((prefix[gram:] - prefix[:n]) * R.powers(n)[1])
    low = R.sliding_min(g, per)
    n = len(low)
    # windows within one text only: runs are cut at text ends and the windows across them left out
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    first = offs[:-1]
    change[first[first < n]] = True
    last = offs[1:] - length + 1
    long = (last > first)
    edge = last[long]
    change[edge[edge < n]] = True
    s = np.flatnonzero(change)
    e = np.append(s[1:], n) - 1
    row = np.searchsorted(offs, s, "right") - 1
    ok = s + length <= offs[row + 1]
    s, e = s[ok], e[ok]
    # places that are least in some window, in order
    pad = np.concatenate([np.zeros(per - 1, np.uint64), low, np.zeros(per - 1, np.uint64)])
    sel = np.flatnonzero(R.sliding_max(pad, per) == g)
    places, lo, hi = [], [], []
    while len(s):
        k = np.searchsorted(sel, s)
        p = sel[k]
        want = low[s]
        bad = g[p] != want
        while bad.any():
            k[bad] += 1
            p = sel[k]
            bad = g[p] != want
        places.append(p)
        lo.append(s)
        hi.append(np.minimum(p, e))
        more = p < e
        s, e = p[more] + 1, e[more]
    p, lo, hi = np.concatenate(places), np.concatenate(lo), np.concatenate(hi)
    order = np.argsort(lo, kind="stable")
    p, lo, hi = p[order], lo[order], hi[order]
    return p, lo, hi, g[p]


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _arrays(length: int, gram: int, n_shards: int):
    """Text batches -> the batch's suffix array, cut by shard (kind 0), and the
    suffixes settled within the batch (kind 1)."""
    entry, settled = records(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(0).to_numpy()
            base = int(rows.min())
            got = []
            for lo, data, offs in R.chunks(b.column(1)):
                prefix = R.prefix_hash(data, R.BYTE_VALUES)
                p, s, e, g = anchors(data, offs, prefix, length, gram)
                if not len(p):
                    continue
                row = np.searchsorted(offs, s, "right") - 1
                part = np.empty(len(p), entry)
                part["g"] = g
                part["c"] = R.mix(R.span_hash(prefix, s, e + length) + R.mix((p - s).astype(np.uint64) * np.uint64(1 << 20) + (e - s).astype(np.uint64)))
                part["row"] = rows[lo + row] - base
                part["lo"] = s - offs[row]
                part["back"], part["more"], part["twice"] = p - s, e - s, 0
                got.append(part)
            if not got:
                continue
            a = np.concatenate(got)
            a = a[np.lexsort((a["c"], a["g"]))]
            new = np.ones(len(a), bool)
            new[1:] = (a["g"][1:] != a["g"][:-1]) | (a["c"][1:] != a["c"][:-1])
            group = np.cumsum(new) - 1
            twice = np.bincount(group)[group] > 1
            a["twice"] = twice
            full = np.empty(int(twice.sum()), settled)
            for f in ("row", "lo", "more"):
                full[f] = a[f][twice]
            a = a[new]
            shard = shard_of(R.mix(a["g"]), n_shards)     # least hashes are small ones: mixed, they are even again
            by = np.argsort(shard, kind="stable")
            a = a[by]
            cut = np.searchsorted(shard[by], np.arange(n_shards + 1))
            filled = np.flatnonzero(np.diff(cut) > 0)
            kinds = [0] * len(filled) + [1] * bool(len(full))
            where = [*filled.tolist(), *[int(base % n_shards)] * bool(len(full))]
            load = [a[cut[k]:cut[k + 1]].tobytes() for k in filled] + [full.tobytes()] * bool(len(full))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(where, pa.int32()), pa.array([base] * len(kinds), pa.int64()),
                                              pa.array(load, pa.binary())], names=["kind", "shard", "base", "load"])
    return run


class Levels:
    """The sorted arrays of one shard; a level's entries are the first suffixes of each (gram, surroundings)."""

    def __init__(self):
        self.levels: list[np.ndarray] = []      # each sorted by (g, c), with field "at": place in the shard's entries
        self.state = np.zeros(0, np.uint8)

    def insert(self, run: np.ndarray) -> None:
        n0 = len(self.state)
        state = np.where(run["twice"] > 0, ALL, 0).astype(np.uint8)
        same_g = run["g"][1:] == run["g"][:-1]
        state[1:][same_g] |= SOME
        state[:-1][same_g] |= SOME
        known = np.zeros(len(run), bool)
        self.state = np.concatenate([self.state, state])
        for level in self.levels:
            i = np.searchsorted(level["g"], run["g"], "left")
            j = np.searchsorted(level["g"], run["g"], "right")
            met = np.flatnonzero(j > i)
            lo, hi, c = i[met].copy(), j[met].copy(), run["c"][met]
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = np.zeros(len(met), bool)
                less[open_] = level["c"][mid[open_]] < c[open_]
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            inside = lo < j[met]
            equal = inside & (level["c"][np.minimum(lo, len(level) - 1)] == c)
            self.state[n0 + met[equal]] |= ALL
            self.state[level["at"][lo[equal]]] |= ALL
            known[met[equal]] = True
            other = (j - i)[met] - equal > 0
            self.state[n0 + met[other & ~equal]] |= SOME
            # a level's suffixes of a gram that now also has other surroundings
            fresh = met[~equal]
            step = np.zeros(len(level) + 1, np.int64)
            np.add.at(step, i[fresh], 1)
            np.add.at(step, j[fresh], -1)
            self.state[level["at"][np.cumsum(step[:-1]) > 0]] |= SOME
        add = np.empty(int((~known).sum()), [("g", "<u8"), ("c", "<u8"), ("at", "<i8")])
        add["g"], add["c"], add["at"] = run["g"][~known], run["c"][~known], n0 + np.flatnonzero(~known)
        self.state[n0 + np.flatnonzero(known)] &= ~np.uint8(SOME)
        self.levels.append(add)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            two = np.concatenate([self.levels.pop(), self.levels.pop()])
            self.levels.append(two[np.lexsort((two["c"], two["g"]))])

    def surroundings(self, g: np.ndarray) -> np.ndarray:
        """How many surroundings each gram has over all levels."""
        return sum((np.searchsorted(lv["g"], g, "right") - np.searchsorted(lv["g"], g, "left") for lv in self.levels), np.zeros(len(g), np.int64))


FOUND = "row long, lo int, hi int, back int, g long, state int, hot boolean"


def _match(hot: int, entry: np.dtype, settled: np.dtype):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        family, parts, bases, done = Levels(), [], [], []
        for kind, base, load in sorted(zip(*(t.column(c).to_pylist() for c in ("kind", "base", "load")), strict=True)):
            if kind:
                f = np.frombuffer(load, settled)
                done.append((base + f["row"].astype(np.int64), f["lo"].astype(np.int64), f["more"].astype(np.int64)))
            else:
                a = np.frombuffer(load, entry)
                family.insert(a)
                parts.append(a)
                bases.append(np.full(len(a), base, np.int64))
        cols = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3)]
        n = len(cols[0])
        a = np.concatenate(parts) if parts else np.zeros(0, entry)
        base = np.concatenate(bases) if bases else np.zeros(0, np.int64)
        met = family.state > 0
        # what was settled within its batch is in cols already, unless it must also be compared
        met &= ~((a["twice"] > 0) & (family.state & SOME == 0))
        a, base, state = a[met], base[met], family.state[met].astype(np.int32)
        row = np.concatenate([cols[0], base + a["row"]])
        lo = np.concatenate([cols[1], a["lo"].astype(np.int64)])
        hi = lo + np.concatenate([cols[2], a["more"].astype(np.int64)])
        many = family.surroundings(a["g"]) > hot if len(a) else np.zeros(0, bool)
        lead = np.zeros(n, np.int64)
        return pa.table({
            "row": pa.array(row, pa.int64()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()),
            "back": pa.array(np.concatenate([lead, a["back"].astype(np.int64)]), pa.int32()),
            "g": pa.array(np.concatenate([lead, a["g"].view(np.int64)]), pa.int64()),
            "state": pa.array(np.concatenate([lead + ALL, state]), pa.int32()),
            "hot": pa.array(np.concatenate([lead > 0, many]))})
    return run


def _surroundings(length: int, n_shards: int):
    """Texts with entries to compare -> their surroundings packed by shard (hot: single windows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = R.buffers(b.column("text"))
            lists = b.column("some")
            rows = b.column("row").to_numpy()
            counts = np.diff(lists.offsets.to_numpy())
            if not counts.sum():
                continue
            e = lists.flatten()
            i = np.repeat(np.arange(b.num_rows), counts)
            lo, hi, back, g, hot, state = (np.asarray(e.field(k)) for k in ("lo", "hi", "back", "g", "hot", "state"))
            g = g.astype(np.int64).view(np.uint64)
            shard = shard_of(R.mix(g), n_shards)
            start = offs[i] + lo
            size = (hi - lo + length).astype(np.int64)
            out: list[tuple] = []
            for k in np.unique(shard[~hot]).tolist():
                m = np.flatnonzero((shard == k) & ~hot)
                at = R.ranges(start[m], size[m])
                head = np.stack([rows[i[m]], lo[m], hi[m], state[m]], axis=1).astype("<i8")
                out.append((0, k, None, None, head.tobytes(), data[at].tobytes()))
            hots, hot_row, hot_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for j in np.flatnonzero(hot).tolist():
                piece = data[start[j]:start[j] + size[j]]
                prefix = R.prefix_hash(piece, R.BYTE_VALUES)
                w = np.arange(hi[j] - lo[j] + 1)
                hots.append(R.span_hash(prefix, w, w + length).view(np.int64))
                hot_row.append(np.full(len(w), rows[i[j]]))
                hot_at.append(w + lo[j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [
                    pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.large_binary()], strict=True)], names=NAMES).cast(SENT)
            w, r, s = map(np.concatenate, (hots, hot_row, hot_at))
            if len(w):
                none = pa.nulls(len(w), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(w), np.int32)), pa.array(s.astype(np.int32)), pa.array(w, pa.int64()),
                                                  pa.array(r, pa.int64()), none, none], names=NAMES)
    return run


NAMES = ["kind", "shard", "window", "row", "head", "load"]
SENT = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("window", pa.int64()), ("row", pa.int64()), ("head", pa.binary()), ("load", pa.binary())])


def _compare(length: int):
    """A shard of surroundings -> runs of windows found at least twice."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in t.column("head").to_pylist()]
        head = np.concatenate(heads)
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("load").to_pylist()])
        row, lo, hi, state = head.T
        size = hi - lo + length
        begin = np.cumsum(size) - size
        at = R.ranges(begin, hi - lo + 1)
        own = np.repeat(np.arange(len(row)), hi - lo + 1)
        window = np.empty(len(at), np.uint64)
        edges = np.searchsorted(begin, np.arange(0, len(data) + 1, R.CHUNK_BYTES))
        cuts = np.unique(np.concatenate([edges, [0, len(begin)]]))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            b0 = begin[x]
            b1 = begin[y] if y < len(begin) else len(data)
            m = slice(*np.searchsorted(own, [x, y]))
            prefix = R.prefix_hash(data[b0:b1], R.BYTE_VALUES)
            window[m] = R.span_hash(prefix, at[m] - b0, at[m] - b0 + length)
        _, back, n = np.unique(window, return_inverse=True, return_counts=True)
        met = (n[back] > 1) & (state[own] & ALL == 0)
        s = lo[own] + at - begin[own]
        own, s = own[met], s[met]
        if not len(own):
            return pa.table({"row": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()), "hi": pa.array([], pa.int32())})
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        return pa.table({"row": pa.array(row[own[first]], pa.int64()), "lo": pa.array(s[first], pa.int32()), "hi": pa.array(s[last], pa.int32())})
    return run


def _cut_out(length: int):
    """Texts with runs of repeated windows -> what stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = R.buffers(b.column("text"))
            lists = b.column("runs")
            at = lists.offsets.to_numpy()
            e = lists.flatten()
            lo, hi = np.asarray(e.field("lo")), np.asarray(e.field("hi"))
            removed, spans, sha, kept = [], [], [], []
            for i in range(b.num_rows):
                text = data[offs[i]:offs[i + 1]]
                x, y = lo[at[i] - at[0]:at[i + 1] - at[0]], hi[at[i] - at[0]:at[i + 1] - at[0]]
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, x, 1)
                np.add.at(step, np.minimum(y + length, len(text)), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                left = text[~gone].tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha),
                                              pa.array(kept, pa.binary())], names=["row", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
                  hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table of row, doc_id, n_bytes, sha256; texts with a repeat: row, text;
    runs of repeated windows: row, lo, hi)."""
    ship_code()
    spark = docs.sparkSession
    d = pick(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = cut_lineage(d.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(slots(spark), -(-total // SHARD_TEXT))
    sent = d.select("row", "text").mapInArrow(_arrays(length, gram, n), "kind int, shard int, base long, load binary")
    found = cut_lineage(sent.groupBy("shard").applyInArrow(_match(hot, *records(length, gram)), FOUND))
    some = F.expr(f"(state & {SOME}) > 0")
    per = found.groupBy("row").agg(F.collect_list(F.when(some, F.struct("lo", "hi", "back", "g", "hot", "state"))).alias("some"))
    texts = cut_lineage(d.select("row", "text").join(per, "row"))
    packed = texts.where(F.size("some") > 0).mapInArrow(_surroundings(length, n), "kind int, shard int, window long, row long, head binary, load binary")
    packed = cut_lineage(packed)
    edges = packed.where("kind = 0").select("shard", "head", "load").groupBy("shard").applyInArrow(_compare(length), "row long, lo int, hi int")
    single = packed.where("kind = 1").select("window", "row", F.col("shard").alias("lo"))
    often = single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    windows = single.join(often, "window").select("row", "lo", F.col("lo").alias("hi"))
    runs = found.where(f"(state & {ALL}) > 0").select("row", "lo", "hi").union(edges).union(windows)
    return narrow, texts.select("row", "text"), runs


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
                 hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, null where nothing went) of each row."""
    narrow, texts, runs = repeated_runs(docs, text, doc_id, length, gram, hot)
    per = runs.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    cut = texts.join(per, "row").mapInArrow(_cut_out(length), "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not keep_text:
        cut = cut.drop("kept")
    out = narrow.join(cut, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept"] if keep_text else []))
