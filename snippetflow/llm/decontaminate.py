"""Benchmark decontamination by winnowing (operator 10).

Words are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z lower-cased, known by 64-bit hashes.  For a window of L words, k-grams with
k = (L + 1) // 2 are hashed and the minimum of each L - k + 1 consecutive hashes
is kept, on the benchmark's side and on the documents' side alike, so every
shared run of L words has a kept hash in common.  Documents' kept hashes are
joined with the benchmark's, and each hit is extended word by word to the
longest shared run; a run of at least L words marks its document words as hit
and its item as found.  Items of fewer than 13 words are one window of their own
length; each such length is one more (k, window) pair.

The benchmark is joined by broadcast in blocks of at most ``block_words`` words
(16 MB of hashes), split by item, one pass over the documents per block; its
size is measured first.  Documents never leave their tasks.

Defined cases: null or wordless text has no words, no hits and is clean; a
benchmark row that is null or wordless is no item; repeated item ids count once;
null item ids mark words but are not listed; ties among minimal hashes keep all
places; empty tables give empty or all-clean results; only the named columns are
read, the others pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, position, ship_code
from snippetflow.session import cut_lineage

WINDOW = 13
BLOCK_WORDS = 2_000_000
OUT = "n_words long, spans binary, items array<string>"


def _gram(length: int) -> tuple[int, int]:
    k = (length + 1) // 2
    return k, length - k + 1


def winnow(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams kept; ``first``: first word of each row."""
    k, w = _gram(length)
    g = R.gram_hashes(h, k)
    if len(g) < w:
        return np.zeros(0, np.int64), g[:0]
    low = R.sliding_min(g, w)
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(low))
    whole = at + length <= row_end[:len(low)]
    keep = np.zeros(len(g), bool)
    for j in range(w):
        hit = whole & (g[j:j + len(low)] == low)
        keep[j:j + len(low)] |= hit
    places = np.flatnonzero(keep)
    return places, g[places]


class Shard:
    """One block of the benchmark: its word hashes and kept k-grams by length."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.ids = [i for i, _ in items]
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum([len(w) for _, w in items])]).astype(np.int64)
        self.need = np.minimum(np.diff(self.first), window)
        self.families = []
        for length in sorted({int(x) for x in self.need}):
            places, hashes = [], []
            for i in np.flatnonzero(self.need == length):
                a, b = self.first[i], self.first[i + 1]
                p, g = winnow(self.words[a:b], np.array([0, b - a]), length)
                places.append(p + a)
                hashes.append(g)
            p, g = np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(g, kind="stable")
            p, g = p[order], g[order]
            maybe = np.zeros(1 << 20, bool)
            maybe[(g >> np.uint64(44)).astype(np.int64)] = True
            self.families.append((length, g, p, maybe))

    @staticmethod
    def _steps(places: np.ndarray, rows: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
        """How far before each place the same k-gram was last kept in its row; 0 where that is over k words."""
        step = np.zeros(len(places), np.int64)
        order = np.lexsort((places, group))
        a, b = order[:-1], order[1:]
        near = (group[a] == group[b]) & (rows[a] == rows[b]) & (places[b] - places[a] <= k)
        step[b[near]] = (places[b] - places[a])[near]
        return step

    def _begins(self, q: np.ndarray, step: int) -> list[int]:
        """The places of a k-gram that a document's place must be extended from, if the same k-gram came ``step``
        words before in the document: not those that have it ``step`` words before as well, since a run over
        both reaches here.  So repeated words cost as many steps as there are words, not pairs of them."""
        if step:
            item = lambda x: np.searchsorted(self.first, x, "right")
            q = q[~(np.isin(q - step, q) & (item(q - step) == item(q)))]
        return q.tolist()

    def hits(self, h: np.ndarray, first: np.ndarray):
        """Yields (row, from word, to word, item) of each shared run."""
        done: dict[tuple[int, int, int], int] = {}
        for length, g, p, maybe in self.families:
            places, kept = winnow(h, first, length)
            near = maybe[(kept >> np.uint64(44)).astype(np.int64)]
            places, kept = places[near], kept[near]
            lo = np.searchsorted(g, kept, "left")
            hi = np.searchsorted(g, kept, "right")
            met = hi > lo
            places, lo, hi = places[met], lo[met], hi[met]
            rows = np.searchsorted(first, places, "right") - 1
            step = self._steps(places, rows, lo, _gram(length)[0])
            begins: dict[tuple[int, int], list[int]] = {}
            for i, row, a, b, d in zip(places.tolist(), rows.tolist(), lo.tolist(), hi.tolist(), step.tolist(), strict=True):
                if (a, d) not in begins:
                    begins[a, d] = self._begins(p[a:b], d)
                for q in begins[a, d]:
                    item = int(np.searchsorted(self.first, q, "right")) - 1
                    key = (row, item, i - q)
                    if done.get(key, -1) > i:
                        continue
                    back = min(i - int(first[row]), q - int(self.first[item]))
                    ahead = min(int(first[row + 1]) - i, int(self.first[item + 1]) - q)
                    same = h[i - back:i][::-1] == self.words[q - back:q][::-1]
                    left = back if same.all() else int(same.argmin())
                    same = h[i:i + ahead] == self.words[q:q + ahead]
                    right = ahead if same.all() else int(same.argmin())
                    done[key] = max(i + 1, i + right)
                    if left + right >= length:
                        yield row, i - left, i + right, item


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, data, offs in R.chunks(b.column(1)):
            h, _, _, first = R.word_hashes(data, offs, R.ALNUM)
            out += [h[first[i]:first[i + 1]].tobytes() for i in range(len(first) - 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([len(x) // 8 for x in out], pa.int64())],
                                         names=["item_id", "words", "n"])


def benchmark_blocks(benchmark: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[list]:
    """The benchmark's items, in lists of about ``block_words`` words."""
    ship_code()
    b = pick(benchmark, item_id=item_id, text=text).select(F.col("item_id").cast("string").alias("item_id"), "text")
    t = cut_lineage(b.mapInArrow(_benchmark_words, "item_id string, words binary, n long").where("n > 0"))
    total = t.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        rows = t.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).orderBy("item_id", "words").collect()
        yield [(r.item_id, np.frombuffer(r.words, np.uint64)) for r in rows]


def _scan(shard, text_at: int):
    """Arrow function: the rows with n_words, spans (pairs of words, packed) and items added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shard.__new__(Shard)
        s.__dict__.update(shard.value)
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            spans: list[list] = [[] for _ in range(b.num_rows)]
            items: list[set] = [set() for _ in range(b.num_rows)]
            for lo, data, offs in R.chunks(b.column(text_at)):
                h, _, _, first = R.word_hashes(data, offs, R.ALNUM)
                n_words[lo:lo + len(offs) - 1] = np.diff(first)
                for row, x, y, item in s.hits(h, first):
                    spans[lo + row].append((x - first[row], y - first[row]))
                    if s.ids[item] is not None:
                        items[lo + row].add(s.ids[item])
            had = b.schema.names
            if "spans" in had:
                for i, (old, more) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)):
                    spans[i] += np.frombuffer(old, np.int64).reshape(-1, 2).tolist()
                    items[i].update(more)
            extra = [pa.array(n_words), pa.array([np.array(x, np.int64).tobytes() for x in spans], pa.binary()),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            own = [c for c in had if c not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + extra, names=[*own, "n_words", "spans", "items"])
    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """spans -> n_hit: words under at least one span."""
    for b in batches:
        hit = []
        for x in b.column("spans").to_pylist():
            n, end = 0, 0
            for a, z in sorted(np.frombuffer(x, np.int64).reshape(-1, 2).tolist()):
                n += max(0, z - max(a, end))
                end = max(end, z)
            hit.append(n)
        names = [c for c in b.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(hit, pa.int64())], names=[*names, "n_hit"])


def _ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated; with ``keep``,
    all columns of ``docs`` (as _c0, _c1, ...) stand in place of doc_id."""
    sc = docs.sparkSession.sparkContext
    if keep:
        df = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
        at = position(docs, text)
    else:
        df, at = pick(docs, doc_id=doc_id, text=text), 1
    own = [c for c in df.columns if keep or c != "text"]
    n = 0
    for items in benchmark_blocks(benchmark, item_text, item_id, block_words):
        if n:
            df = cut_lineage(df)
        shard = sc.broadcast(vars(Shard(items, window)))
        # between blocks the text stays with the row; the last block's text is dropped below
        df = df.mapInArrow(_scan(shard, at), _ddl(df, *[c for c in df.columns if c not in ("n_words", "spans", "items")]) + ", " + OUT)
        n += 1
    df = df.select(*own, "n_words", "spans", "items")
    df = df.mapInArrow(_covered, _ddl(df, *own) + ", n_words long, items array<string>, n_hit long")
    return df.select(*own, "n_words", "n_hit", "items",
                     F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    names = docs.columns
    out = contamination(docs, benchmark, keep=True, **options).where("not contaminated")
    return out.select(*(f"_c{i}" for i in range(len(names)))).toDF(*names)
