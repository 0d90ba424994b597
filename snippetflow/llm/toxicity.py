"""Toxic spans by a linear-chain conditional random field (operator 1).

A token's state is clean or toxic.  Its features are the word and its first
4, 5, 6 and 7 bytes; transitions are free.  Labels are given for documents
only, so tokens are labelled from them first: a feature that is significantly more
frequent in toxic than in clean training documents marks its tokens in toxic
documents as toxic, all others are clean.  The field is then fitted by gradient steps on the
conditional likelihood, the expectations coming from forward-backward.  Scoring
runs forward-backward over every whole text: the marginals give toxic spans
and, through a logistic fit on the same sample, the document's score.

The fit uses at most ``sample`` toxic and half as many more clean labelled
documents, chosen by the hash of the id, with their words as hashes; class counts cover all labels.
Forward and backward passes are ratios of two states, which one token maps by a
fraction (p x + q) / (r x + s); such maps compose, so blocks of tokens are
combined with array operations and no sequence is cut.

Defined cases: null or wordless text gets the score of a document without any
toxic mark; a document labelled more than once is toxic if any label says so;
null labels are ignored; without labels of both classes every score is the
share of toxic labels (0 without labels); repeated rows give a row each; an
empty table gives no rows; extra columns are ignored by ``score`` and kept by
``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, position, ship_code
from snippetflow.session import cut_lineage

SAMPLE = 1000
PREFIXES = (4, 5, 6, 7)
ROUNDS = 30
PURE, SURE, OFTEN = 0.9, 16.0, 10
BLOCK = 128
SPANS = "array<struct<start:int,end:int,score:double>>"


def features(data: np.ndarray, offs: np.ndarray):
    """(features of each word, start, end, first word of each row)."""
    start, end, first = R.words(data, offs, R.ALNUM)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), start, end, first
    prefix = R.prefix_hash(data, R.FOLDED_VALUES)
    cols = [R.span_hash(prefix, start, end)]
    for n in PREFIXES:
        cut = np.minimum(start + n, end)
        h = R.span_hash(prefix, start, cut) ^ np.uint64(n)
        cols.append(np.where(end - start > n, h, np.uint64(0)))
    return np.stack(cols, axis=1), start, end, first


def chain(e: np.ndarray, a: np.ndarray, start: np.ndarray, s0: float) -> np.ndarray:
    """x[t] = e[t] (a01 + a11 x[t-1]) / (a00 + a10 x[t-1]), and e[t] s0 at starts."""
    n = len(e)
    if not n:
        return e
    pad = -n % BLOCK
    e2 = np.concatenate([e, np.ones(pad)]).reshape(-1, BLOCK).T
    new = np.concatenate([start, np.zeros(pad, bool)]).reshape(-1, BLOCK).T
    p = np.where(new, 0.0, e2 * a[1, 1])
    q = np.where(new, e2 * s0, e2 * a[0, 1])
    r = np.where(new, 0.0, a[1, 0])
    s = np.where(new, 1.0, a[0, 0])
    blocks = e2.shape[1]
    bp, bq, br, bs = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(BLOCK):
        bp, bq, br, bs = p[j] * bp + q[j] * br, p[j] * bq + q[j] * bs, r[j] * bp + s[j] * br, r[j] * bq + s[j] * bs
        z = bp + bq + br + bs
        bp, bq, br, bs = bp / z, bq / z, br / z, bs / z
    x = np.empty(blocks)
    v = 0.0
    for k, (pp, qq, rr, ss) in enumerate(zip(bp.tolist(), bq.tolist(), br.tolist(), bs.tolist(), strict=True)):
        x[k] = v
        v = (pp * v + qq) / (rr * v + ss)
    out = np.empty_like(e2)
    for j in range(BLOCK):
        x = (p[j] * x + q[j]) / (r[j] * x + s[j])
        out[j] = x
    return out.T.ravel()[:n]


def marginals(u: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """(P(toxic) of each token, forward ratios, backward ratios times e)."""
    n = len(u)
    e = np.exp(np.clip(u, -25, 25))
    rows = first[:-1][np.diff(first) > 0]
    begin = np.zeros(n, bool)
    begin[rows] = True
    finish = np.zeros(n, bool)
    finish[first[1:][np.diff(first) > 0] - 1] = True
    a = np.exp(trans)
    f = chain(e, a, begin, 1.0)
    c = chain(e[::-1], a.T, finish[::-1], 1.0)[::-1]
    odds = f * c / e
    return odds / (1 + odds), f, c


class Model:
    """Weights of the known features, bias, transitions and the document score's coefficients."""

    def __init__(self, keys=None, weights=None, bias=0.0, trans=None, doc=(0.0, 0.0, 0.0), constant=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.weights = np.zeros(0) if weights is None else weights
        self.bias, self.trans, self.doc, self.constant = bias, np.zeros((2, 2)) if trans is None else trans, doc, constant
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def unary(self, feats: np.ndarray) -> np.ndarray:
        u = np.full(len(feats), self.bias)
        if not len(self.keys):
            return u
        for j in range(feats.shape[1]):
            at = np.flatnonzero(self.maybe[(feats[:, j] >> np.uint64(44)).astype(np.int64)])
            f = feats[at, j]
            place = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[place] == f
            u[at[hit]] += self.weights[place[hit]]
        return u

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each row from its tokens' marginals."""
        n = len(first) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        return 1 / (1 + np.exp(-(document_features(p, first) @ np.array(self.doc))))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(first) - 1
    top, total = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
        total[full] = np.add.reduceat(np.where(p > 0.05, p, 0.0), first[:-1][full])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(total), np.ones(n)], axis=1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, data, offs in R.chunks(b.column(1)):
            f, _, _, first = features(data, offs)
            out += [f[first[i]:first[i + 1]].tobytes() for i in range(len(first) - 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["toxic", "words"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that are not held out."""
    ship_code()
    y = pick(labels, doc_id=doc_id, toxic=toxic).where("toxic is not null and doc_id is not null")
    y = y.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    y = cut_lineage(y)
    n = {r.toxic: r.n for r in y.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(constant=float(n.get(1, 0) > 0))
    order = F.xxhash64("doc_id")
    chosen = y.where("toxic = 1").orderBy(order, "doc_id").limit(sample).union(
        y.where("toxic = 0").orderBy(order, "doc_id").limit(3 * sample // 2))
    chosen = cut_lineage(chosen)     # at most 2.5 * sample ids
    rows = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    got = rows.mapInArrow(_sampled, "toxic int, words binary").toArrow()
    words = [np.frombuffer(w.as_buffer(), np.uint64).reshape(-1, 1 + len(PREFIXES)) for w in got.column("words")]
    truth = np.array(got.column("toxic").to_pylist(), np.int64)
    if len(set(truth.tolist())) < 2:
        return Model(constant=float(truth.mean() if len(truth) else 0.0))
    # in an order of their own, whatever order they came in
    order = np.lexsort(([w[0, 0] if len(w) else 0 for w in words], [len(w) for w in words], truth))
    words, truth = [words[i] for i in order], truth[order]
    del got
    return fit_sample(words, truth, n[1] / (n[0] + n[1]))


def fit_sample(words: list[np.ndarray], truth: np.ndarray, share: float) -> Model:
    """Fit on the words' features of each document (the list is emptied) and its label;
    ``share``: the toxic share of all labels."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), np.diff(first))
    keys = np.unique(np.concatenate([np.unique(w) for w in words]))
    idx = np.concatenate([np.searchsorted(keys, w).astype(np.int32) for w in words])
    # documents of each class that hold each feature
    pairs = np.concatenate([np.unique(idx[a:b]).astype(np.int64) * len(words) + i for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))])
    kind, pairs = truth[pairs % len(words)], pairs // len(words)
    df1 = np.bincount(pairs, kind, len(keys))
    df0 = np.bincount(pairs, 1 - kind, len(keys))
    words.clear()
    del pairs, kind
    rate1, rate0 = (df1 + 0.05) / (truth.sum() + 1), (df0 + 0.05) / ((1 - truth).sum() + 1)
    # log-likelihood ratio against the same frequency in both classes: chance alone must be out of question
    mean = truth.mean()
    gain = 2 * (df1 * np.log((df1 + 1e-9) / ((df0 + df1) * mean)) + df0 * np.log((df0 + 1e-9) / ((df0 + df1) * (1 - mean))))
    marks = (rate1 / (rate1 + rate0) >= PURE) & (gain >= SURE) & (keys != 0)
    used = (df0 + df1 >= 3) & (keys != 0)
    # a word seen often enough speaks for itself, a rarer one through its first bytes
    own = (df0 + df1)[idx[:, 0]] >= OFTEN
    y = np.where(own, marks[idx[:, 0]], marks[idx].any(axis=1)) & (truth[doc] == 1)
    keep = np.flatnonzero(used)
    to = np.full(len(keys), len(keep), np.int32)
    to[keep] = np.arange(len(keep))
    idx = to[idx]
    at = [np.flatnonzero(idx[:, j] < len(keep)).astype(np.int32) for j in range(idx.shape[1])]
    known = [idx[a, j] for j, a in enumerate(at)]
    keys = keys[keep]
    del idx, df0, df1, rate0, rate1, gain, marks, used, own, doc

    def unary() -> np.ndarray:
        u = np.full(first[-1], bias)
        for a, k in zip(at, known, strict=True):
            u[a] += w[k]
        return u

    w, bias, trans = np.zeros(len(keep) + 1), -3.0, np.zeros((2, 2))
    sq, sq_b, sq_t = np.full(len(keep) + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    inner = np.ones(first[-1], bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    inner = np.flatnonzero(inner)
    for _ in range(ROUNDS):
        p, f, c = marginals(unary(), trans, first)
        g = sum(np.bincount(k, (y - p)[a], len(keep) + 1) for a, k in zip(at, known, strict=True)) - 0.05 * w
        gb = float((y - p).sum())
        a = np.exp(trans)
        fi, ci = f[inner], c[inner + 1]
        cells = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * ci, a[1, 0] * fi, a[1, 1] * fi * ci])
        cells /= cells.sum(axis=0)
        seen = np.bincount(2 * y[inner].astype(int) + y[inner + 1], minlength=4)
        gt = (seen - cells.sum(axis=1)).reshape(2, 2)
        sq += g * g
        sq_b += gb * gb
        sq_t += gt * gt
        w += 0.6 * g / np.sqrt(sq)
        bias += 0.6 * gb / np.sqrt(sq_b)
        trans += 0.3 * gt / np.sqrt(sq_t)
    trans -= trans[0, 0]
    held = np.abs(w[:-1]) > 1e-3
    p, _, _ = marginals(unary(), trans, first)
    x = document_features(p, first)
    # logistic fit of the document score, the classes weighted to their share among all labels
    weight = np.where(truth == 1, share / max(truth.mean(), 1e-9), (1 - share) / max(1 - truth.mean(), 1e-9))
    beta = np.zeros(3)
    for _ in range(25):
        z = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * z * (1 - z))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (weight * (truth - z)) - 0.05 * beta)
        beta += np.clip(step, -2, 2)
    return Model(keys[held], w[:-1][held], bias, trans, tuple(beta))


def _score(state, at: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.__dict__.update(state.value)
        for b in batches:
            score = np.zeros(b.num_rows)
            found: list[list] = [[] for _ in range(b.num_rows if spans else 0)]
            for lo, data, offs in R.chunks(b.column(at)):
                f, start, end, first = features(data, offs)
                p, _, _ = marginals(m.unary(f), m.trans, first)
                score[lo:lo + len(first) - 1] = m.documents(p, first)
                on = p >= 0.5
                if spans and on.any():
                    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    doc = np.searchsorted(first, np.flatnonzero(on), "right") - 1
                    last = None
                    for t, d in zip(np.flatnonzero(on).tolist(), doc.tolist(), strict=True):
                        base = point[offs[d]]
                        span = {"start": int(point[start[t]] - base), "end": int(point[end[t]] - base), "score": float(p[t])}
                        if last is not None and last[0] == t - 1 and last[1] == d:
                            own = found[lo + d][-1]
                            own["end"], own["score"] = span["end"], max(own["score"], span["score"])
                        else:
                            found[lo + d].append(span)
                        last = (t, d)
            cols, names = list(b.columns), list(b.schema.names)
            if spans:
                cols, names = [b.column(0), pa.array(score), pa.array(found, pa.list_(pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "score", "spans"]
            else:
                cols, names = [*cols, pa.array(score)], [*names, "_score"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, spans (code points, marginal) of each row."""
    ship_code()
    d = pick(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(_score(shared, 1, True), f"doc_id {kind}, score double, spans {SPANS}")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below 0.5, with all their columns."""
    ship_code()
    names = docs.columns
    df = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    at = position(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _score double"
    return df.mapInArrow(_score(shared, at, False), ddl).where("_score < 0.5").drop("_score").toDF(*names)
