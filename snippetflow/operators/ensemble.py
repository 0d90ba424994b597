"""Combining predictions.

Long form: predictions of several models are stacked as (id, model, label
[, weight]) with ``unionByName`` and voted per id; no N-way join.
Wide form: when the models score the same rows in one pass, the vote is a
per-row expression and needs no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetflow.functions.cues import CueTable
from snippetflow.functions.text import CROP_CHARS, crop_head, crop_tail


def stack_predictions(preds: dict, id_col: str = "id", pred: str = "predicted_label",
                      weights: dict | None = None) -> DataFrame:
    """{model_name: DataFrame(id, pred)} -> (id, model, predicted_label[, weight])."""
    parts = []
    for name, df in preds.items():
        p = df.select(F.col(id_col).alias("id"), F.lit(name).alias("model"),
                      F.col(pred).alias("predicted_label"))
        if weights is not None:
            p = p.withColumn("weight", F.lit(float(weights[name])))
        parts.append(p)
    return reduce(lambda a, b: a.unionByName(b), parts)


def majority_vote(stacked: DataFrame) -> DataFrame:
    """A10: most frequent label per id; ties -> smallest label.

    The stacked rows are shuffled once, on ``id``; both aggregates then run
    inside that layout.  Votes per (id, label) are counted, and the winner
    is the max of ``count * 2^32 + (2^31 - 1 - label)``: one long, so both
    steps are fixed-width hash aggregates (no sort, no per-id hash map).
    """
    by_id = stacked.select("id", "predicted_label").repartition("id")
    votes = by_id.groupBy("id", "predicted_label").agg(F.count(F.lit(1)).alias("_n"))
    packed = F.col("_n") * F.lit(1 << 32) + (F.lit(LABEL_TOP) - F.col("predicted_label").cast("long"))
    best = votes.groupBy("id").agg(F.max(packed).alias("_k"))
    label = F.lit(LABEL_TOP) - F.col("_k").bitwiseAND(F.lit(0xFFFFFFFF))
    return best.select("id", label.cast("int").alias("predicted_label"))


# largest int label; (LABEL_TOP - label) maps every int label into 32 bits
LABEL_TOP = (1 << 31) - 1


def weighted_vote(stacked: DataFrame) -> DataFrame:
    """Label with the largest weight sum per id; ties -> smallest label.

    Weights are summed as decimals of nine places, so the sum does not depend
    on the order in which rows arrive and equal sums are ties.  One shuffle on
    ``id``; the winner is the max of ``sum * 2^32 + (2^31 - 1 - label)`` as one
    decimal, so both steps are fixed-width hash aggregates.  Sums must stay below 10^9;
    a weight that nine places cannot hold to a millionth of itself raises an error."""
    w, kept = F.col("weight").cast("double"), F.col("weight").cast("decimal(18,9)")
    weight = F.when(F.abs(kept.cast("double") - w) > F.abs(w) * 1e-6, F.raise_error(F.lit("a weight needs more than nine decimal places: scale the weights up")).cast(
        "decimal(18,9)")).otherwise(kept).alias("weight")
    by_id = stacked.select("id", "predicted_label", weight).repartition("id")
    s = by_id.groupBy("id", "predicted_label").agg(F.sum("weight").alias("_w"))
    units = (F.col("_w") * F.lit(10 ** 9)).cast("decimal(20,0)")
    packed = (units * F.lit(1 << 32) + (F.lit(LABEL_TOP) - F.col("predicted_label").cast("long"))).cast("decimal(38,0)")
    best = s.groupBy("id").agg(F.max(packed).alias("_k"))
    label = F.lit(LABEL_TOP) - (F.col("_k") % F.lit(1 << 32)).cast("long")
    return best.select("id", label.cast("int").alias("predicted_label"))


def vote_columns(cols: list) -> Column:
    """Wide-form majority vote over prediction columns of one row (ties -> smallest)."""
    arr = F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])
    counts = F.transform(arr, lambda x: F.struct(
        F.size(F.filter(arr, lambda y: y == x)).alias("n"), (-x).alias("neg")))
    best = F.array_max(counts)
    return -best["neg"]


def score_all(df: DataFrame, models: dict, code: str = "code", prefix: str = "pred_") -> DataFrame:
    """M8 in one pass: every model adds its prediction column to the same rows.

    Cue tables with the same split rule share one tokenization; fitted Spark
    ML models are applied one after the other in the same projection chain.
    No model re-reads the input, and no shuffle is involved.
    """
    from snippetflow.operators.classify import classify
    out = df
    token_tables = {n: m for n, m in models.items() if isinstance(m, CueTable) and m.mode == "tokens"}
    patterns = {m.split_pattern for m in token_tables.values()}
    if len(patterns) == 1 and token_tables:
        pattern = patterns.pop()
        out = out.withColumn("_ens_tok", F.split(F.lower(F.coalesce(F.col(code), F.lit(""))), pattern))
        for name, m in token_tables.items():
            out = out.withColumn(f"_ens_{name}", F.array(*[F.size(F.filter("_ens_tok", _member(ws)))
                                                           for ws in m.cues.values()]))
        out = out.drop("_ens_tok")
        for name, m in token_tables.items():
            sc = [F.col(f"_ens_{name}")[i] for i in range(len(m.cues))]
            out = out.withColumn(prefix + name, m.argmax_index(sc)).drop(f"_ens_{name}")
    for name, m in models.items():
        if prefix + name not in out.columns:
            out = classify(out, m, code, prefix + name)
    return out


def _member(values):
    lits = [F.lit(v) for v in values]
    return lambda t: t.isin(*lits)


def best_candidate(candidates: DataFrame, order_col: str = "candidate", score: str = "macro_f1") -> DataFrame:
    """The candidate with the highest score; the earliest wins ties."""
    pick = candidates.agg(F.max_by(F.col(order_col), F.struct(F.col(score), -F.col(order_col))).alias("_b"))
    return candidates.join(pick, F.col(order_col) == F.col("_b"), "left_semi")


def two_view_expand(df: DataFrame, code: str = "code", n: int = CROP_CHARS) -> DataFrame:
    """One row per (row, view) with the head and the tail crop."""
    return df.select("*", F.explode(F.array(
        F.struct(F.lit("head").alias("view"), crop_head(code, n).alias("view_text")),
        F.struct(F.lit("tail").alias("view"), crop_tail(code, n).alias("view_text")))).alias("_v")) \
        .select(*df.columns, "_v.view", "_v.view_text")


def two_view_scores(table: CueTable, code: str = "code", n: int = CROP_CHARS) -> list[Column]:
    """M6 (wide form): per class, the mean of the head-view and tail-view scores."""
    h = table.scores(crop_head(code, n))
    t = table.scores(crop_tail(code, n))
    return [(a + b).cast("double") / 2.0 for a, b in zip(h, t)]


def two_view_predict(df: DataFrame, table: CueTable, code: str = "code", n: int = CROP_CHARS,
                     out: str = "predicted_label") -> DataFrame:
    """M6: argmax of the averaged two-view class scores (ties -> lowest), per row."""
    if table.mode != "tokens":
        return df.withColumn(out, table.argmax_index(two_view_scores(table, code, n)))
    # the tokens of each view, then the scores, then the winner, each a projection of its own,
    # so that a view is tokenized once
    t = df
    for view, crop in (("h", crop_head), ("t", crop_tail)):
        t = t.withColumn(f"_tv_{view}", F.split(F.lower(F.coalesce(crop(code, n), F.lit(""))), table.split_pattern))
    for i, ws in enumerate(table.cues.values()):
        both = F.size(F.filter("_tv_h", _member(ws))) + F.size(F.filter("_tv_t", _member(ws)))
        t = t.withColumn(f"_tv_s{i}", both.cast("double") / 2.0)
    names = [f"_tv_s{i}" for i in range(len(table.cues))]
    return t.withColumn(out, table.argmax_index([F.col(c) for c in names])).drop("_tv_h", "_tv_t", *names)
