"""Evaluation tables.

One aggregate over the scored rows (A1) produces the sparse confusion table
with at most K^2 rows; every other metric is computed from that tiny table,
so the big data is scanned and shuffled once (partial aggregation map-side).
sklearn conventions: the class set is the union of true and predicted
labels, 0/0 counts as 0, ties and order by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_NAMES = ("accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall")


def _non_null(c: str, what: str) -> Column:
    return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {what} label"))).otherwise(F.col(c))


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 where b == 0 (zero_division=0); ANSI-safe."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, truth: str = "label", pred: str = "predicted_label") -> DataFrame:
    """A1: (true_label, predicted_label, n) for every observed pair."""
    return (df.select(_non_null(truth, "true").alias("true_label"),
                      _non_null(pred, "predicted").alias("predicted_label"))
            .groupBy("true_label", "predicted_label")
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_table(df: DataFrame, truth: str = "label", pred: str = "predicted_label") -> DataFrame:
    """A1, materialized: the K^2-row table is written once to the shared
    checkpoint folder, so every metric derived from it reads that small table
    instead of re-running the scan and the model once per metric branch."""
    from snippetflow.session import cut_lineage
    return cut_lineage(confusion_counts(df, truth, pred))


def label_universe(conf: DataFrame) -> DataFrame:
    """Sorted union of true and predicted labels (from the K^2 table)."""
    return (conf.select(F.col("true_label").alias("label"))
            .union(conf.select(F.col("predicted_label").alias("label"))).distinct())


def class_totals(conf: DataFrame) -> DataFrame:
    """(label, tp, support, n_pred) over the label universe: each cell counts once for its
    true and once for its predicted label, in one aggregate."""
    n, zero = F.col("n").cast("long"), F.lit(0).cast("long")
    same = F.when(F.col("true_label") == F.col("predicted_label"), n).otherwise(zero)
    sides = F.array(F.struct(F.col("true_label").alias("label"), same.alias("tp"), n.alias("support"), zero.alias("n_pred")),
                    F.struct(F.col("predicted_label").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("n_pred")))
    return conf.select(F.explode(sides).alias("c")).groupBy(F.col("c.label").alias("label")).agg(
        *[F.sum(f"c.{x}").alias(x) for x in ("tp", "support", "n_pred")])


def with_class_name(df: DataFrame, label_map: DataFrame | None, label: str = "label",
                    out: str = "class_name", fallback_prefix: str | None = "Class_") -> DataFrame:
    """Attach the class name; missing name -> prefix||label (or label text)."""
    fb = (F.col(label).cast("string") if fallback_prefix is None
          else F.concat(F.lit(fallback_prefix), F.col(label).cast("string")))
    if label_map is None:
        return df.withColumn(out, fb)
    m = label_map.select(F.col("label").alias("_ml"), F.col("name").alias("_mn"))
    return (df.join(m, F.col(label) == F.col("_ml"), "left")
            .withColumn(out, F.coalesce(F.col("_mn"), fb)).drop("_ml", "_mn"))


def per_class_metrics(conf: DataFrame) -> DataFrame:
    """A3: (label, precision, recall, f1, support, tp) for each label of the universe."""
    t = class_totals(conf)
    return t.select(
        "label",
        _div(F.col("tp"), F.col("n_pred")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"),
        "support", "tp")


def accuracy(conf: DataFrame) -> DataFrame:
    """A2: one row (accuracy, n)."""
    return conf.agg(
        _div(F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n"))
                   .otherwise(F.lit(0))), F.sum("n")).alias("accuracy"),
        F.sum("n").cast("long").alias("n"))


def macro_metrics(per_class: DataFrame) -> DataFrame:
    """A4: unweighted means over the label universe."""
    return per_class.agg(F.avg("precision").alias("macro_precision"),
                         F.avg("recall").alias("macro_recall"),
                         F.avg("f1").alias("macro_f1"))


def weighted_f1(per_class: DataFrame) -> DataFrame:
    """A5: support-weighted mean F1."""
    return per_class.agg(_div(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
                         .alias("weighted_f1"))


def summary_metrics(conf: DataFrame) -> DataFrame:
    """A2 + A4 + A5 as one row, computed from the K^2 table."""
    pc = per_class_metrics(conf)
    row = pc.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        _div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.sum("support").cast("long").alias("n"))
    return row


def metrics_long(conf: DataFrame, label_map: DataFrame | None = None, prefix: str = "",
                 fallback_prefix: str | None = "Class_") -> DataFrame:
    """(metric, value): the five headline metrics and f1_<class> per class."""
    s = summary_metrics(conf)
    head = s.select(F.explode(F.array(*[
        F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in METRIC_NAMES])).alias("kv")).select("kv.metric", "kv.value")
    pc = with_class_name(per_class_metrics(conf), label_map, "label", "class_name", fallback_prefix)
    per = pc.select(F.concat(F.lit(prefix + "f1_"), F.col("class_name")).alias("metric"),
                    F.col("f1").alias("value"))
    return head.unionByName(per)


def classification_report(conf: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """(class, precision, recall, f1, support) + accuracy / macro avg / weighted avg.

    Class rows are named by the label map when given, else by the label text
    (sklearn's report).  The accuracy row carries only f1 = accuracy.  Class rows and averages
    come from one aggregate over grouping sets of the per-class table.
    """
    pc = with_class_name(per_class_metrics(conf), label_map, "label", "class",
                         None if label_map is None else "Class_")
    s = pc.groupingSets([["label", "class"], []], "label", "class").agg(
        F.grouping("label").alias("total"), F.sum("support").cast("long").alias("support"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        *[_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        _div(F.sum("tp"), F.sum("support")).alias("accuracy"))
    none = F.lit(None).cast("double")
    row = lambda name, p, r, f: F.struct(name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support").alias("support"))
    own = row(F.col("class"), F.col("precision"), F.col("recall"), F.col("f1"))
    totals = F.array(row(F.lit("accuracy"), none, none, F.col("accuracy")), row(F.lit("macro avg"), F.col("precision"), F.col("recall"), F.col("f1")),
                     row(F.lit("weighted avg"), F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))
    return s.select(F.explode(F.when(F.col("total") == 1, totals).otherwise(F.array(own))).alias("r")).select("r.*")


def per_class_long(conf: DataFrame) -> DataFrame:
    """Chart data (label, metric, value) for precision, recall and f1."""
    pc = per_class_metrics(conf)
    return pc.unpivot("label", ["precision", "recall", "f1"], "metric", "value")


def confusion_dense(conf: DataFrame) -> DataFrame:
    """The full K x K grid including zero cells.

    The grid is generated by exploding the (K-element) label list twice, not
    by a cross join; the observed counts are then left-joined on the pair.
    """
    labels = label_universe(conf).agg(F.sort_array(F.collect_list("label")).alias("ls"))
    grid = (labels.select(F.explode("ls").alias("true_label"), "ls")
            .select("true_label", F.explode("ls").alias("predicted_label")))
    return (grid.join(conf, ["true_label", "predicted_label"], "left")
            .select("true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def align_predictions(truth: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Every row of truth with its prediction by key.

    Both sides must hold the same keys, each once: keys are counted on both
    sides in one aggregate first, and a missing, surplus, repeated or
    null key raises an error that names how many there are of each.
    """
    both = truth.select(F.col(key).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        preds.select(F.col(key).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    per = both.groupBy("k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    faults = {"rows without a prediction": "t > 0 and p = 0", "predictions without a row": "t = 0",
              "repeated rows": "t > 1", "repeated predictions": "p > 1", "null keys": "k is null"}
    n = per.agg(*[F.count(F.when(F.expr(c), 1)).alias(f"f{i}") for i, c in enumerate(faults.values())]).first()
    if any(n):
        raise ValueError("predictions do not align: " + ", ".join(f"{x} {w}" for x, w in zip(n, faults) if x))
    return truth.join(preds, key, "left")


def misclassified(scored: DataFrame, truth: str = "label", pred: str = "predicted_label",
                  label_map: DataFrame | None = None) -> DataFrame:
    """F4 + J3: rows whose prediction differs, with true/predicted label (and names)."""
    out = (scored.filter(~F.col(truth).eqNullSafe(F.col(pred)))
           .withColumn("true_label", F.col(truth))
           .withColumn("predicted_label", F.col(pred)))
    if label_map is not None:
        m = label_map.select("label", "name")
        out = (out.join(m.select(F.col("label").alias("_tl"), F.col("name").alias("true_class")),
                        F.col("true_label") == F.col("_tl"), "left").drop("_tl")
               .join(m.select(F.col("label").alias("_pl"), F.col("name").alias("predicted_class")),
                     F.col("predicted_label") == F.col("_pl"), "left").drop("_pl"))
    return out


def misclassified_top(scored: DataFrame, order_col: str = "id", n: int = 100, **kw) -> DataFrame:
    """The first n misclassified rows in source order (top-k, n bounded)."""
    return misclassified(scored, **kw).orderBy(order_col).limit(n)


def grouped_summary(scored: DataFrame, by: str, truth: str = "label",
                    pred: str = "predicted_label") -> DataFrame:
    """Per group (e.g. candidate model): accuracy, macro P/R/F1 and weighted F1
    from one aggregate over (group, true, predicted)."""
    conf = (scored.groupBy(by, F.col(truth).alias("true_label"), F.col(pred).alias("predicted_label"))
            .agg(F.count(F.lit(1)).alias("n")))
    support = conf.groupBy(by, F.col("true_label").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))).alias("tp"))
    predicted = conf.groupBy(by, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("n_pred"))
    t = (support.join(predicted, [by, "label"], "full_outer")
         .select(by, "label", F.coalesce("tp", F.lit(0)).alias("tp"),
                 F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("n_pred", F.lit(0)).alias("n_pred")))
    pc = t.select(by, "label", "tp", "support",
                  _div(F.col("tp"), F.col("n_pred")).alias("precision"),
                  _div(F.col("tp"), F.col("support")).alias("recall"),
                  _div(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"))
    return pc.groupBy(by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        _div(F.sum("tp"), F.sum("support")).alias("accuracy"))
