"""Evaluation tables on hand-made cases (FIXTURES.md part 3)."""

import pytest
from pyspark.sql import functions as F

from snippetflow.operators import ensemble, labels, metrics


def scored(spark, truth, pred):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(truth, pred))],
                                 "id long, label int, predicted_label int")


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_headline_metrics(spark):
    conf = metrics.confusion_counts(scored(spark, [0, 0, 0, 1, 2], [0, 0, 1, 1, 0]))
    s = metrics.summary_metrics(conf).first()
    assert s["accuracy"] == pytest.approx(0.6)
    assert s["macro_precision"] == pytest.approx(0.3889, abs=1e-4)
    assert s["macro_recall"] == pytest.approx(0.5556, abs=1e-4)
    assert s["macro_f1"] == pytest.approx(0.4444, abs=1e-4)
    assert s["weighted_f1"] == pytest.approx(0.5333, abs=1e-4)


def test_prediction_only_label(spark):
    conf = metrics.confusion_counts(scored(spark, [0, 0, 2], [0, 1, 2]))
    pc = {r["label"]: r for r in metrics.per_class_metrics(conf).collect()}
    assert sorted(pc) == [0, 1, 2]
    assert pc[0]["f1"] == pytest.approx(2 / 3)
    assert pc[1]["f1"] == 0.0 and pc[1]["support"] == 0
    assert pc[2]["f1"] == 1.0
    s = metrics.summary_metrics(conf).first()
    assert s["macro_f1"] == pytest.approx(0.5556, abs=1e-4)
    assert s["weighted_f1"] == pytest.approx(0.7778, abs=1e-4)
    lm = spark.createDataFrame([(0, "zero"), (2, "two")], "label int, name string")
    named = as_dict(metrics.with_class_name(metrics.per_class_metrics(conf), lm), "label", "class_name")
    assert named == {0: "zero", 1: "Class_1", 2: "two"}   # label 1 keeps its own name


def test_dense_confusion(spark):
    conf = metrics.confusion_counts(scored(spark, [0, 0, 2], [0, 1, 2]))
    d = metrics.confusion_dense(conf).collect()
    assert len(d) == 9 and sum(1 for r in d if r["n"] == 0) == 6


def test_report_rows(spark):
    conf = metrics.confusion_counts(scored(spark, [0, 0, 0, 1, 2], [0, 0, 1, 1, 0]))
    rep = {r["class"]: r for r in metrics.classification_report(conf).collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"]["f1"] == pytest.approx(0.6) and rep["accuracy"]["precision"] is None
    assert rep["macro avg"]["support"] == 5


def test_metrics_long_prefix(spark):
    conf = metrics.confusion_counts(scored(spark, [0, 1], [0, 1]))
    m = as_dict(metrics.metrics_long(conf, prefix="val_"), "metric", "value")
    assert m["val_accuracy"] == 1.0 and m["val_f1_Class_0"] == 1.0 and len(m) == 7


def test_null_label_rejected(spark):
    df = spark.createDataFrame([(0, None, 1)], "id long, label int, predicted_label int")
    with pytest.raises(Exception):
        metrics.confusion_counts(df).collect()


def test_misclassified_empty_and_top(spark):
    same = scored(spark, [1, 2], [1, 2])
    e = metrics.misclassified(same)
    assert e.count() == 0 and "true_label" in e.columns
    many = scored(spark, [0] * 150, [1] * 150)
    top = metrics.misclassified_top(many, "id", 100).collect()
    assert [r["id"] for r in top] == list(range(100))


def test_votes(spark):
    long = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 5), (2, "b", 3), (2, "c", 5)],
                                 "id long, model string, predicted_label int")
    assert as_dict(ensemble.majority_vote(long), "id", "predicted_label") == {1: 1, 2: 5}
    w = spark.createDataFrame([(1, "a", 2, 0.5), (1, "b", 1, 0.5)],
                              "id long, model string, predicted_label int, weight double")
    assert as_dict(ensemble.weighted_vote(w), "id", "predicted_label") == {1: 1}
    wide = spark.createDataFrame([(2, 1, None), (5, 3, 5)], "a int, b int, c int").fillna(1, ["c"])
    assert [r[0] for r in wide.select(ensemble.vote_columns(["a", "b", "c"])).collect()] == [1, 5]


def test_majority_vote_full_int_range(spark):
    lo, hi = -(1 << 31), (1 << 31) - 1
    rows = [(1, "a", hi), (1, "b", lo), (2, "a", -3), (2, "b", -3), (2, "c", 7),
            (3, "a", hi), (3, "b", hi), (3, "c", lo)]
    long = spark.createDataFrame(rows, "id long, model string, predicted_label int")
    assert as_dict(ensemble.majority_vote(long), "id", "predicted_label") == {1: lo, 2: -3, 3: hi}


def test_best_candidate(spark):
    c = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "candidate int, macro_f1 double")
    assert [r["candidate"] for r in ensemble.best_candidate(c).collect()] == [1]


def test_label_maps(spark):
    df = spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (2, 1, "z"), (3, 0, "x")],
                               "id long, label int, language string")
    assert as_dict(labels.label_map(df), "label", "name") == {0: "y", 1: "z"}
    g = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "id long, label int")
    assert as_dict(labels.label_map(g), "label", "name") == {0: "Language_0", 2: "Language_2"}
    assert labels.label_map(g.drop("label")).count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = as_dict(labels.class_weights(df), "label", "weight")
    assert w[0] == pytest.approx(0.6667, abs=1e-4) and w[1] == pytest.approx(2.0)
