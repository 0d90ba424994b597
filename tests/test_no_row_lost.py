"""Every input row has an outcome: null ids and labels, repeated rows, misaligned keys, ties."""

import pytest
from pyspark.sql import functions as F

from snippetflow.operators import clean, detect, ensemble, metrics, profile, sampling


def test_dedup_keeps_rows_without_ids(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "a"), (None, "c"), (None, "c")], "id long, code string")
    assert sorted(clean.dedup_first(df).collect(), key=str) == sorted([(1, "a"), (None, "b"), (None, "c")], key=str)


def test_dedup_resolves_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 2), (2, "a", 1), (5, None, 1), (4, None, 9)], "id long, code string, x int").repartition(3)
    assert sorted(clean.dedup_first(df).collect()) == [(1, "a", 2), (4, None, 9)]


def test_split_keeps_rows_without_labels(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("int").alias("label"))
    out = sampling.stratified_split(df)
    assert out.count() == 100 and out.where("label is null").count() == 20
    assert out.where("split is null").count() == 0


@pytest.mark.parametrize("buckets", [8, 1 << 20])
def test_sample_and_split_by_rank(spark, buckets):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("label"))
    assert sampling.sample_exact(df, 77, buckets=buckets).count() == 77
    assert sampling.sample_exact(df, 5000, buckets=buckets).count() == 1000
    got = {r["split"]: r["n"] for r in sampling.split_counts(sampling.stratified_split(df, None, buckets=buckets)).collect()}
    assert got == {"train": 700, "val": 200, "test": 100}


def test_sample_keeps_null_ids_last(spark):
    df = spark.range(20).select(F.when(F.col("id") < 15, F.col("id")).alias("id"), F.col("id").alias("x"))
    assert sampling.sample_exact(df, 10).where("id is null").count() == 0
    assert sampling.sample_exact(df, 100).count() == 20


@pytest.mark.parametrize("preds, what", [([1, 1, 2], "1 repeated predictions"), ([1, 2], "1 rows without a prediction"),
                                         ([1, 2, 3, 4], "1 predictions without a row"), ([1, 2, 3, None], "1 null keys")])
def test_alignment_is_checked(spark, preds, what):
    truth = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "id long, label int")
    p = spark.createDataFrame([(i, 0) for i in preds], "id long, predicted_label int")
    with pytest.raises(ValueError, match=what):
        metrics.align_predictions(truth, p)


def test_weighted_vote_does_not_depend_on_order(spark):
    rows = [(1, 7, .1), (1, 7, .2), (1, 7, .3), (1, 3, .6), (2, 3, .3), (2, 3, .2), (2, 3, .1), (2, 7, .6), (3, -5, .2), (3, 9, .1)]
    for n in (1, 4, 13):
        df = spark.createDataFrame(rows, "id long, predicted_label int, weight double").repartition(n)
        assert sorted(ensemble.weighted_vote(df).collect()) == [(1, 3), (2, 3), (3, -5)]


def test_dense_ids_over_any_order_column(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 3), ("c", 0), (None, 5)], "s string, x int").repartition(3)
    got = [(r.s, r.x, r.row_id) for r in clean.dense_row_ids(df, ["s", "x"]).orderBy("row_id").collect()]
    assert got == [(None, 5, 0), ("a", 1, 1), ("a", 3, 2), ("b", 2, 3), ("c", 0, 4)]


def test_failures_of_an_external_model_are_named(spark):
    def make():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no answer")
            return [f"n{len(t)}" for t in texts]
        return predict

    long = "x" * 5000
    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, long)], "id long, code string")
    out = {r.id: (r.detected_language, r.error) for r in detect.detect_language(df, detect.BatchModel(make), error="error").collect()}
    assert out == {1: ("n2", None), 2: ("Unknown", "ValueError: no answer"), 3: ("Unknown", None), 4: ("n5000", None)}
    assert detect.BatchModel(make).token != detect.BatchModel(make).token


def test_length_tables_with_nulls_and_long_texts(spark):
    df = spark.createDataFrame([("a" * 60_000, 1), ("b", 1), (None, 1), ("cc", None)], "code string, label int")
    d = profile.length_describe(df).first()
    assert d["count"] == 3 and d["max"] == 60_000 and d["q50"] == 2.0
    box = {r["label"]: r["n"] for r in profile.length_box_by_label(df).collect()}
    assert box == {1: 3, None: 1}
