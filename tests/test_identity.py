"""Rows without ids, with repeated ones or with null ones: exact counts, each row by its own text."""

import pytest
from pyspark.sql import functions as F

from snippetflow import schema
from snippetflow.operators import classify as C
from snippetflow.operators import clean, ensemble, sampling
from snippetflow.plans import jobs
from snippetflow.sources import io


def ids(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "id long, x long").repartition(5)


@pytest.mark.parametrize("values, n", [([7] * 20, 5), ([*range(10)] + [None] * 20, 10), ([*range(10)] + [None] * 20, 15), ([1, 1, 1, 2, 2, 3], 4), ([None] * 9, 9), ([None] * 9, 12)])
@pytest.mark.parametrize("buckets", [4, sampling.CELLS])
def test_sample_takes_exactly_n_rows(spark, values, n, buckets):
    got = sampling.sample_exact(ids(spark, values), n, buckets=buckets, id_col="id").collect()
    assert len(got) == len({r.x for r in got}) == min(n, len(values))
    known = sum(v is not None for v in values)
    assert sum(r.id is not None for r in got) == min(known, n)       # null ids come last


@pytest.mark.parametrize("make", [lambda i: None, lambda i: i % 3, lambda i: 1, lambda i: i])
def test_split_holds_its_quotas_whatever_the_ids(spark, make):
    df = spark.createDataFrame([(make(i), i, i % 2) for i in range(100)], "id long, x long, label int").repartition(7)
    got = sampling.stratified_split(df, id_col="id").collect()
    assert len({r.x for r in got}) == 100
    n = {}
    for r in got:
        n[r.label, r.split] = n.get((r.label, r.split), 0) + 1
    assert n == {(k, s): c for k in (0, 1) for s, c in (("train", 35), ("val", 10), ("test", 5))}
    free = {r["split"]: r["n"] for r in sampling.split_counts(sampling.stratified_split(df, None, id_col="id")).collect()}
    assert free == {"train": 70, "val": 20, "test": 10}


def test_ties_are_numbered_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(9).unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k long, id long"))
    got = {}
    for r in clean.numbered_ties(df, ["k"]).collect():
        got.setdefault(r.k, []).append(r._tie)
    assert {k: sorted(v) == list(range(len(v))) for k, v in got.items()} == {0: True, 1: True, 2: True, None: True}


def test_dedup_of_any_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, {"k": 1}), (1, "a", 6, {"k": 2}), (2, "a", 7, {}), (3, "b", 8, None)], "id long, code string, `x.y` int, m map<string,int>")
    got = clean.dedup_first(df).collect()
    assert df.columns == list(got[0].asDict()) and sorted(r.id for r in got) == [1, 3]


def test_rows_of_files_go_by_place(spark):
    path = io.scratch_path(spark, "noid")
    spark.range(60).select(F.concat(F.lit("text "), F.col("id") % 20).alias("code"), (F.col("id") % 2).cast("int").alias("label"), F.col("id").alias("at")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert [r.at for r in clean.preprocess(df).orderBy("at").collect()] == list(range(20))
    keyed = schema.with_row_key(df.select("at"))
    assert keyed.where("_row.file <> 0 or _row.at <> at").count() == 0
    assert sampling.sample_exact(df, 13).columns == df.columns and sampling.sample_exact(df, 13).count() == 13
    assert sampling.stratified_split(df).columns == [*df.columns, "split"]
    some = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "code string, label int")       # not files
    assert sorted(clean.preprocess(some).collect()) == [("a", 1), ("b", 0)]


def test_naive_bayes_scores_each_row_by_its_text(spark):
    train = spark.createDataFrame([(1, "aa aa", 1), (2, "bb bb", 0), (3, "bb cc", 0)], "id long, code string, label int")
    model = C.fit_naive_bayes(train)
    rows = spark.createDataFrame([(1, "aa", 0), (1, "bb bb bb bb", 1), (None, "aa aa aa", 2), (None, None, 3)], "id long, code string, pos int")
    got = {r.pos: r.predicted_label for r in C.classify(rows, model).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0}
    stack = C.stack_naive_bayes([model, C.fit_naive_bayes(train, alpha=0.1)])
    both = {r.pos: r.predicted_labels for r in C.predict_stack(stack, rows).collect()}
    assert both == {k: [v, v] for k, v in got.items()}


def test_naive_bayes_with_a_language(spark):
    rows = [(i, "word", "x" if i % 2 else "y", i % 2) for i in range(8)]
    train = spark.createDataFrame(rows, "id long, code string, language string, label int")
    path = io.scratch_path(spark, "nb")
    C.save_naive_bayes(C.fit_naive_bayes(train, language="language"), path)
    model = C.load_naive_bayes(spark, path)
    new = spark.createDataFrame([("word", "x", 1), ("word", "y", 0), ("word", "new", 0), ("word", None, 0)], "code string, language string, want int")
    got = C.predict_naive_bayes(model, new, language="language").collect()
    assert [r.predicted_label for r in got if r.language in ("x", "y")] == [r.want for r in got if r.language in ("x", "y")]
    assert {r.predicted_label for r in got if r.language not in ("x", "y")} == {0}


def test_evaluation_of_labels_that_share_a_name(spark):
    rows = [(i, f"the of {i}", i % 3, "same" if i % 3 < 2 else "other") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, code string, label int, language string")
    base = io.scratch_path(spark, "names")
    out = jobs.evaluate_job(df, output_dir=base)
    doc = io.read_json(spark, f"{base}/test_metrics.json", jobs.METRICS_SCHEMA).first()
    assert {"same_0", "same_1", "other"} <= set(doc["classification_report"])
    assert out["errors"].where("code is null").count() == 0


def test_a_weight_that_would_be_lost_is_refused(spark):
    df = spark.createDataFrame([(1, 5, 1e-12), (1, 3, 0.0)], "id long, predicted_label int, weight double")
    with pytest.raises(Exception, match="decimal places"):
        ensemble.weighted_vote(df).collect()
