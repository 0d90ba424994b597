"""Prefix scans, epoch-wise training and its certificate, counted cues, failure accounting, partitioned tables."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from snippetflow.functions.cues import CueTable
from snippetflow.operators import detect, profile, scan, softmax
from snippetflow.plans import catalog, jobs
from snippetflow.sources import io

SF = "/root/testdata/sf0.001"


def test_running_sums_of_a_key_that_fills_many_partitions(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "hot", "hot", "hot", "b"]), rnd.randint(0, 400), i, rnd.choice([None, Decimal("1.10"), Decimal("-2.05")])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v decimal(9,2)").repartition(6)
    got = {(r.k, r.i): (r.s, r.n) for r in scan.running_sums(df, ["k"], ["o", "i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    at, n = {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n[k] = n.get(k, 0) + 1
        if v is not None:
            at[k] = at.get(k, Decimal(0)) + v
        assert got[k, i] == (at.get(k), n[k])
    assert len(got) == len(rows)
    assert scan.running_sums(df.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_running_average_windows_hold_a_partition_at_most(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("v"))
    out = profile.running_average(df, "k", "id", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_rs_p" in plan and out.where("abs(running_avg - id / 2.0) > 1e-9").count() == 0


def blobs(spark, n=400):
    rnd = np.random.default_rng(4)
    rows = [(i, int(i % 3), float(rnd.normal(i % 3, .6)), float(rnd.normal(-(i % 3), .6))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, label int, x double, y double").repartition(5), rows


def test_epochs_equal_the_plain_recursion(spark):
    df, rows = blobs(spark)
    path = io.scratch_path(spark, "epochs")
    r = softmax.train_softmax(df, df, ["x", "y"], epochs=3, learning_rate=.5, l2=.1, class_weighted=False, path=path)
    x = np.array([(a, b, 1) for _, _, a, b in rows])
    hot = np.eye(3)[[k for _, k, *_ in rows]]
    w, losses = np.zeros((3, 3)), []
    for _ in range(3):
        p = np.exp(x @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-(np.log(p) * hot).sum() / len(x))
        w = w - .5 * ((p - hot).T @ x / len(x) + .1 * w * [1, 1, 0])
    got = {(v.epoch, v.label, v.feature): v.weight for v in r.weights.collect()}
    assert all(abs(got[3, k, j if j < 2 else -1] - w[k, j]) < 1e-9 for k in range(3) for j in range(3))
    table = {v.epoch: v for v in r.epochs.collect()}
    assert all(abs(table[e + 1].train_loss - loss) < 1e-9 for e, loss in enumerate(losses))
    best = max(v.val_macro_f1 for v in table.values())
    assert r.best.first().epoch == min(e for e, v in table.items() if v.val_macro_f1 == best)
    assert spark.read.parquet(f"{path}/epoch-2").count() == 9
    with pytest.raises(ValueError):
        softmax.train_softmax(df.limit(0), df, ["x"])


def test_certificate_tells_an_optimum(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    df, _ = blobs(spark)
    rows = df.select("label", F.lit(1.0).alias("weight"), F.array("x", "y").alias("features"))
    fit = lambda n: LogisticRegression(featuresCol="v", family="multinomial", regParam=.05, maxIter=n, tol=1e-12).fit(rows.withColumn("v", array_to_vector("features")))
    norm = lambda m: softmax.certificate(rows, m.coefficientMatrix.toArray(), m.interceptVector.toArray(), [0, 1, 2], .05)["gradient_norm"]
    assert norm(fit(200)) < 1e-6 < 1e-3 < norm(fit(2))


def test_cues_are_counted_with_their_overlaps(spark):
    table = CueTable({"A": ["aba", "b"], "B": ["ab", "zz"]}, "substrings")
    df = spark.createDataFrame([(1, "ababab"), (2, ""), (3, None), (4, "zzzz"), (5, "ab" * 50_000)], "id int, code string")
    got = {r.id: (r.lang, r.n) for r in detect.CountedCues(table).apply(df, "code", "lang", "n").collect()}
    assert got == {1: ("A", [5, 3]), 2: ("Unknown", [0, 0]), 3: ("Unknown", None), 4: ("B", [0, 3]), 5: ("A", [99_999, 50_000])}
    assert detect.detect_language(df, detect.CountedCues(table)).columns == ["id", "code", "detected_language"]


def test_failures_are_counted_kept_and_limited(spark):
    def make():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no answer")
            return ["x"] * len(texts)
        return predict

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "bad too")], "id int, code string")
    path = io.scratch_path(spark, "detect")
    out, dead, counts = jobs.detect_job(df, path, detect.BatchModel(make), max_failed=.75)
    assert counts == {"rows": 4, "unknown": 3, "failed": 2} and out.count() == 4
    assert {(r.id, r.error) for r in dead.collect()} == {(2, "ValueError: no answer"), (4, "ValueError: no answer")}
    with pytest.raises(RuntimeError, match="3 of 4"):
        jobs.detect_job(df, path, detect.BatchModel(make), max_failed=.5)
    assert jobs.detect_job(df, path)[2]["failed"] == 0


def test_reads_of_partitioned_tables_are_pruned(spark):
    s = detect.detect_language(catalog.samples(spark, SF)).withColumn("split", F.when(F.col("id") % 4 > 0, "train").otherwise("val"))
    path = io.save_partitioned(s, io.scratch_path(spark, "parts"), ["split", "detected_language"], "id")
    t = spark.read.parquet(path)
    some = t.where("split = 'val' and detected_language = 'en'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "split" in filters and "detected_language" in filters
    assert sorted(some.select("id", "code").collect()) == sorted(s.where("split = 'val' and detected_language = 'en'").select("id", "code").collect())
    assert t.count() == s.count()
