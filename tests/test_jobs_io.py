"""Sinks, model round trips, Naive Bayes parity and the jobs."""

import pytest
from pyspark.sql import functions as F

from snippetflow.operators import classify as C
from snippetflow.operators import clean, sampling
from snippetflow.plans import catalog, jobs
from snippetflow.sources import io

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip_special_text(spark):
    code = 'say "hi", then\nnew line \\ backslash'
    df = spark.createDataFrame([(1, code)], "id long, code string")
    p = io.scratch_path(spark, "csvtest")
    io.write_csv(df, p)
    assert io.read_csv(spark, p, "id long, code string").first()["code"] == code


def test_naive_bayes_matches_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer
    train = catalog.training_rows(spark, SF)
    test = catalog.samples(spark, SF)
    ours = {r["id"]: r["predicted_label"]
            for r in C.predict_naive_bayes(C.fit_naive_bayes(train), test).select("id", "predicted_label").collect()}
    tok = RegexTokenizer(inputCol="code", outputCol="t", pattern=C.NB_SPLIT, minTokenLength=1)
    tr = tok.transform(train)
    cv = CountVectorizer(inputCol="t", outputCol="f", vocabSize=1 << 20, minDF=1).fit(tr)
    nb = NaiveBayes(featuresCol="f", labelCol="label", smoothing=1.0, modelType="multinomial").fit(cv.transform(tr))
    ml = {r["id"]: int(r["prediction"]) for r in nb.transform(cv.transform(tok.transform(test))).collect()}
    assert ours == ml


def test_naive_bayes_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    train = catalog.training_rows(spark, SF)
    test = catalog.samples(spark, SF)
    model = C.fit_naive_bayes(train)
    pick = lambda d: sorted(d.select("id", "predicted_label").collect())
    small = C.predict_naive_bayes(model, test)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    want = pick(small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    try:
        large = C.predict_naive_bayes(model, test)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString() and pick(large) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_naive_bayes_shuffles_rare_tokens_only(spark, monkeypatch):
    texts = [(i, "the cat " * 20 + f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} unseen", i % 2) for i in range(100)]
    train = spark.createDataFrame([(i, t.replace("unseen", ""), y) for i, t, y in texts] + [(100, None, 0), (101, "dog", None)], "id long, code string, label int")
    test = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(100, None), (101, "")], "id long, code string")
    model, models = C.fit_naive_bayes(train), C.stack_naive_bayes([C.fit_naive_bayes(train, alpha=a) for a in (.1, 10.)])
    run = [lambda: C.predict_naive_bayes(model, test), lambda: C.predict_stack(models, test), lambda: C.predict_two_views(model, test, 30)]
    want = [sorted(f().collect()) for f in run]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(C, "BROADCAST_BYTES", 1200)      # room for the two frequent words, not for all 102
    try:
        frames = [f() for f in run]
        assert [sorted(f.collect()) for f in frames] == want
        assert all("BroadcastHashJoin" in f._jdf.queryExecution().executedPlan().toString() for f in frames)
        terms = C._occurrences(test, "id", F.col("code"), C.NB_SPLIT)
        assert C._weighted(terms, model.weights, 3).groupBy("token").count().where("token in ('the', 'cat')").agg(F.sum("count")).first()[0] == 4000
        assert C._weighted(terms, model.weights, 3).count() == 4100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_predict_job_keeps_every_row(spark):
    s = catalog.samples(spark, SF)
    out = jobs.predict_job(s)
    assert out.count() == s.count()
    assert {"detected_language", "predicted_label"} <= set(out.columns)
    only = jobs.predict_job(s, stages=("classify",))
    assert "detected_language" not in only.columns


def test_evaluate_job_outputs(spark):
    base = io.scratch_path(spark, "evaltest")
    out = jobs.evaluate_job(catalog.samples(spark, SF), output_dir=base,
                            metric_names=["accuracy", "macro_f1"])
    assert {r["metric"] for r in out["metrics"].collect()} == {"test_accuracy", "test_macro_f1"}
    back = io.read_json(spark, f"{base}/test_metrics.json", jobs.METRICS_SCHEMA).first()
    assert set(back["metrics"]) == {"test_accuracy", "test_macro_f1"}
    assert {"accuracy", "macro avg", "weighted avg"} < set(back["classification_report"])
    errs = spark.read.options(**io.CSV_OPTS).csv(f"{base}/test_misclassifications.csv")
    assert errs.count() == out["errors"].count()
    assert "confusion_dense" not in out


def test_saved_predictions_are_scored_once_and_complete(spark):
    base = io.scratch_path(spark, "evalsave")
    out = jobs.evaluate_job(catalog.samples(spark, SF), output_dir=base, save_predictions=True)
    saved = spark.read.options(**io.CSV_OPTS).csv(f"{base}/test_predictions.csv")
    assert saved.count() == out["scored"].count() == out["confusion"].agg(F.sum("n")).first()[0]


def test_train_job_with_language_feature_and_splits(spark):
    base = io.scratch_path(spark, "train")
    paths = {}
    for i, k in enumerate(("train", "val")):
        paths[k] = io.save_parquet(catalog.samples(spark, SF).where(f"id % 2 = {i}"), f"{base}/{k}")
    res = jobs.train_from_splits(spark, paths, f"{base}/out", candidates=({"regParam": 0.1, "maxIter": 5},), language_feature=True,
                                 class_weighted=False, num_features=1 << 10)
    assert res["candidates"].count() == 1 and res["best"].first()["val_macro_f1"] > 0
    again = C.classify(spark.read.parquet(f"{base}/out/val_with_languages.parquet"), C.load_model(f"{base}/out/classifier_best"))
    assert again.count() == spark.read.parquet(f"{base}/out/val_with_languages.parquet").count() > 0
    with pytest.raises(ValueError):
        jobs.train_job(catalog.samples(spark, SF), catalog.samples(spark, SF), stages=("classify",), language_feature=True)


def test_profile_job(spark):
    p = jobs.profile_job(catalog.samples(spark, SF))
    assert p["length_histogram"].count() == 50
    assert p["table_info"].count() == 4
    assert p["duplicate_count"].first()["n_duplicates"] >= 0


def test_train_save_load(spark):
    sp = sampling.stratified_split(clean.preprocess(catalog.samples(spark, SF)), "label", "id", seed=42)
    tr = sp.filter("split = 'train'").drop("split")
    va = sp.filter("split = 'val'").drop("split")
    res = C.train_classifier(tr, va, candidates=({"regParam": 0.1, "maxIter": 5},))
    assert res.candidates.count() == 1 and res.best.count() == 1
    p = io.scratch_path(spark, "model")
    C.save_model(res.model, p)
    a = C.classify(va, res.model).select("id", "predicted_label").collect()
    b = C.classify(va, C.load_model(p)).select("id", "predicted_label").collect()
    assert sorted(a) == sorted(b)


def test_language_feature_pipeline(spark):
    """M9: stage-1 language as an extra one-hot feature of stage 2."""
    from snippetflow.operators import detect
    sp = sampling.stratified_split(clean.preprocess(catalog.samples(spark, SF)), "label", "id", seed=42)
    tr = detect.detect_language(sp.filter("split = 'train'").drop("split"))
    va = detect.detect_language(sp.filter("split = 'val'").drop("split"))
    res = C.train_classifier(tr, va, candidates=({"regParam": 0.1, "maxIter": 5},),
                             language_feature="detected_language")
    out = C.classify(va, res.model)
    assert out.count() == va.count() and "predicted_label" in out.columns


def test_submission_without_ids(spark):
    p = io.scratch_path(spark, "noid") + "/t.parquet"
    texts = ["the of and", "der die das", "le la les", "el los las", "xyz", "und ist nicht"]
    spark.createDataFrame([(t,) for t in texts], "code string").coalesce(1).write.parquet(p)
    sub = jobs.submission_job(spark.read.parquet(p)).orderBy("id").collect()
    assert [r["id"] for r in sub] == list(range(6))
    assert [r["label"] for r in sub] == [1, 0, 3, 2, 0, 0]


def test_run_job_script(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import run_job
    base = io.scratch_path(spark, "script")
    for i, k in enumerate(("train", "val", "test")):
        io.save_parquet(catalog.samples(spark, SF).where(f"id % 3 = {i}"), f"{base}/{k}.parquet")
    run_job.main(["train", "--data", base, "--out", f"{base}/model", "--features", "1024", "--max-train", "50"], spark)
    run_job.main(["predict", "--data", f"{base}/test.parquet", "--out", f"{base}/sub", "--model", f"{base}/model/classifier_best"], spark)
    assert io.read_csv(spark, f"{base}/sub", io.SUBMISSION).count() == spark.read.parquet(f"{base}/test.parquet").count()
    out = run_job.main(["eval", "--data", f"{base}/test.parquet", "--out", f"{base}/eval", "--save-predictions", "--max-errors", "2"], spark)
    assert out["errors"].count() <= 2
    assert io.read_json(spark, f"{base}/eval/test_metrics.json", jobs.METRICS_SCHEMA).count() == 1


def test_samples_in_memory_and_with_a_declared_schema(spark):
    df = io.samples_from_rows(spark, [(1, "def f(): pass", 0, "Python"), (2, None, None, None)])
    assert df.schema == io.SAMPLE_SCHEMA and df.count() == 2
    path = io.save_parquet(df.withColumn("extra", F.lit(1)), io.scratch_path(spark, "declared"))
    assert io.load_samples(spark, path, io.SAMPLE_SCHEMA).columns == ["id", "code", "label", "language"]
    with pytest.raises(ValueError):
        io.load_samples(spark, io.save_parquet(df.drop("code"), io.scratch_path(spark, "nocode")))


def test_written_tables_are_dropped_at_the_end(spark):
    import os
    from snippetflow.session import cut_lineage, drop_tables, ensure_checkpoint_dir
    t = cut_lineage(spark.range(5))
    folder = f"{ensure_checkpoint_dir(spark)}/snippetflow-tables/{spark.sparkContext.applicationId}"
    assert t.count() == 5 and os.listdir(folder)
    drop_tables(spark)
    assert not os.path.exists(folder)


def test_submission_of_a_table_that_is_not_a_file(spark):
    df = spark.createDataFrame([(t,) for t in ("the of and", "der die das", "xyz")], "code string").coalesce(1)
    got = jobs.submission_job(df).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0), (2, 0)]
