"""Hot keys: one text, one class and one user each hold a third of all rows.

Results are checked against brute force in pandas; the operators must give
the same answers with the hot group as without it (no rows dropped, capped
or sampled to get around the skew).
"""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from snippetflow.operators import clean, metrics, profile, sampling

N = 3000


def hot_samples(spark):
    rows = [(i, "HOT TEXT" if i % 3 == 0 else f"text {i % 1700}", 0 if i % 3 == 1 else 1 + i % 4)
            for i in range(N)]
    return spark.createDataFrame(rows, "id long, code string, label int").repartition(7), \
        pd.DataFrame(rows, columns=["id", "code", "label"])


def test_dedup_with_a_hot_text(spark):
    df, pdf = hot_samples(spark)
    want = sorted(pdf.sort_values("id").drop_duplicates("code")["id"].tolist())
    assert sorted(r["id"] for r in clean.dedup_first(df).select("id").collect()) == want
    dup = profile.duplicate_count(df).first()["n_duplicates"]
    assert dup == int(pdf["code"].duplicated().sum())


def test_confusion_and_split_with_a_hot_class(spark):
    df, pdf = hot_samples(spark)
    scored = df.withColumn("predicted_label", (F.col("id") % 2).cast("int"))
    got = {(r["true_label"], r["predicted_label"]): r["n"] for r in metrics.confusion_counts(scored).collect()}
    pdf["pred"] = pdf["id"] % 2
    want = pdf.groupby(["label", "pred"]).size().to_dict()
    assert got == {k: int(v) for k, v in want.items()}
    split = sampling.stratified_split(df)
    per = {(r["label"], r["split"]): r["n"] for r in split.groupBy("label", "split").count()
           .withColumnRenamed("count", "n").collect()}
    sizes = pdf.groupby("label").size().to_dict()
    for lab, c in sizes.items():
        assert sum(per.get((lab, s), 0) for s in ("train", "val", "test")) == c
    assert split.count() == N and split.select("id").distinct().count() == N
    one_cell = sorted((r["id"], r["split"]) for r in sampling.stratified_split(df, buckets=1).collect())
    assert sorted((r["id"], r["split"]) for r in split.collect()) == one_cell


def test_running_average_with_a_hot_user(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, 7 if i % 3 == 0 else i % 50, t0 + datetime.timedelta(seconds=37 * i), float(i % 11), 1 + i % 4)
            for i in range(N)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, v double, k int")
    got = profile.running_average(df, "user_id", ["ts", "event_id"], "v", "k",
                                  bucket=F.date_trunc("minute", "ts"))
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "v", "k"]).sort_values(["user_id", "ts", "event_id"])
    pdf["vn"] = pdf["v"] * pdf["k"]
    g = pdf.groupby("user_id")
    pdf["want"] = g["vn"].cumsum() / g["k"].cumsum()
    want = dict(zip(pdf["event_id"], pdf["want"]))
    for r in got.select("event_id", "running_avg").collect():
        assert abs(r["running_avg"] - want[r["event_id"]]) < 1e-9
    blocked = profile.running_average(df, "user_id", ["ts", "event_id"], "v", "k",
                                      bucket=F.date_trunc("minute", "ts"),
                                      bucket_block=lambda b: F.date_trunc("hour", b))
    for r in blocked.select("event_id", "running_avg").collect():
        assert abs(r["running_avg"] - want[r["event_id"]]) < 1e-9
