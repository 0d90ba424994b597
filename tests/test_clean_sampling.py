"""Cleaning, order, sampling and splits, including partition invariance."""

import pytest
from pyspark.sql import functions as F

from snippetflow.operators import clean, sampling
from snippetflow.plans import jobs


def six(spark):
    return spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, "a"), (4, None), (5, "")],
                                 "id long, code string")


def ids(df, col="id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_preprocess_drop(spark):
    assert ids(clean.preprocess(six(spark))) == [0, 2, 5]


def test_preprocess_stringify(spark):
    out = clean.preprocess(six(spark), null_policy="stringify")
    assert ids(out) == [0, 1, 2, 5]
    assert out.filter("id = 1").first()["code"] == "None"


def test_preprocess_needs_code(spark):
    with pytest.raises(ValueError):
        clean.preprocess(spark.createDataFrame([(1,)], "id long"))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_sample_caps_and_invariance(spark, parts):
    df = spark.range(10).withColumnRenamed("id", "id").repartition(parts)
    assert sampling.sample_exact(df, None).count() == 10
    assert sampling.sample_exact(df, 0).count() == 10
    assert sampling.sample_exact(df, 10).count() == 10
    got = ids(sampling.sample_exact(df, 4, seed=42))
    base = ids(sampling.sample_exact(spark.range(10).coalesce(1), 4, seed=42))
    assert len(got) == 4 and got == base


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_dedup_and_row_ids_invariance(spark, parts):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 37).cast("string").alias("code")).repartition(parts)
    assert ids(clean.dedup_first(df)) == list(range(37))
    r = clean.dense_row_ids(df.withColumn("o", F.col("id") * 3), "o", out="rid")
    assert sorted((x["id"], x["rid"]) for x in r.collect()) == [(i, i) for i in range(200)]


def test_split_sizes(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("int"))
    c = {r["split"]: r["n"] for r in sampling.split_counts(sampling.stratified_split(df)).collect()}
    assert c == {"train": 700, "val": 200, "test": 100}
    big = spark.range(10000)
    c2 = {r["split"]: r["n"] for r in sampling.split_counts(sampling.stratified_split(big, None)).collect()}
    assert c2 == {"train": 6999, "val": 2001, "test": 1000}


def test_split_invariance_and_coverage(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 4).cast("int"))
    a = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(1)).collect()}
    b = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(13)).collect()}
    assert a == b and len(a) == 500


def test_split_rejects_tiny_class(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(10, 1)], "id long, label int")
    with pytest.raises(Exception):
        sampling.stratified_split(df).collect()


def test_row_id_resolution(spark):
    a = spark.createDataFrame([(7, "x")], "id long, code string")
    assert jobs.with_ids(a)[1] == "id"
    b = spark.createDataFrame([(7, "x")], "ID long, code string")
    assert jobs.with_ids(b)[1] == "ID"
    import tempfile
    p = tempfile.mkdtemp(prefix="sf-test-") + "/t.parquet"
    spark.createDataFrame([(c,) for c in "qwerty"], "code string").coalesce(1).write.parquet(p)
    out, col = jobs.with_ids(spark.read.parquet(p))
    assert col == "id"
    assert [r["code"] for r in out.orderBy("id").collect()] == list("qwerty")
    assert ids(out) == list(range(6))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_split_and_sample_do_not_depend_on_cells_or_partitions(spark, parts):
    df = spark.range(3000).select("id", (F.col("id") % 7 % 3).cast("int").alias("label")).repartition(parts)

    def split_of(d, buckets):
        return sorted((r["id"], r["split"]) for r in sampling.stratified_split(d, buckets=buckets).collect())

    base = split_of(df.coalesce(1), sampling.CELLS)
    for b in (1, 3, 64):
        assert split_of(df, b) == base
    flat = sorted((r["id"], r["split"]) for r in sampling.stratified_split(df, None, buckets=1).collect())
    assert flat == sorted((r["id"], r["split"]) for r in sampling.stratified_split(df.coalesce(1), None).collect())
    sample = ids(sampling.sample_exact(df.coalesce(1), 777, seed=7))
    assert len(sample) == 777
    for b in (1, 3, 64):
        assert ids(sampling.sample_exact(df, 777, seed=7, buckets=b)) == sample
    assert sampling.sample_exact(df, 5000).count() == 3000


def test_file_row_ids_across_files(spark):
    import tempfile
    from snippetflow.schema import file_row_ids, with_file_order
    p = tempfile.mkdtemp(prefix="sf-test-") + "/multi.parquet"
    spark.range(0, 500, 1, 7).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("code")) \
        .write.parquet(p)
    df = spark.read.parquet(p)
    assert len(df.inputFiles()) >= 3
    got = {r["k"]: r["rid"] for r in file_row_ids(df, "rid").collect()}
    ref = clean.dense_row_ids(with_file_order(df), "_ord", out="rid")
    assert got == {r["k"]: r["rid"] for r in ref.collect()}
    assert sorted(got.values()) == list(range(500))


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_running_offsets_two_level(spark, monkeypatch, bits):
    monkeypatch.setattr(sampling, "BLOCK_BITS", bits)
    rows = [(lab, b, 1 + (b * 7 + lab) % 5) for lab in (0, 1) for b in range(0, 300, 1 + lab)]
    cells = spark.createDataFrame(rows, "label int, _b int, _cnt long")
    got = {(r["label"], r["_b"]): r["_off"] for r in sampling.running_offsets(cells, ["label"], "_b", "_cnt").collect()}
    want, run = {}, {}
    for lab, b, c in sorted(rows):
        want[(lab, b)] = run.get(lab, 0)
        run[lab] = run.get(lab, 0) + c
    assert got == want
    flat = {r["_b"]: r["_off"] for r in sampling.running_offsets(cells.filter("label = 0").drop("label"), [], "_b", "_cnt").collect()}
    assert flat == {b: o for (lab, b), o in want.items() if lab == 0}
