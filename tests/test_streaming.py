"""Streaming forms of the per-row stages agree with the batch job."""

from snippetflow.plans import catalog, jobs
from snippetflow.sources import io
from snippetflow.streaming import stream as S

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_predict_stream_matches_batch(spark):
    src = S.read_samples_stream(spark, f"{SF}/documents*.parquet", DOC_SCHEMA)
    sink = io.scratch_path(spark, "stream-out")
    q = S.predict_stream(S.samples_view(src), sink)
    q.awaitTermination(120)
    got = {r["id"]: (r["detected_language"], r["predicted_label"]) for r in spark.read.parquet(sink).collect()}
    want = {r["id"]: (r["detected_language"], r["predicted_label"])
            for r in jobs.predict_job(catalog.samples(spark, SF)).collect()}
    assert got == want


def test_language_counts_table_across_micro_batches(spark):
    from pyspark.sql import functions as F
    from snippetflow.operators import detect
    src_dir = io.scratch_path(spark, "stream-src")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id").write.parquet(src_dir)
    stream = S.read_samples_stream(spark, src_dir, DOC_SCHEMA, max_files_per_trigger=1)
    table = io.scratch_path(spark, "stream-langs")
    q = S.language_counts_table_stream(S.samples_view(stream), table)
    q.awaitTermination(180)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    got = {r["language"]: r["n"] for r in S.latest_counts(spark, table).collect()}
    want = {r["language"]: r["n"] for r in
            detect.language_distribution(detect.detect_language(catalog.samples(spark, SF))).collect()}
    assert got == want
