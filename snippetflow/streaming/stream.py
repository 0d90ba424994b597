"""Structured Streaming forms of the per-row stages.

Detection (M1) and classification (M5) are per-row, narrow expressions, so
the same ``predict_job`` runs on a streaming DataFrame.  The file sink with a
checkpoint in the shared checkpoint folder gives exactly-once output across
restarts and executor loss.  The running language distribution (A8) is a
stateful aggregate kept in Spark's state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snippetflow.functions.cues import TEXT_CUE_TABLE
from snippetflow.operators import detect
from snippetflow.plans.jobs import STAGES, predict_job
from snippetflow.schema import SAMPLE_SCHEMA
from snippetflow.sources.io import scratch_path


def read_samples_stream(spark: SparkSession, path: str, schema=SAMPLE_SCHEMA,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (a folder or a glob) as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def predict_stream(stream: DataFrame, sink_path: str, checkpoint: str | None = None,
                   stages=STAGES, detector=TEXT_CUE_TABLE, classifier=TEXT_CUE_TABLE,
                   available_now: bool = True) -> StreamingQuery:
    """Score each new batch of samples and append it to parquet at ``sink_path``."""
    spark = stream.sparkSession
    out = predict_job(stream, stages, detector, classifier)
    w = (out.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def language_counts_table_stream(stream: DataFrame, table_path: str, detector=TEXT_CUE_TABLE,
                                 checkpoint: str | None = None) -> StreamingQuery:
    """A8 over a stream into a durable table: the running counts per detected
    language live in the state store (checkpointed in the shared folder);
    after each micro-batch the complete K-row result is written under
    ``table_path`` in a folder named by the batch; the highest batch is the
    current result (``latest_counts``).  Replaying a batch after a failure
    rewrites the same counts, so the table is exact across restarts."""
    spark = stream.sparkSession
    counts = detect.language_distribution(detect.detect_language(stream, detector))

    def publish(batch: DataFrame, batch_id: int) -> None:
        # a folder of its own for each batch: a reader never meets a half-replaced table
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return (counts.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
            .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, table_path: str) -> DataFrame:
    """The counts of the highest batch under ``table_path``."""
    t = spark.read.parquet(table_path)
    return t.where(F.col("batch") == t.agg(F.max("batch")).scalar()).drop("batch")


def samples_view(stream: DataFrame) -> DataFrame:
    """documents-shaped rows -> sample contract (id, code, language)."""
    return stream.select(F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("lang").alias("language"))
