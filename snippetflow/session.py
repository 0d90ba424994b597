"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "snippetflow") -> SparkSession:
    """Session for tests and local runs; on a cluster spark-submit supplies master."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is only filled in when the session has none (tests, local runs);
    a cluster names a shared folder there and we use it as is.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        current = fallback or os.environ.get("SNIPPETFLOW_CHECKPOINT_DIR")
        if not current:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder")
            import tempfile
            current = tempfile.mkdtemp(prefix="snippetflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as a parquet table in the shared checkpoint folder
    and return a DataFrame reading it back.

    Used where a result is read by several later stages and must be computed
    once and survive executor loss.  One write job computes the plan once
    (``Dataset.checkpoint`` would compute it twice: once to count, once to
    write), the files are compressed and columnar, and later reads get column
    pruning and filter pushdown.  Never a local checkpoint.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/snippetflow-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` has returned and that nothing reads any more."""
    spark = df.sparkSession
    home = f"/snippetflow-tables/{spark.sparkContext.applicationId}/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if home in path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables ``cut_lineage`` has written in this application.

    Results read from them lazily, so call it when these have been written
    elsewhere: at the end of a job, or between independent jobs of one session."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/snippetflow-tables/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
