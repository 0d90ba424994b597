"""Parquet, CSV and JSON sources and sinks.

Writers go through Spark's committers (task output is committed only when a
task succeeds), so a lost executor never leaves half-written files behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snippetflow.schema import SAMPLE_SCHEMA, SUBMISSION_SCHEMA, require_code
from snippetflow.session import ensure_checkpoint_dir

CSV_OPTS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/snippetflow-out/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` when the scan yields fewer partitions than
    the session can run at once (e.g. one large single-row-group file), so
    per-row text work uses every core.  A scan of many files already has
    enough partitions and is left alone (no shuffle).  The target is the
    smaller of the shuffle partition count and the task slots; when the two
    agree, later joins on ``key`` reuse the layout."""
    spark = df.sparkSession
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = min(want, spark.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def read_table(spark: SparkSession, path: str, spread_key: str | None = None) -> DataFrame:
    """Parquet scan; optionally spread thin inputs over the cluster (``spread``)."""
    df = spark.read.parquet(path)
    return spread(df, spread_key) if spread_key else df


def load_samples(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema, only its columns are read (pruned scan)."""
    r = spark.read
    df = r.schema(schema).parquet(path) if schema is not None else r.parquet(path)
    require_code(df)
    return df


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S3: processed / enriched table."""
    df.write.mode(mode).parquet(path)
    return path


def save_partitioned(df: DataFrame, path: str, by: list[str], order_col: str, mode: str = "overwrite") -> str:
    """A table in folders by the values of ``by`` (e.g. split, detected_language),
    sorted by ``order_col`` in its files; reads that filter on ``by`` open only
    the matching folders.  Rows are range-partitioned on ``by`` and ``order_col`` together, so
    a value that most rows share is written by many tasks, and a task writes to few folders."""
    keys = [*by, order_col]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy(*by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """CSV with header; quotes doubled so multi-line text survives.
    ``single_file`` coalesces to one task: only for small outputs."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**CSV_OPTS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back a CSV written by ``write_csv`` (empty strings come back null)."""
    return spark.read.options(**CSV_OPTS).schema(schema).csv(path)


def submission(df: DataFrame, id_col: str = "id", pred: str = "predicted_label",
               id_column: str = "id", label_column: str = "label") -> DataFrame:
    """exactly two columns, renamed."""
    return df.select(F.col(id_col).alias(id_column), F.col(pred).alias(label_column))


def write_submission(df: DataFrame, path: str, **kw) -> str:
    """Two-column CSV with a header, written in parallel (one part file
    per task; the folder is the submission table)."""
    return write_csv(submission(df, **kw), path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines (one file: the metrics document is a handful of rows)."""
    df.coalesce(1).write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S7."""
    r = spark.read.option("multiLine", "false")
    return r.schema(schema).json(path) if schema is not None else r.json(path)


def samples_from_rows(spark: SparkSession, rows, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """An in-memory list of samples as a table (demo / tests)."""
    return spark.createDataFrame(rows, schema)


SUBMISSION = SUBMISSION_SCHEMA
