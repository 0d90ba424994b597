"""The sample-table contract and id / order resolution.

A sample table has a ``code`` string column (mandatory) and optionally
``id`` (or ``ID``), ``label`` (int) and ``language`` (string).  Operators
that depend on row order take an explicit ``order_col``; Spark rows have no
implicit order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snippetflow.session import cut_lineage

SAMPLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("code", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("language", T.StringType(), True),
])

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("label", T.IntegerType(), True),
])


def require_code(df: DataFrame, code: str = "code") -> None:
    if code not in df.columns:
        raise ValueError(f"sample table needs a '{code}' column; has {df.columns}")


def has_column_exact(df: DataFrame, name: str) -> bool:
    """Exact-case test: Spark resolves names case-insensitively by default."""
    return name in df.columns


def id_column(df: DataFrame) -> str | None:
    """'id' if present, else 'ID', else None."""
    if has_column_exact(df, "id"):
        return "id"
    if has_column_exact(df, "ID"):
        return "ID"
    return None


def with_file_order(df: DataFrame, out: str = "_ord") -> DataFrame:
    """Add a numeric order column equal to file order for parquet inputs.

    Rows are ordered by (file path, row index within file); files are ranked
    by name through a distinct table with one row per file (a window over
    that table only, bounded by the file count).
    """
    base = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                     F.col("_metadata.row_index").alias("_ri"))
    files = base.select("_fp").distinct()
    # written, so its size is known when the join is planned
    ranked = cut_lineage(files.select("_fp", (F.dense_rank().over(Window.orderBy("_fp")) - 1)
                                      .cast("long").alias("_frank")))
    out_df = base.join(ranked, "_fp").withColumn(
        out, F.col("_frank") * F.lit(1 << 40) + F.col("_ri"))
    return out_df.drop("_fp", "_ri", "_frank")


def file_row_ids(df: DataFrame, out: str = "id") -> DataFrame:
    """F6/W2 for a file scan from which no rows were removed: the 0-based
    position of each row in file order (files by path, rows by their index
    inside the file), as the reference numbers a loaded table.

    id = (rows in the files before this one) + ``_metadata.row_index``.  Rows
    are counted per file (one row per file), a running sum over that table
    gives each file its offset, and the offsets, written as a table of known
    size, are joined back on the path: while that table is broadcast the rows
    themselves are never shuffled, sorted or numbered by a window.
    """
    base = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                     F.col("_metadata.row_index").alias("_ri"))
    per_file = base.groupBy("_fp").agg(F.count(F.lit(1)).alias("_fc"))
    # one row per file: this window is bounded by the file count
    offs = cut_lineage(per_file.select("_fp", (F.sum("_fc").over(Window.orderBy("_fp")) - F.col("_fc")).alias("_foff")))
    return (base.join(offs, "_fp").withColumn(out, (F.col("_foff") + F.col("_ri")).cast("long"))
            .drop("_fp", "_ri", "_foff"))


ROW_KEY = "_row"


def with_row_key(df: DataFrame, out: str = ROW_KEY) -> DataFrame:
    """Add the identity of each row of a table: struct(file, at).

    For a file scan (projected or not) it is the rank of the file's path and the row's index
    inside the file: the same in every evaluation, orderable, in file order, and found without moving rows (the
    ranks, one row per file, are joined).  Any other table is written once with
    (partition, position), since its rows have no lasting place."""
    try:
        base = df.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.row_index").alias("_ri"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        placed = cut_lineage(df.withColumn("_at", at))
        return placed.withColumn(out, F.struct(F.shiftright("_at", 33).alias("file"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))).drop("_at")
    files = base.select("_fp").distinct()
    ranked = cut_lineage(files.select("_fp", (F.dense_rank().over(Window.orderBy("_fp")) - 1).cast("long").alias("_frank")))
    return base.join(ranked, "_fp").withColumn(out, F.struct(F.col("_frank").alias("file"), F.col("_ri").alias("at"))).drop("_fp", "_ri", "_frank")


def order_key(df: DataFrame) -> tuple[DataFrame, str]:
    """The table and the column that orders its rows: ``id``, else ``ID``, else the
    row key, which is added where the table does not carry one yet."""
    name = id_column(df) or (ROW_KEY if ROW_KEY in df.columns else None)
    return (df, name) if name else (with_row_key(df), ROW_KEY)


def unique_key(df: DataFrame) -> tuple[DataFrame, str]:
    """The table and a column that no two rows share and that is never null: the row key, whatever its ids are."""
    return (df, ROW_KEY) if ROW_KEY in df.columns else (with_row_key(df), ROW_KEY)
