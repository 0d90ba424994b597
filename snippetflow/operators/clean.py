"""Cleaning and order-dependent row operators.

Order semantics: the reference keeps the first row of a duplicate group and
numbers rows 0..n-1 by position.  Spark rows have no order, so these
operators take an explicit, unique ``order_col`` (default ``id``; for files
without ids see ``schema.with_file_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.schema import order_key, require_code
from snippetflow.session import cut_lineage

NULL_POLICIES = ("drop", "stringify")


def code_key(code: Column) -> Column:
    """32-byte SHA-256 of the text: the grouping key used instead of the text."""
    return F.unhex(F.sha2(code, 256))


def cast_code(df: DataFrame, code: str = "code") -> DataFrame:
    """code as string."""
    return df.withColumn(code, F.col(code).cast("string"))


def handle_null_code(df: DataFrame, code: str = "code", null_policy: str = "drop") -> DataFrame:
    """drop rows with null code, or turn null into the text 'None'."""
    if null_policy == "drop":
        return df.filter(F.col(code).isNotNull())
    if null_policy == "stringify":
        return df.withColumn(code, F.coalesce(F.col(code), F.lit("None")))
    raise ValueError(f"null_policy must be one of {NULL_POLICIES}")


def numbered_ties(df: DataFrame, keys: list, out: str = "_tie") -> DataFrame:
    """0-based number of each row among those equal in ``keys`` (null equals null), in the
    present order of partitions and rows.

    The rows are written once with their place; counts per (partition, key) give each partition its
    offset, so the rows of one key may fill any number of partitions: a window holds
    those of one partition and key only."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))
    placed = cut_lineage(df.withColumns({"_nt_at": F.monotonically_increasing_id(), "_nt_k": key})).withColumn("_nt_p", F.shiftright("_nt_at", 33))
    counts = placed.groupBy("_nt_p", "_nt_k").agg(F.count(F.lit(1)).alias("_nt_n"))
    before = Window.partitionBy("_nt_k").orderBy("_nt_p").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = cut_lineage(counts.select("_nt_p", "_nt_k", F.coalesce(F.sum("_nt_n").over(before), F.lit(0)).alias("_nt_off")))
    own = F.row_number().over(Window.partitionBy("_nt_p", "_nt_k").orderBy("_nt_at")) - 1
    numbered = placed.withColumn("_nt_i", own).join(offsets, ["_nt_p", "_nt_k"])
    return numbered.withColumn(out, (F.col("_nt_off") + F.col("_nt_i")).cast("long")).drop("_nt_p", "_nt_k", "_nt_at", "_nt_off", "_nt_i")


def dedup_first(df: DataFrame, subset: str = "code", order_col: str | None = None) -> DataFrame:
    """Keep the first row (lowest order_col) of each group of equal ``subset``.

    Without ``order_col`` rows are ordered by ``id``, ``ID`` or their place in the file
    (``schema.order_key``).  No row is lost and none is kept twice: a null order value counts as
    later than any other, and of rows equal in both ``subset`` and order the first by
    position stays (only such rows are written and numbered).

    The text is not grouped: ``(sha256(subset), order_col)`` keys are
    aggregated (fixed-width, partial on the map side, so a text repeated in
    a third of all rows shrinks to one key per map task) and only groups of
    more than one row are written, as a table of known size.  Rows are
    then checked against that table; while it is small it is broadcast and
    the text stays where it was read, else the join shuffles.
    Equals ``row_number() over (partition by subset order by order_col nulls last) = 1``.
    """
    names = df.columns
    if order_col is None:
        df, order_col = order_key(df)
    all_names = df.columns
    # columns go by place, so any name will do, a dot in it or another's name in capitals
    df = df.toDF(*(f"_d{i}" for i in range(len(all_names))))
    at = _place(all_names, order_col)
    key, order = code_key(F.col(f"_d{_place(all_names, subset)}")), F.col(f"_d{at}")
    keys = df.select(key.alias("_dd_h"), order.alias("_dd_o"))
    per = keys.groupBy("_dd_h", "_dd_o").agg(F.count(F.lit(1)).alias("_dd_n"))
    groups = per.groupBy("_dd_h").agg(F.sum("_dd_n").alias("_dd_rows"), F.min("_dd_o").alias("_dd_first"),
                                      F.min(F.struct(F.col("_dd_o").isNull(), "_dd_o", F.col("_dd_n").alias("n"))).alias("_dd_least"))
    first = groups.where("_dd_rows > 1")
    first = cut_lineage(first.select("_dd_h", "_dd_first", (F.col("_dd_least.n") > 1).alias("_dd_tied")))
    met = df.withColumn("_dd_k", key).join(first, F.col("_dd_k").eqNullSafe(F.col("_dd_h")), "left")
    met = met.where(F.col("_dd_tied").isNull() | F.col("_dd_first").eqNullSafe(order))
    out = met.where("_dd_tied is null or not _dd_tied").select(*df.columns)
    if not first.where("_dd_tied").isEmpty():
        tied = numbered_ties(met.where("_dd_tied").select(*df.columns, "_dd_k"), ["_dd_k"], "_dd_tie")
        out = out.unionByName(tied.where("_dd_tie = 0").select(*df.columns))
    return out.select(*(F.col(f"_d{i}").alias(n) for i, n in enumerate(all_names[:len(names)])))


def _place(names: list, name: str) -> int:
    """The place of a column by its exact name, else regardless of case."""
    at = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not at:
        raise ValueError(f"column {name!r} is missing; has {names}")
    return at[0]


def preprocess(df: DataFrame, code: str = "code", null_policy: str = "drop",
               order_col: str | None = None) -> DataFrame:
    """cast code to string, handle nulls, drop duplicate codes keeping the first
    (by ``id``, ``ID`` or the place in the file where no ``order_col`` is given)."""
    require_code(df, code)
    names = df.columns
    if order_col is None:
        df, order_col = order_key(df)
    out = handle_null_code(cast_code(df, code), code, null_policy)
    out = dedup_first(out, code, order_col)
    return out if len(out.columns) == len(names) else out.drop(order_col)


def short_codes(df: DataFrame, code: str = "code", min_chars: int = 10) -> DataFrame:
    """rows whose code is shorter than ``min_chars`` characters."""
    return df.filter(F.length(F.col(code)) < F.lit(min_chars))


def dense_row_ids(df: DataFrame, order_cols, out: str = "row_id") -> DataFrame:
    """0-based dense position of each row in the order of ``order_cols``.

    Rows are range-partitioned on all order columns (a value that most rows
    share in one column is cut by the others), sorted within their partition and written
    once with their place in it; the counts per partition (one row each) give
    each partition its offset.  No window and no driver sketch; any orderable
    column type works.
    """
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    return position_ids(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols), out)


def position_ids(df: DataFrame, out: str = "row_id") -> DataFrame:
    """0-based position of each row in the present order of partitions and rows,
    which is written once so that it cannot change."""
    # the id of a partition's rows counts up from partition << 33 in their order
    placed = cut_lineage(df.withColumn("_dr_at", F.monotonically_increasing_id()))
    part = F.shiftright("_dr_at", 33)
    counts = placed.groupBy(part.alias("_dr_p")).agg(F.count(F.lit(1)).alias("_dr_n"))
    w = Window.orderBy("_dr_p").rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    offsets = cut_lineage(counts.select("_dr_p", F.coalesce(F.sum("_dr_n").over(w), F.lit(0)).alias("_dr_off")))
    return (placed.join(offsets, part == F.col("_dr_p"))
            .withColumn(out, (F.col("_dr_off") + F.col("_dr_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
            .drop("_dr_at", "_dr_p", "_dr_off"))
