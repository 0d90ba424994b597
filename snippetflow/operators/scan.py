"""Running sums per key over tables of any size and skew (used by W4).

A parallel prefix scan in two passes: rows are range-partitioned by key and order and
written with their place, so a partition holds a contiguous stretch of the whole order and a key
with most rows fills many of them.  Sums within a (partition, key) come from
windows no larger than a partition; what earlier partitions have of a partition's first key is
one row per partition, found by running sums over that small table and added by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.session import cut_lineage


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict) -> DataFrame:
    """``df`` with a column per entry of ``values`` ({name: Column}): the sum of that column
    over the rows of the same ``keys`` up to and including this one in ``order``.

    Sums keep their exact type for integers and decimals.  Null keys are a key of their own; a null value adds
    nothing (a sum over nulls alone is null).  Rows equal in ``order`` are summed one after
    the other, in any order.  The input is read twice (the range partition samples it)."""
    names = list(values)
    cols = [f"_rs_v{i}" for i in range(len(names))]
    rows = df.withColumns({c: v for c, v in zip(cols, values.values())})
    placed = cut_lineage(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_rs_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_rs_p": F.shiftright("_rs_at", 33), "_rs_k": F.struct(*keys)})
    per = placed.groupBy("_rs_p", "_rs_k").agg(F.min("_rs_at").alias("lo"), F.max("_rs_at").alias("hi"), *[F.sum(c).alias(c) for c in cols])
    # one row per partition: its first key, and its last key with that key's sums
    ends = per.groupBy("_rs_p").agg(F.min_by("_rs_k", "lo").alias("first"), F.max_by(F.struct("_rs_k", *cols), "hi").alias("last"))
    same, line = Window.partitionBy("k").orderBy("_rs_p"), Window.orderBy("_rs_p")
    ends = ends.select("_rs_p", "first", F.col("last._rs_k").alias("k"), *[F.col(f"last.{c}").alias(c) for c in cols])
    ends = ends.select("_rs_p", "first", "k", *[F.sum(c).over(same).alias(c) for c in cols])
    ends = ends.select(F.col("_rs_p").alias("_rs_ep"), F.col("first").alias("_rs_ek"), F.lag("k").over(line).alias("before"), *[F.lag(c).over(line).alias(f"{c}_c") for c in cols])
    carry = cut_lineage(ends.where("_rs_ek = before").drop("before"))
    own = Window.partitionBy("_rs_p", "_rs_k").orderBy("_rs_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.select("*", *[F.sum(c).over(own).alias(f"{c}_s") for c in cols]).join(
        carry, (F.col("_rs_p") == F.col("_rs_ep")) & (F.col("_rs_k") == F.col("_rs_ek")), "left")

    def total(c):
        return F.when(F.col(f"{c}_c").isNull(), F.col(f"{c}_s")).otherwise(F.col(f"{c}_c") + F.coalesce(F.col(f"{c}_s"), F.lit(0)))
    return met.select(*df.columns, *[total(c).alias(n) for n, c in zip(names, cols)])
