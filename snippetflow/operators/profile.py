"""Data profile tables (notebook: A14-A19, A21, A22, F5, T3) and W4.

Each is one or two passes over the data with partial aggregation; exact
quantiles are taken over integer lengths, whose distinct values are bounded
by the longest text, so the quantile state stays small even at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.operators.clean import code_key
from snippetflow.operators.scan import running_sums
from snippetflow.session import cut_lineage

QUARTILES = [0.25, 0.5, 0.75]


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per non-null label."""
    return (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Percentage of non-null rows per label (window over K rows)."""
    lc = label_counts(df, label)
    return lc.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, position, n_missing) in one pass."""
    agg = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(f"c{i}")
                   for i, c in enumerate(df.columns)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"c{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)])).alias("m")).select("m.*")


def duplicate_count(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows beyond the first of each equal-code group (nulls are one group)."""
    key = F.coalesce(code_key(F.col(code)), F.lit(b""))
    groups = df.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg((F.sum("_c") - F.count(F.lit(1))).cast("long").alias("n_duplicates"))


def length_counts(df: DataFrame, code: str = "code", label: str | None = None) -> DataFrame:
    """(label, len, n): rows of each length, the one pass over the text that all
    length statistics read.  Partial on the map side; a table of at most
    labels x distinct lengths, written once."""
    cols = [F.length(F.col(code)).alias("len")] + ([F.col(label).alias("label")] if label else [])
    return cut_lineage(df.select(*cols).groupBy(*(["label"] if label else []), "len").agg(F.count(F.lit(1)).alias("n")))


def _quartiles() -> list:
    return [F.percentile("len", q, F.col("n")).alias(f"q{int(100 * q)}") for q in QUARTILES]


def length_describe(df: DataFrame, code: str = "code", counts: DataFrame | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles (linear), max of the code length."""
    c = (length_counts(df, code) if counts is None else counts).where("len is not null")
    n, s1, s2 = F.sum("n"), F.sum(F.col("len") * F.col("n")), F.sum((F.col("len").cast("long") * F.col("len")).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    s = c.agg(n.alias("count"), s1.alias("s1"), s2.alias("s2"), F.min("len").cast("long").alias("min"), *_quartiles(),
              F.max("len").cast("long").alias("max"))
    k, t = F.col("count"), F.col("s1").cast("decimal(38,0)")
    # exact sums, one rounding at the end
    spread = (F.col("s2").cast("decimal(38,0)") * k - t * t).cast("double")
    return s.select(F.coalesce(k, F.lit(0)).cast("long").alias("count"), (F.col("s1") / k).alias("mean"),
                    F.when(k > 1, F.sqrt(spread / (k.cast("double") * (k - 1)))).alias("std"), "min", "q25", "q50", "q75", "max")


def length_histogram(df: DataFrame, code: str = "code", bins: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """``bins`` equal-width bins from min to max length, last bin closed;
    (bin, lo, hi, n) including empty bins.  min == max: the range becomes
    min-0.5 .. max+0.5 and every row falls in the middle bin.

    Reads the length table only: one scalar subquery yields (min, max), one
    aggregate counts rows per bin; the bin list itself is a ``bins``-row range.
    """
    lens = (length_counts(df, code) if counts is None else counts).where("len is not null")
    mm = lens.agg(F.struct(F.min("len").alias("mn"), F.max("len").alias("mx")).alias("mm")).scalar()
    mn, mx = mm["mn"], mm["mx"]
    lo = F.when(mx > mn, mn.cast("double")).otherwise(mn - F.lit(0.5))
    width = F.when(mx > mn, (mx - mn).cast("double")).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col("len") - lo) * F.lit(float(bins)) / width), F.lit(bins - 1)).cast("int")
    per = lens.select(b.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(per, "bin", "left")
            .select("bin", (lo + width * F.col("bin") / bins).alias("lo"),
                    (lo + width * (F.col("bin") + 1) / bins).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def length_box_by_label(df: DataFrame, code: str = "code", label: str = "label", whis: float = 1.5,
                        counts: DataFrame | None = None) -> DataFrame:
    """Per label quartiles, whiskers at the extreme lengths inside
    q1 - 1.5 IQR .. q3 + 1.5 IQR, and the outlier count.  Rows without a label are
    a group of their own; a null length is an outlier."""
    lens = length_counts(df, code, label) if counts is None else counts
    q = lens.groupBy("label").agg(*_quartiles()).select(F.col("label").alias("_ql"), F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - whis * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + whis * (F.col("q3") - F.col("q1")))
    j = lens.join(q, F.col("label").eqNullSafe(F.col("_ql")))
    inside = F.coalesce((F.col("len") >= F.col("_lo")) & (F.col("len") <= F.col("_hi")), F.lit(False))
    return j.groupBy("label", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("len"))).cast("long").alias("whisker_low"),
        F.max(F.when(inside, F.col("len"))).cast("long").alias("whisker_high"),
        F.sum(F.when(inside | F.col("len").isNull(), 0).otherwise(F.col("n"))).cast("long").alias("n_outliers"),
        F.sum("n").cast("long").alias("n"))


def table_info(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null) - schema plus one counting pass."""
    agg = df.agg(*[F.count(F.col(c)).cast("long").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{i}").alias("non_null"))
        for i, f in enumerate(df.schema.fields)])).alias("m")).select("m.*")


def running_average(df: DataFrame, key: str, order_cols, value: str, weight: str | None = None,
                    out: str = "running_avg", bucket=None, bucket_block=None) -> DataFrame:
    """Running weighted mean sum(v*n)/sum(n) per key in order (AverageMeter).

    A parallel prefix scan (``scan.running_sums``): neither a key nor a stretch of its order is one task.
    With ``bucket`` (a Column non-decreasing in the order, e.g. the day of a
    timestamp) the prefix sums are two-level: per (key, bucket) totals get a
    running sum over buckets, and the row-level window runs inside one
    (key, bucket) only, so a key holding a large share of the rows is spread
    over many tasks.  ``bucket_block`` (a function of the bucket column, e.g.
    its day for minute buckets) makes the running sum over a key's buckets
    two-level as well (``sampling.running_offsets``), so no window holds all
    the buckets of a hot key either.
    """
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    # sums keep the input types (exact for decimals and integers); only the
    # final quotient is a double, so bucketed and plain sums agree exactly
    n = F.lit(1) if weight is None else F.col(weight)
    base = df.withColumn("_vn", F.col(value) * n).withColumn("_n", n)
    frame = (Window.unboundedPreceding, Window.currentRow)
    if bucket is None:
        res = running_sums(base, [key], order_cols, {"_num": F.col("_vn"), "_den": F.col("_n")})
        return res.withColumn(out, F.when(F.col("_den") != 0, F.col("_num").cast("double") / F.col("_den").cast("double"))).drop("_vn", "_n", "_num", "_den")
    b = base.withColumn("_b", bucket)
    cell = b.groupBy(key, "_b").agg(F.sum("_vn").alias("_cv"), F.sum("_n").alias("_cn"))
    if bucket_block is None:
        pw = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        pre = cell.select(key, "_b", F.coalesce(F.sum("_cv").over(pw), F.lit(0)).alias("_pv"),
                          F.coalesce(F.sum("_cn").over(pw), F.lit(0)).alias("_pn"))
    else:
        from snippetflow.operators.sampling import running_offsets
        pre = running_offsets(cell, [key], "_b", ["_cv", "_cn"], block=bucket_block(F.col("_b"))) \
            .select(key, "_b", F.col("_off__cv").alias("_pv"), F.col("_off__cn").alias("_pn"))
    w = Window.partitionBy(key, "_b").orderBy(*order_cols).rowsBetween(*frame)
    num = F.col("_pv") + F.sum("_vn").over(w)
    den = F.col("_pn") + F.sum("_n").over(w)
    res = b.join(pre, [key, "_b"]).withColumn(out, F.when(den != 0, num.cast("double") / den.cast("double")))
    return res.drop("_vn", "_n", "_b", "_pv", "_pn")
