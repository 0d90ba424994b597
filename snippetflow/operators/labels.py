"""Label maps, class weights and the joins that attach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_MAP_SCHEMA = T.StructType([T.StructField("label", T.IntegerType(), True),
                                 T.StructField("name", T.StringType(), True)])


def label_map(df: DataFrame, label: str = "label", language: str = "language",
              order_col: str = "id", generic_prefix: str = "Language_") -> DataFrame:
    """(label, name).

    With a language column: among distinct (label, language) pairs, the pair
    whose first occurrence is latest wins for its label (a dict built from the
    pairs in first-occurrence order keeps the last one).  Without it: every
    distinct label named ``Language_<label>``.  Without a label column: empty.
    """
    spark = df.sparkSession
    if label not in df.columns:
        return spark.createDataFrame([], LABEL_MAP_SCHEMA)
    if language in df.columns:
        pairs = df.groupBy(label, language).agg(F.min(order_col).alias("_first"))
        return pairs.groupBy(F.col(label).alias("label")).agg(
            F.max_by(F.col(language), F.col("_first")).alias("name"))
    return (df.select(F.col(label).alias("label")).distinct()
            .select("label", F.concat(F.lit(generic_prefix), F.col("label").cast("string")).alias("name")))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights n / (k * n_c) over the K-row count table."""
    from pyspark.sql import Window
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy(F.lit(0))
    return counts.select("label", "n", (F.sum("n").over(allw).cast("double")
                                        / (F.count(F.lit(1)).over(allw) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "label",
                      out: str = "weight") -> DataFrame:
    """Attach each row's class weight (weights hold one row per class)."""
    w = weights.select(F.col("label").alias("_wl"), F.col("weight").alias(out))
    return df.join(w, F.col(label).eqNullSafe(F.col("_wl")), "left").drop("_wl")


def inverse_label_map(label_map_df: DataFrame) -> DataFrame:
    """(name, label): the lowest label per name, for turning names into labels."""
    return label_map_df.groupBy("name").agg(F.min("label").alias("label"))


def distinct_names(label_map: DataFrame) -> DataFrame:
    """The label map with every name that several labels share followed by its label, so names can be keys."""
    n = label_map.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    both = F.concat(F.col("name"), F.lit("_"), F.col("label").cast("string"))
    return label_map.join(n, "name", "left").select("label", F.when(F.col("_n") > 1, both).otherwise(F.col("name")).alias("name"))
