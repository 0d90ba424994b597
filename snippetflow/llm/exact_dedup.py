"""Exact dedup by deterministic block naming (operator 9, DataFrame functions only).

A document's normalised bytes are cut into fixed-size blocks.  The distinct
blocks are sorted and numbered, so equal blocks and no others share an integer
name; then names of adjacent blocks are paired and the distinct pairs are
numbered in turn, until each document has one name.  Two documents are equal
exactly when they have as many blocks and the same last name.

Names travel to their places by a 64-bit hash of the block.  Whether any hash
stands for two different blocks is checked on the table of distinct blocks;
such blocks (there are none but by a freak) are named by a join on their full
bytes, so no result rests on a hash.

Defined cases: null text counts as empty; an empty normalised text is one empty
block and so one group; among equal texts the one with the most code points in
the original stays, then the smallest id (null last), then the first row; each
input row gives one output row, repeated rows included, and one row of a group
has ``kept``; an empty table gives no rows; columns other than the two named
are ignored by ``exact_groups`` and kept by ``drop_exact_copies``.

The row key is the position in the scan, so the input must be a table that is
read alike each time (files); it is written once, with the small columns, and
later steps read it from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetflow.llm.common import pick
from snippetflow.session import cut_lineage

BLOCK_BYTES = 8192
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "").cast("binary")


def _blocks(size: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("norm") / F.lit(size)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("norm", i * F.lit(size) + 1, F.lit(size)))


def _first_names(cut: DataFrame, occ: DataFrame) -> DataFrame:
    """occ (row, n_blocks, at, h) with the integer name of each block."""
    block = cut.select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("h"), "block")
    distinct = block.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("h", "block")
    names = cut_lineage(distinct.select("h", F.monotonically_increasing_id().alias("name")))
    twice = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    named = occ.join(names, "h").select("row", "n_blocks", "at", "name")
    if not twice.isEmpty():
        twice = cut_lineage(twice)
        named = occ.join(twice, "h", "left_anti").join(names, "h").select("row", "n_blocks", "at", "name")
        full = cut.select("row", "n_blocks", F.posexplode("blocks").alias("at", "block")).withColumn(
            "h", F.xxhash64("block")).join(twice, "h")
        by_bytes = full.groupBy("block").agg(F.min(F.struct("row", "at")).alias("at0"))
        # a negative name of its own for each such block: numbered in the sorted order of first places
        own = cut_lineage(by_bytes.sortWithinPartitions("at0").select(
            "block", (-1 - F.monotonically_increasing_id()).alias("name")))
        named = named.union(full.join(own, "block").select("row", "n_blocks", "at", "name"))
    return named


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: row (scan position), doc_id, keep_id, group_size,
    kept, text_sha256."""
    d = pick(docs, doc_id=doc_id, text=text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), normalised(F.col("text")).alias("norm"))
    cut = d.withColumn("blocks", _blocks(block_bytes)).withColumn("n_blocks", F.size("blocks"))
    narrow = cut_lineage(cut.select("row", "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), "n_blocks",
                                    F.transform("blocks", lambda b: F.xxhash64(b)).alias("hs")))
    occ = narrow.select("row", "n_blocks", F.posexplode("hs").alias("at", "h"))
    level = _first_names(cut, occ)
    most = narrow.agg(F.max("n_blocks")).first()[0] or 1
    if most > 1:
        level = cut_lineage(level)
    done = level.where("n_blocks = 1").select("row", "name")
    level = level.where("n_blocks > 1")
    left = most
    while left > 1:
        # left: blocks still held by the longest document at this level
        pair = level.groupBy("row", F.col("n_blocks"), F.expr("at div 2").alias("at")).agg(
            F.max(F.expr("case when at % 2 = 0 then name end")).alias("x"),
            F.max(F.expr("case when at % 2 = 1 then name end")).alias("y"))
        pair = cut_lineage(pair)
        names = cut_lineage(pair.select("x", "y").distinct().sortWithinPartitions("x", "y").select(
            "x", "y", F.monotonically_increasing_id().alias("name")))
        level = pair.alias("p").join(names.alias("q"), F.expr("p.x = q.x and p.y <=> q.y")).select(
            "p.row", "p.n_blocks", "p.at", "q.name")
        left = (left + 1) // 2
        level = cut_lineage(level.withColumn("whole", F.expr(f"ceil(n_blocks / {_span(most, left)}) <= 1")))
        done = done.union(level.where("whole").select("row", "name"))
        level = level.where("not whole").drop("whole")
    named = narrow.drop("hs").join(done, "row")
    named = cut_lineage(named)
    best = named.groupBy("n_blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("n"), F.isnull("doc_id").alias("z"), "doc_id", "row")).alias("best"))
    return named.join(best, ["n_blocks", "name"]).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def _span(most: int, left: int) -> int:
    """Blocks under one name at the level where the longest document has ``left``."""
    span = 1
    while most > left:
        most, span = (most + 1) // 2, span * 2
    return span


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_groups(docs, text, doc_id, block_bytes).where("not kept").select("row")
    names = docs.columns
    rows = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    gone = cut_lineage(gone)
    # merged at every size: what goes grows with the documents
    return rows.join(gone.withColumnRenamed("row", "_row").hint("merge"), "_row", "left_anti").drop("_row").toDF(*names)
