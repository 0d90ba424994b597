"""Seeded exact sampling and train / validation / test splits.

Randomness comes only from ``functions.rand.uniform(seed, id)``, so results
depend on the seed and the ids, never on partitioning or task retries.
Never ``rand()``, ``sample``, ``randomSplit`` or ``sampleBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.functions.rand import uniform
from snippetflow.operators.clean import numbered_ties
from snippetflow.schema import order_key
from snippetflow.session import cut_lineage

DEFAULT_SEED = 42
# Fine cells of the seeded uniform: floor(u * CELLS).  u is evenly spread,
# so every cell holds about N / CELLS rows; cell tables have at most CELLS
# rows per class.
CELLS = 1 << 20


def _cut_keys(keys: DataFrame, offs: DataFrame, targets: DataFrame, cuts: list) -> DataFrame:
    """The key (u, id) of the row at each target rank of each class, and how many of the
    rows that share this key come before that rank (``need``).

    ``keys``: label, _id, _u, _b; ``offs``: label, _b, _cnt, _off; ``targets``: label
    and one rank column per entry of ``cuts``.  Only the keys of the cell that holds a
    target rank are counted (about N / CELLS narrow rows each, one row per distinct key: repeated and null ids
    are summed before they meet in a window); the result has one row
    per class, with null where a class has no row of that rank.
    """
    marks = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("rank")) for c in cuts])
    t = targets.select("label", F.explode(marks).alias("t")).select(F.col("label").alias("_tl"), "t.cut", "t.rank")
    at = offs.join(t, F.col("label").eqNullSafe(F.col("_tl")) & (F.col("rank") >= F.col("_off"))
                   & (F.col("rank") < F.col("_off") + F.col("_cnt")))
    at = cut_lineage(at.select("_tl", F.col("_b").alias("_tb"), "cut", (F.col("rank") - F.col("_off")).alias("_nth")))
    per = keys.join(at, F.col("label").eqNullSafe(F.col("_tl")) & (F.col("_b") == F.col("_tb"))).groupBy("_tl", "cut", "_nth", "_u", "_id").agg(
        F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("_tl", "cut").orderBy("_u", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = per.withColumn("_before", F.sum("_m").over(w) - F.col("_m")).where("_before <= _nth and _nth < _before + _m")
    # the marker keeps a class whose label is null apart from a class without a cut
    key = F.struct("_u", "_id")
    return hit.groupBy("_tl").agg(*[F.max(F.when(F.col("cut") == c, F.struct(key.alias("key"), (F.col("_nth") - F.col("_before")).alias("need")))).alias(c) for c in cuts])


def sample_exact(df: DataFrame, n: int | None, seed: int = DEFAULT_SEED, id_col: str | None = None,
                 buckets: int = CELLS) -> DataFrame:
    """Exactly min(n, count) rows, the n smallest seeded uniforms (ties by id).

    ``n`` falsy (None or 0) means no cap.  Without ``id_col`` rows go by ``id``, ``ID`` or
    their place in the file.  Ids are counted per fine cell of u,
    two-level running sums find the cell that holds rank n, and the
    narrow keys of that cell give the first key outside the sample.  Every
    row is then decided by comparing its (u, id) with that one key: one scan
    of the rows, which are neither shuffled nor joined by id.

    Rows that share the cut key (repeated ids; null ids, which come last) are taken by
    position, as many as are missing: only these rows are written and numbered
    (``clean.numbered_ties``), over any number of partitions.
    """
    if not n:
        return df
    names = df.columns
    if id_col is None:
        df, id_col = order_key(df)
    keys = _rank_keys(df.withColumn("_one", F.lit(0)), "_one", id_col, seed, buckets)
    targets = df.sparkSession.range(1).select(F.lit(0).alias("label"), F.lit(int(n)).cast("long").alias("end"))
    cuts = cut_lineage(_cut_keys(keys, _cell_offsets(keys), targets, ["end"]).select("end.*"))
    found = cuts.select("need").first()
    keep = len(names) < len(df.columns)        # the added row key goes again
    if found is None:
        return df.drop(id_col) if keep else df
    cut, own = cuts.select("key").scalar(), _own(seed, id_col)
    out = df.where(own < cut)
    if found.need:
        tied = numbered_ties(df.where(own.eqNullSafe(cut)), [])
        out = out.union(tied.where(F.col("_tie") < found.need).drop("_tie"))
    return out.drop(id_col) if keep else out


def preview(df: DataFrame, n: int = 5, order_col: str = "id") -> DataFrame:
    """The first n rows in order (top-k; n is the bound)."""
    return df.orderBy(order_col).limit(n)


def _approximate_mode(counts: DataFrame, draws_col: str, count_col: str, out: str) -> DataFrame:
    """Per-class allocation of ``draws`` rows proportional to ``count``.

    floor(count / total * draws) per class, then the classes with the largest
    remainders (label ascending on ties) get one more until ``draws`` is met.
    Runs on the K-row class table only.
    """
    allw = Window.partitionBy(F.lit(0))
    c = (counts
         .withColumn("_tot", F.sum(count_col).over(allw))
         .withColumn("_cont", (F.col(count_col).cast("double") / F.col("_tot").cast("double"))
                     * F.col(draws_col).cast("double"))
         .withColumn("_fl", F.floor("_cont").cast("long"))
         .withColumn("_rem", F.col("_cont") - F.col("_fl"))
         .withColumn("_need", F.col(draws_col) - F.sum("_fl").over(allw))
         .withColumn("_rk", F.row_number().over(Window.partitionBy(F.lit(0))
                                                 .orderBy(F.desc("_rem"), F.asc("label")))))
    return (c.withColumn(out, F.col("_fl") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0))
            .drop("_tot", "_cont", "_fl", "_rem", "_need", "_rk"))


def split_quotas(class_counts: DataFrame, val_size: float = 0.2, test_size: float = 0.1) -> DataFrame:
    """(label, c, n_train, n_val, n_test) per class, as two successive shuffled
    stratified splits: test first, then validation out of the remainder."""
    allw = Window.partitionBy(F.lit(0))
    val_frac = val_size / (1 - test_size)   # same IEEE double as the reference's arithmetic
    q = (class_counts
         .withColumn("_n", F.sum("c").over(allw))
         .withColumn("_draw", F.col("_n") - F.ceil(F.lit(float(test_size)) * F.col("_n")).cast("long")))
    q = _approximate_mode(q, "_draw", "c", "trainval").drop("_n", "_draw")
    q = (q.withColumn("_m", F.sum("trainval").over(allw))
         .withColumn("_draw", F.col("_m") - F.ceil(F.lit(float(val_frac)) * F.col("_m")).cast("long")))
    q = _approximate_mode(q, "_draw", "trainval", "n_train").drop("_m", "_draw")
    q = q.withColumn("n_val", F.col("trainval") - F.col("n_train")) \
         .withColumn("n_test", F.col("c") - F.col("trainval"))
    # the check sits in n_train, which every consumer reads (never pruned)
    n_train = F.when(F.col("c") < 2, F.raise_error(F.lit("a class has fewer than 2 rows"))
                     ).otherwise(F.col("n_train"))
    return q.select("label", "c", n_train.cast("long").alias("n_train"), "n_val", "n_test")


def _late(seed: int, id_col: str):
    """The seeded uniform, or 2 for a null id: after all others."""
    return F.when(F.col(id_col).isNull(), F.lit(2.0)).otherwise(uniform(seed, id_col))


def _own(seed: int, id_col: str):
    return F.struct(_late(seed, id_col).alias("_u"), F.col(id_col).alias("_id"))


def _rank_keys(df: DataFrame, label: str, id_col: str, seed: int, buckets: int) -> DataFrame:
    keys = df.select(F.col(id_col).alias("_id"), F.col(label).alias("label"), _late(seed, id_col).alias("_u"))
    return keys.withColumn("_b", F.least(F.floor(F.col("_u") * buckets), F.lit(buckets)).cast("int"))


BLOCK_BITS = 10   # cells per block in the two-level running sum: 2^10


def running_offsets(cells: DataFrame, keys: list, order: str, count, block=None) -> DataFrame:
    """Add the sum of ``count`` over the rows before this one in ``order``
    within ``keys`` (one row per (keys, order)): column ``_off`` for one
    count column, ``_off_<name>`` for each of a list of them.

    Two levels, so no window holds many rows of one key: cells are grouped
    into blocks (``block``, default 2^BLOCK_BITS consecutive integer
    ``order`` values; it must not decrease with ``order``), a running sum
    over the block totals gives each block its offset, and a window inside
    each (keys, block) adds the cells before it.  A class with 2^20 cells is
    spread over 2^10 window tasks.
    """
    single = isinstance(count, str)
    counts = [count] if single else list(count)
    names = ["_off"] if single else [f"_off_{c}" for c in counts]
    blk = F.shiftright(F.col(order), BLOCK_BITS) if block is None else block
    c = cells.withColumn("_blk", blk)
    tot = c.groupBy(*keys, "_blk").agg(*[F.sum(x).alias(f"_bt{i}") for i, x in enumerate(counts)])
    frame = (Window.unboundedPreceding, Window.currentRow)
    bw = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_blk").rowsBetween(*frame)
    boff = tot.select(*keys, "_blk", *[(F.sum(f"_bt{i}").over(bw) - F.col(f"_bt{i}")).alias(f"_bo{i}")
                                       for i in range(len(counts))])
    iw = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(*frame)
    out = c.join(boff, [*keys, "_blk"])
    for i, (x, n) in enumerate(zip(counts, names)):
        out = out.withColumn(n, F.col(f"_bo{i}") + F.sum(x).over(iw) - F.col(x))
    return out.drop("_blk", *[f"_bo{i}" for i in range(len(counts))])


def _cell_offsets(keys: DataFrame) -> DataFrame:
    """(label, _b, _cnt, _off): rows per cell and rows of the class before it,
    by two-level running sums: a class that holds most rows is spread over the blocks of its cells."""
    cells = keys.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_lk"), F.col("label").isNull().alias("_ln"), "label", "_b").agg(
        F.count(F.lit(1)).alias("_cnt"))
    cells = cut_lineage(cells)
    return running_offsets(cells, ["_lk", "_ln"], "_b", "_cnt").select("label", "_b", "_cnt", "_off")


def stratified_split(df: DataFrame, label: str | None = "label", id_col: str | None = None,
                     val_size: float = 0.2, test_size: float = 0.1, seed: int = DEFAULT_SEED,
                     out: str = "split", buckets: int = CELLS) -> DataFrame:
    """Add ``split`` in {train, val, test}; stratified by ``label`` when given.

    Exact per-class quotas (``split_quotas``); a row's split is decided by its
    rank in its class by the seeded uniform (ties by id).  Without ``id_col`` rows go by ``id``, ``ID`` or their
    place in the file.  Rows without a
    label are a class of their own: every row gets a split.  The first keys
    (u, id) of validation and of test are found for each class from narrow keys only
    (``_cut_keys``), and a row compares its own (u, id) with the two of its
    class: one scan of the rows and a join with a written table of one row per class.
    Rows that share a class's cut key (repeated or null ids) are dealt by position, so the
    quotas hold whatever the ids are: only these rows are written and numbered.
    """
    names = df.columns
    if id_col is None:
        df, id_col = order_key(df)
    work = df if label else df.withColumn("_one", F.lit(0))
    lab = label or "_one"
    keys = _rank_keys(work, lab, id_col, seed, buckets)
    offs = cut_lineage(_cell_offsets(keys))
    quotas = split_quotas(offs.groupBy("label").agg(F.sum("_cnt").alias("c")), val_size, test_size)
    quotas = cut_lineage(quotas.select("label", F.col("n_train").alias("val"), (F.col("n_train") + F.col("n_val")).alias("test")))
    cuts = _cut_keys(keys, offs, quotas, ["val", "test"])
    table = cut_lineage(quotas.select(F.col("label").alias("_ql")).join(cuts, F.col("_ql").eqNullSafe(F.col("_tl")), "left")
                        .select("_ql", F.col("val.key").alias("_cv"), F.col("val.need").alias("_nv"), F.col("test.key").alias("_ct"), F.col("test.need").alias("_nt")))
    own = _own(seed, id_col)
    tie = F.coalesce("_tie", F.lit(0))
    # among rows at a cut key those before the quota; a class without validation rows has no key of that rank but its test key, and none at all without either
    before = lambda key, need: (own < F.col(key)) | (own.eqNullSafe(F.col(key)) & (tie < F.col(need)))
    split = (F.when(F.coalesce(before("_cv", "_nv"), before("_ct", "_nt"), F.lit(True)), F.lit("train"))
             .when(F.coalesce(before("_ct", "_nt"), F.lit(True)), F.lit("val")).otherwise(F.lit("test")))
    met = work.join(table, F.col(lab).eqNullSafe(F.col("_ql")), "left")
    no_tie = F.lit(None).cast("long")
    if table.where("_nv > 0 or _nt > 0").isEmpty():
        met = met.withColumn("_tie", no_tie)
    else:
        at_cut = F.coalesce(own.eqNullSafe(F.col("_cv")) & (F.col("_nv") > 0), F.lit(False)) | F.coalesce(own.eqNullSafe(F.col("_ct")) & (F.col("_nt") > 0), F.lit(False))
        met = met.where(~at_cut).withColumn("_tie", no_tie).unionByName(numbered_ties(met.where(at_cut), [lab, id_col]))
    res = met.withColumn(out, split).drop("_ql", "_cv", "_nv", "_ct", "_nt", "_tie", "_one")
    return res if id_col in names else res.drop(id_col)


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def load_splits(spark, paths: dict, caps: dict | None = None, seed: int = DEFAULT_SEED,
                id_col: str | None = None, schema=None) -> DataFrame:
    """Read the named split files, cap each with ``sample_exact`` and stack
    them with a ``split`` column (train / val capped, test uncapped by default)."""
    caps = caps or {}
    out = None
    for name, path in paths.items():
        r = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
        r = sample_exact(r, caps.get(name), seed, id_col).withColumn("split", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out
