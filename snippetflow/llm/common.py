"""Column picking, code shipping and connected components shared by the operators."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetflow.session import cut_lineage


def ship_code() -> None:
    """Send this package's functions to the Python workers by value, so an
    executor needs no copy of the package on its path."""
    import snippetflow
    if "snippetflow" not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(snippetflow)


def position(df: DataFrame, name: str) -> int:
    """The place of a column: by its exact name, else regardless of case; the first of several."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"column {name!r} is missing; found {df.columns}")
    return at[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, doc_id="doc_id")``: those columns under new names; other
    columns never take part, whatever their names."""
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{position(df, name)}").alias(new) for new, name in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _forest(batches):
    """Edges of one task -> (node, smallest node it reaches within the task)."""
    import numpy as np
    import pyarrow as pa
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches if b.num_rows]
    if not got:
        return
    edges = np.concatenate(got)
    nodes, ids = np.unique(edges.ravel(), return_inverse=True)
    a, b = ids.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        # hook each root to the least root beside it, then let all nodes point at roots
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def components(edges: DataFrame, task_edges: int = 500_000, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable by ``edges`` (a, b, longs), for
    every node of an edge.

    Each round contracts the edges of a task (at most about ``task_edges``) to a
    forest.  While there are more tasks than one, a large-star and a small-star step
    join the forests: one min per node, partial before the shuffle, so that a node with very many
    edges is summed first, and one join that adaptive execution may split.
    The edges are written to the shared checkpoint folder after each round and
    never grow in number.
    """
    ship_code()
    edges = cut_lineage(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a")
        if large:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        tasks = max(1, -(-state[0] // task_edges))
        if state == seen and tasks > 1:
            break
        seen = state
        forest = edges.coalesce(tasks).mapInArrow(_forest, "a long, b long")
        if tasks == 1:
            edges = cut_lineage(forest)
            break
        edges = cut_lineage(star(star(forest, True), False))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


BITS = 1 << 23


def bit_of(col) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BITS))


def bitmap(keys: DataFrame, col: str):
    """A map of BITS bits (1 MB) with the bits of the keys' hashes: rows whose bit is not set
    are surely not among the keys."""
    import numpy as np
    at = bit_of(col) + 1
    got = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in got:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        out[(r.bucket - 1) * len(bits):r.bucket * len(bits)] = bits
    return np.packbits(out)
