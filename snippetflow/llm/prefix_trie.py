"""Prefix trie of conversations by parallel tree contraction (operator 12).

A node is a distinct sequence of the first d turns (role and text); the members of
a node are the conversations that start with it, and the root (d = 0) has them all.
For each node: its members and children, and over its subtree the childless
nodes and the code points that sharing a node's last text saves.

Turns are known by 120 bits of SHA-256 from the scan on; texts are never
shuffled.  A prefix is named by its depth and 128 bits: the XOR over its turns
of hashes of (place, turn).  Places and prefix names come from segmented scans: rows are
range-partitioned by conversation and place, each partition is scanned in order, and what a partition hands on to
the next (one row per partition) is added by a join, so one conversation that
holds most rows is spread over many tasks.

Subtree totals come from tree contraction.  Each round is a few joins: *rake* adds the
totals of all leaves to their parents and removes them, *compress* splices out nodes with a single child, no two
of them adjacent (alternate levels first: bit r of the depth in round r; then a hashed coin), handing their totals to their parents
and noting (node, child, totals).  A chain of n nodes takes about log2(n)
rounds.  When only the root is left, rounds are undone in reverse:
a raked leaf's total is what it had, a spliced node's is its own plus its child's.

The digest of a node's ends (conversations of just its turns) is a SHA-256 over
their ids in order: groups inside one range partition are hashed there; only a
group cut by a partition's edge is hashed from joined pieces by one task, since SHA-256 has no
parallel form, streaming and with bounded memory.

Defined cases: turns are ordered by turn (null first), those of equal turn by
role and digest of the text; null role or text is empty; rows without a conv_id belong to no conversation;
repeated rows are turns of their own; an empty table has no node, not even a root; columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.llm.common import pick, ship_code
from snippetflow.session import cut_lineage

FAMILY = 100
HEADS = 6
ROOT = -1
PIECE_BYTES = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def read_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, a, b, len): each row with 120 bits of its role and text, and its code points."""
    rows = pick(convs, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("len")).select(
        "conv_id", "turn", "role", part(1).alias("a"), part(16).alias("b"), "len")


def running(df: DataFrame, key: str, order: list[str], xors: tuple = ()) -> DataFrame:
    """``df`` with ``at``, the 0-based place of each row among those of its ``key``
    (long) in ``order``, and the columns ``xors`` replaced by their XOR up to this row.

    The input should be a written table: the range partition samples it first."""
    fields, names = df.schema.fields, df.columns
    n_cols, key_at, xor_at = len(names), names.index(key), [names.index(x) for x in xors]

    def scan(batches):
        last, n, x = None, 0, [0] * len(xor_at)        # the last key so far, its rows and its XORs
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key_at).to_numpy()
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            carried = (run == 0) & (last is not None and bool(k[0] == last))
            at = np.arange(len(k)) - first[run] + np.where(carried, n, 0)
            cols = list(b.columns)[:n_cols]
            for i, c in enumerate(xor_at):
                total = np.bitwise_xor.accumulate(cols[c].to_numpy())
                before = np.append(0, total)[first]
                total = total ^ before[run] ^ np.where(carried, x[i], 0)
                cols[c] = pa.array(total)
                x[i] = int(total[-1])
            last, n = k[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at), b.column(n_cols)], names=[*names, "at", "part"])

    ship_code()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", at long, part int"
    placed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())
    local = cut_lineage(placed.mapInArrow(scan, schema))
    # one row per partition: its first key, and its last one with that key's totals in it
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max_by(F.struct(F.col(key).alias("k"), (F.col("at") + 1).alias("n"), *xors), F.struct(key, "at")).alias("last"))
    same, line = Window.partitionBy("k").orderBy("part"), Window.orderBy("part")
    ends = ends.select("part", "first", "last.*").withColumn("n", F.sum("n").over(same))
    for c in xors:
        ends = ends.withColumn(c, F.bit_xor(c).over(same))
    ends = ends.select(F.col("part").alias("_part"), F.col("first").alias("_first"), F.lag("k").over(line).alias("_k"), F.lag("n").over(line).alias("_n"),
                       *[F.lag(c).over(line).alias(f"_x_{c}") for c in xors]).where("_first = _k")
    met = local.join(cut_lineage(ends), (F.col("part") == F.col("_part")) & (F.col(key) == F.col("_first")), "left")
    return met.select(*[F.col(c).bitwiseXOR(F.coalesce(f"_x_{c}", F.lit(0))).alias(c) if c in xors else c for c in names],
                      (F.col("at") + F.coalesce("_n", F.lit(0))).alias("at"))


def conversations(convs: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, len, last): the turns of every conversation in order, as they are."""
    turns = running(cut_lineage(read_turns(convs)), "conv_id", ["turn", "role", "a", "b"])
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    return turns.join(sizes, "conv_id").select("conv_id", F.col("at").alias("place"), "a", "b", "len", (F.col("at") + 1 == F.col("n_own")).alias("last"))


def branched(convs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``conversations`` rebuilt as branches: each conv_id c starts with the first h turns of
    conversation c - c % family, h = crc32(c) % heads, and goes on with its own turns after
    its first h.  A conversation left without turns has one row whose place is null."""
    turns = cut_lineage(running(cut_lineage(read_turns(convs)), "conv_id", ["turn", "role", "a", "b"]))
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    ids = ids.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    # at most heads - 1 turns of each first conversation of a family
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("at") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("at", "a", "b", "len"))).alias("first"))
    ids = ids.join(first, "base", "left").withColumn("first", F.coalesce(F.expr("slice(first, 1, cast(h as int))"), F.expr("array()").cast(first.schema["first"].dataType)))
    ids = cut_lineage(ids.select("conv_id", "n_own", "h", "first", F.size("first").cast("long").alias("n_first")))
    more = F.col("n_own") > F.col("h")
    head = ids.select("conv_id", (~more).alias("ends"), "n_first", F.explode_outer("first").alias("t")).where("t is not null or ends")
    head = head.select("conv_id", F.col("t.at").alias("place"), "t.a", "t.b", "t.len", (F.col("ends") & F.coalesce(F.col("t.at") + 1 == F.col("n_first"), F.lit(True))).alias("last"))
    own = turns.join(ids.select("conv_id", "n_own", "h", "n_first"), "conv_id").where("at >= h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("n_first")).alias("place"), "a", "b", "len", (F.col("at") + 1 == F.col("n_own")).alias("last"))
    return head.unionByName(own)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256) of (x, y, depth, conv_id): the ids of each group in order, comma-joined."""
    ship_code()

    def groups(b):
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) if b.num_rows else np.zeros(0, bool)
        first = np.flatnonzero(new)
        for lo, hi in zip(first.tolist(), np.append(first, b.num_rows)[1:].tolist()):
            yield tuple(int(c[lo]) for c in cols[:3]), ",".join(map(str, cols[3][lo:hi].tolist())).encode()

    def local(batches):
        """Whole groups hashed; the first and the last group of the partition, which others may share, as pieces of text."""
        part, key, text, seq, n_groups, rows = 0, None, [], 0, 0, []

        def piece(body):
            nonlocal seq
            rows.append((*key, part, seq, body, None))
            seq += 1

        def close(edge):
            if edge or seq:
                piece(b",".join(text))
            else:
                rows.append((*key, part, 0, None, hashlib.sha256(b",".join(text)).hexdigest()))

        def out():
            got = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()))],
                                              names=["x", "y", "depth", "part", "seq", "piece", "ends_sha256"])

        for b in batches:
            for k, ids in groups(b):
                if k != key:
                    if key is not None:
                        close(n_groups == 1)
                    key, text, seq, n_groups = k, [], 0, n_groups + 1
                    part = int(b.column(4)[0].as_py())
                text.append(ids)
                if sum(map(len, text)) >= PIECE_BYTES:
                    piece(b",".join(text))
                    text = []
            if rows:
                yield out()
        if key is not None:
            close(True)
            yield out()

    def joined(batches):
        key, sha = None, None
        for b in batches:
            rows = []
            for x, y, d, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if (x, y, d) != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha, empty = (x, y, d), hashlib.sha256(), True
                if body:
                    sha.update(body if empty else b"," + body)
                    empty = False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["x", "y", "depth", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, sha.hexdigest())], names=["x", "y", "depth", "ends_sha256"])

    keys = ["x", "y", "depth", "conv_id"]
    placed = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    got = cut_lineage(placed.mapInArrow(local, "x long, y long, depth long, part int, seq int, piece binary, ends_sha256 string"))
    whole = got.where("ends_sha256 is not null").select("x", "y", "depth", "ends_sha256")
    cut = got.where("ends_sha256 is null").repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "part", "seq")
    return whole.unionByName(cut.mapInArrow(joined, "x long, y long, depth long, ends_sha256 string"))


def subtree_sums(tree: DataFrame, sums: list[str], max_rounds: int = 500) -> DataFrame:
    """(v, *sums): for every node of ``tree`` (v, p, d, k, *sums) the sums over its subtree.

    ``p`` is the parent (null for the one root), ``d`` the depth, ``k`` the number of children;
    ``tree`` is read several times, so it should be a written table."""
    bits = int(tree.agg(F.max("d")).first()[0] or 0).bit_length()
    nodes = tree.select("v", "p", "d", "k", *sums)
    spliced, rounds = None, []

    def with_sums(df: DataFrame, other: str) -> list[Column]:
        return [(F.col(s) + F.coalesce(f"{other}{s}", F.lit(0))).alias(s) for s in sums]

    for r in range(max_rounds):
        # rake: leaves, and what the last round's spliced nodes had, go to the parents
        leaf = (F.col("k") == 0) & F.col("p").isNotNull()
        gone = nodes.where(leaf).select("p", *sums, F.lit(1).alias("one"))
        if spliced is not None:
            gone = gone.unionByName(spliced.select("p", *sums, F.lit(0).alias("one")))
        gone = gone.groupBy(F.col("p").alias("_p")).agg(F.sum("one").alias("_one"), *[F.sum(s).alias(f"_{s}") for s in sums])
        inner = cut_lineage(nodes.where(~leaf).join(gone, F.col("v") == F.col("_p"), "left").select(
            "v", "p", "d", (F.col("k") - F.coalesce("_one", F.lit(0))).alias("k"), *with_sums(nodes, "_")))
        rounds.append([nodes.where(leaf).select("v", *sums), None])
        if inner.count() == 1:
            break
        # compress: single-child nodes whose bit is set, and whose parent is not such a node too
        bit = F.expr(f"shiftright(d, {r}) & 1") if r < bits else F.xxhash64("v", F.lit(r)).bitwiseAND(F.lit(1))
        own = inner.withColumn("on", (F.col("k") == 1) & F.col("p").isNotNull() & (bit == 1))
        above = own.where("on").select(F.col("v").alias("_v"))
        flagged = cut_lineage(own.join(above, F.col("p") == F.col("_v"), "left").select("v", "p", "d", "k", *sums, (F.col("on") & F.col("_v").isNull()).alias("out")))
        spliced = flagged.where("out")
        over = spliced.select(F.col("v").alias("_v"), F.col("p").alias("_p"), *[F.col(s).alias(f"_{s}") for s in sums])
        nodes = cut_lineage(flagged.where("not out").drop("out").join(over, F.col("p") == F.col("_v"), "left").withColumn("p", F.coalesce("_p", "p")).drop("_p"))
        rounds[-1][1] = nodes.where("_v is not null").select(F.col("_v").alias("v"), F.col("v").alias("c"), *[F.col(f"_{s}").alias(s) for s in sums])
        nodes = nodes.select("v", "p", "d", "k", *sums)
    else:
        raise RuntimeError("the tree did not contract to its root")
    known = inner.select("v", *sums)
    for leaves, undo in reversed(rounds):
        if undo is not None:
            below = known.select(F.col("v").alias("c"), *[F.col(s).alias(f"_{s}") for s in sums])
            known = cut_lineage(known.unionByName(undo.join(below, "c").select("v", *with_sums(undo, "_"))))
        known = known.unionByName(leaves)
    return known


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conversations`` or ``branched``): conv_id (the smallest member; with depth
    it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = cut_lineage(turns.select("conv_id", "place", "len", "last", F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", "place", F.lit(1), "a").alias("y"),
                                     F.xxhash64("place", "a", "b").alias("hx"), F.xxhash64("b", "place", F.lit(1), "a").alias("hy")))
    rows = cut_lineage(running(turns.where("place is not null"), "conv_id", ["place"], ("x", "y")).withColumn("depth", F.col("place") + 1))
    nodes = rows.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("len"),
                                                F.max(F.col("x").bitwiseXOR(F.col("hx"))).alias("px"), F.max(F.col("y").bitwiseXOR(F.col("hy"))).alias("py"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("v"), "*"))
    # the turnless root: all conversations have a last row, turnless ones just that
    spark = turns.sparkSession
    least, n_all = turns.where("last").agg(F.min("conv_id"), F.count(F.lit(1))).first()
    none = F.lit(None).cast("long")
    long = lambda x: F.lit(x).cast("long")
    root = spark.range(1 if n_all else 0).select(long(ROOT).alias("v"), none.alias("p"), long(0).alias("depth"), long(0).alias("x"), long(0).alias("y"), long(least).alias("conv_id"),
                                                 none.alias("parent_conv_id"), long(n_all).alias("n_convs"), long(0).alias("len"))
    above = nodes.select("depth", F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above.withColumn("depth", F.col("depth") + 1), ["depth", "px", "py"])
    top = nodes.where("depth = 1").withColumns({"p": long(ROOT), "parent_conv_id": long(least)})
    nodes = cut_lineage(deep.select(root.columns).unionByName(top.select(root.columns)).unionByName(root))
    if not n_all:
        return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", *[F.col("len").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))
    kids = nodes.where("p is not null").groupBy(F.col("p").alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    nodes = cut_lineage(nodes.join(kids, F.col("v") == F.col("_p"), "left").withColumn("n_children", F.coalesce("_k", F.lit(0))).drop("_p", "_k"))
    sums = subtree_sums(nodes.select("v", "p", F.col("depth").alias("d"), F.col("n_children").alias("k"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                     ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = ends_digests(rows.where("last").select("x", "y", "depth", "conv_id").unionByName(
        turns.where("place is null").select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("depth"), "conv_id")))
    return nodes.join(sums, "v").join(ends, ["x", "y", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
