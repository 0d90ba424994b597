"""Best-fit packing by best-two-fit (operator 3).

Documents are encoded in their tasks and cut into pieces of at most ``capacity``
tokens.  Full pieces are sequences of their own.  The others are dealt evenly to
shards of about ``shard_pieces`` pieces, as many shards as the data need; each
shard is packed alone: bins are filled greedily with the largest piece that
fits, then a bin's smallest piece gives way to two unpacked ones that fill its
widened gap more tightly.  A shard holds sizes from all of the data, so it loses
at most its last bins against packing everything together.

Defined cases: null text counts as empty, which is one piece of the end token;
repeated rows are packed each; pieces of equal size go in the order of the shard's
rows; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, ship_code
from snippetflow.llm.tokens import Encoder
from snippetflow.session import cut_lineage

CAPACITY = 2048
SHARD_PIECES = 16384


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        tail = np.array([end_id], "<u4")
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for lo, data, offs in R.chunks(b.column(1)):
                for i, ids in enumerate(enc.rows(data, offs)):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    n = len(ids)
                    lead = n if n <= capacity else n % capacity or capacity
                    cut = [0, *range(lead, n + 1, capacity)]
                    for k in range(len(cut) - 1):
                        part = ids[cut[k]:cut[k + 1]].tobytes()
                        row.append(lo + i)
                        piece.append(k)
                        start.append(cut[k])
                        length.append(cut[k + 1] - cut[k])
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<i4"))
            arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
                 end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""
    ship_code()
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return d.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), ddl)


def best_two_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size."""
    order = np.argsort(-sizes, kind="stable")
    stock: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stock.setdefault(int(sizes[i]), []).append(i)
    have = 0
    for s in stock:
        have |= 1 << s
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    n = 0

    def take(s: int) -> int:
        nonlocal have
        own = stock[s]
        i = own.pop()
        if not own:
            have &= ~(1 << s)
        return i

    def largest(limit: int) -> int:
        """The largest size in stock up to ``limit``, or 0."""
        return max(0, (have & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    while have:
        filled = [take(largest(capacity))]
        gap = capacity - int(sizes[filled[0]])
        while gap and (s := largest(gap)):
            filled.append(take(s))
            gap -= s
        if gap and len(filled) > 1:
            small = int(sizes[filled[-1]])
            room, best, pair = gap + small, small, (0, 0)
            a = largest(room - 1)
            while 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair[0]:
                out = filled.pop()
                filled += [take(pair[0]), take(pair[1])]
                stock[small].append(out)
                have |= 1 << small
        at = 0
        for i in filled:
            bins[i], offsets[i] = n, at
            at += int(sizes[i])
        n += 1
    return bins, offsets


def _pack(capacity: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(t.column("length").to_numpy(), capacity)
        seq = (key[0].as_py() << 32) + bins
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))
    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
         end_id: int = 0, shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """The pieces with their sequence_id and offset."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, text, doc_id, capacity, end_id, with_ids))
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    n = max(1, -(-rest.count() // shard_pieces))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    names = [c for c in pieces.columns]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = dealt.groupBy("shard").applyInArrow(_pack(capacity), ddl)
    return packed.unionByName(full.select(*names, "sequence_id", "offset"))
