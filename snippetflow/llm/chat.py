"""Chat formatting at the level of tokens (operator 7).

Each turn is the reserved id of ``<|im_start|>``, the ids of its role, of a line
break and of its text, the reserved id of ``<|im_end|>`` and a line break.
Segments are encoded apart, so no text can merge with the template or yield a
reserved id; prefix sums of the segments' lengths place the loss mask, which
covers the texts of ``assistant`` turns.  Control strings inside a text are
escaped: ``<``, any backslashes, ``|`` gets one more backslash, which
``unescape`` takes away; a role also has its line breaks and backslashes escaped.

One output row per turn, numbered and with the place of its first token in its
conversation; a conversation is its rows in order.  Rows are streamed in order,
so a conversation of any length needs the memory of one batch.

Defined cases: null text or role counts as empty; null conv_id is one
conversation of its own; rows of one turn go by role, then text; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snippetflow.llm import ragged as R
from snippetflow.llm.common import pick, ship_code
from snippetflow.llm.tokens import Encoder, token_bytes

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        start_id, end_id = enc.tok.get_vocab_size(), enc.tok.get_vocab_size() + 1
        line = enc.whole(b"\n")
        conv, turn, at = object(), 0, 0
        for b in batches:
            roles = [escape_role(x or "") for x in b.column(2).to_pylist()]
            texts = [escape(x or "") for x in b.column(3).to_pylist()]
            coded = []
            for col in (roles, texts):
                out: list[np.ndarray] = []
                for _, data, offs in R.chunks(pa.array(col, pa.large_string())):
                    out += enc.rows(data, offs)
                coded.append(out)
            turns, starts, ids, masks = [], [], [], []
            for c, role, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), *coded, strict=True):
                if c != conv:
                    conv, turn, at = c, 0, 0
                parts = [[start_id], r, line, t, [end_id], line]
                place = np.cumsum([0] + [len(p) for p in parts])
                mask = np.zeros(place[-1], np.int8)
                if role == "assistant":
                    mask[place[3]:place[4]] = 1
                turns.append(turn)
                starts.append(at)
                ids.append(np.concatenate(parts).astype(np.int32))
                masks.append(mask)
                turn, at = turn + 1, at + int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(turns, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(masks, pa.list_(pa.int8()))], names=["conv_id", "turn_no", "token_start", "ids", "loss_mask"])
    return run


def format_chats(chats: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, turn_no, token_start, ids, loss_mask of each turn, the turns of a
    conversation together and in order within one partition."""
    ship_code()
    d = pick(chats, conv_id=conv_id, turn=turn, role=role, text=text)
    kind = d.schema["conv_id"].dataType.simpleString()
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return d.mapInArrow(_encode(tokenizer), f"conv_id {kind}, turn_no long, token_start long, ids array<int>, loss_mask array<tinyint>")


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.tokens = 0


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        start_id = len(table)
        table = [*table, START.encode(), END.encode()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, d = None, None

        def row():
            return [conv, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars]

        kind = None
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for c, turn, at, ids, mask in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), b.column(4), strict=True):
                if d is None or c != conv:
                    if d is not None:
                        done.append(row())
                    conv, d = c, _Digest()
                if turn != d.n or at != d.tokens:
                    raise ValueError(f"turns of a conversation are not in order: turn {turn} at token {at} where turn {d.n} at token {d.tokens} must stand")
                d.tokens += len(ids)
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                if ids[0] != start_id:
                    raise ValueError("a turn must begin with the start id")
                said = b"".join(map(table.__getitem__, ids.tolist())).decode()
                role, _, body = said[len(START):-len(END) - 1].partition("\n")
                learned = b"".join(map(table.__getitem__, ids[mask == 1].tolist())).decode()
                learned = unescape(learned)
                d.turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                d.loss.update(learned.encode())
                d.n, d.loss_chars, d.chars = d.n + 1, d.loss_chars + len(learned), d.chars + len(said)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*done, strict=True), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)
        if d is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                row(), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)
    return run


def read_back(formatted: DataFrame, tokenizer: str, stored: bool = False) -> DataFrame:
    """The digests of each conversation, from the ids and masks of ``format_chats`` alone.

    A table that was stored and read again has no order: with ``stored`` its rows are brought together and
    sorted first.  Rows out of order, or a conversation in two partitions, raise an error."""
    ship_code()
    if stored:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _read_back(tokenizer),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
