"""Token ids of whole batches by a byte-level BPE file of the ``tokenizers`` library.

The pre-tokenizer's pieces (letters, digits, other signs, each with at most one
leading space; white space; English contractions) are found with array
operations over ASCII and the letters U+00C0-U+024F.  Each distinct piece is
encoded once by the library's model and its ids are spread to all its places.
Rows with other characters, with a special token's string, or files of another
kind go through ``Tokenizer.encode`` as a whole; both ways give the same ids.
"""

from __future__ import annotations

import itertools
import json

import numpy as np

from snippetflow.llm import ragged as R

SPACE, LETTER, DIGIT, OTHER, ODD = 0, 1, 2, 3, 4
KIND = np.full(256, ODD, np.uint8)
KIND[33:128] = OTHER
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[128:192] = KIND[0xC3:0xCA] = LETTER
KIND[127] = ODD
# fixed values: the endings split off after an apostrophe
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
MEMO_PIECES = 2_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.fast = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                     and spec["normalizer"] is None and spec["model"]["type"] == "BPE")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.alphabet = np.array([ord(c) for c in byte_alphabet()], "<u4")
        self.forget()

    def forget(self) -> None:
        """Empty memo: keys (sorted hashes of pieces) with the place and number of their ids in the pool."""
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def whole(self, raw: bytes) -> np.ndarray:
        return np.array(self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def rows(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        n = len(offs) - 1
        slow = np.zeros(n, bool)
        if not self.fast:
            slow[:] = True
        elif len(data):
            bad = KIND[data] == ODD
            bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            slow[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = True
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    slow[np.searchsorted(offs, at, "right") - 1] = True
                    at = raw.find(s, at + 1)
        if slow.all():
            return [self.whole(data[offs[i]:offs[i + 1]].tobytes()) for i in range(n)]
        ids, first = self.pieces(data, offs)
        out = [ids[first[i]:first[i + 1]] for i in range(n)]
        for i in np.flatnonzero(slow):
            out[i] = self.whole(data[offs[i]:offs[i + 1]].tobytes())
        return out

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each byte."""
        n = len(data)
        kind = KIND[data]
        row_start = np.zeros(n, bool)
        row_start[offs[:-1][offs[:-1] < n]] = True
        row_end = np.zeros(n, bool)
        row_end[offs[1:][(offs[1:] > 0) & (np.diff(offs) > 0)] - 1] = True
        prev, nxt = np.roll(kind, 1), np.roll(kind, -1)
        blank = kind == SPACE
        joined = np.roll(data == 0x20, 1) & ~row_start
        begins = np.where(blank, (prev != SPACE) | (~row_end & (nxt != SPACE)), (kind != prev) & ~joined)
        begins |= row_start
        quote = np.flatnonzero(begins & (data == 0x27) & ~row_end)
        if len(quote):
            limit = offs[np.searchsorted(offs, quote, "right")]
            one = data[quote + 1]
            two = data[np.minimum(quote + 2, n - 1)]
            for e in ENDINGS:
                fits = (one == e[0]) & (quote + 1 + len(e) <= limit)
                if len(e) == 2:
                    fits &= two == e[1]
                at = quote[fits]
                begins[at + 1] = False
                after = at + 1 + len(e)
                after = after[after < limit[fits]]
                # what follows starts anew; a blank keeps the rule of its own run
                begins[after[kind[after] != SPACE]] = True
        return begins

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        start = np.flatnonzero(self.starts(data, offs))
        end = np.append(start[1:], len(data))
        prefix = R.prefix_hash(data, R.BYTE_VALUES)
        h = R.span_hash(prefix, start, end)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_PIECES:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        where, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        where[known], count[known] = self.start[place[known]], self.count[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            # one character stands for each byte, so places in the text stay the same
            text, tokenize = self.alphabet[data].tobytes().decode("utf-32-le"), self.tok.model.tokenize
            got = [[t.id for t in tokenize(text[a:b])] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            count[new] = [len(x) for x in got]
            where[new] = self.filled + np.cumsum(count[new]) - count[new]
            flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count[new].sum()))
            if self.filled + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.filled], np.zeros(self.filled + 2 * len(flat), np.uint32)])
            self.pool[self.filled:self.filled + len(flat)] = flat
            self.filled += len(flat)
            into = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, into, keys[new])
            self.start = np.insert(self.start, into, where[new])
            self.count = np.insert(self.count, into, count[new])
        each = count[back]
        ids = self.pool[R.ranges(where[back], each)]
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, before[np.searchsorted(start, offs)]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    back = {c: i for i, c in enumerate(byte_alphabet())}
    return [bytes(back[c] for c in tok.id_to_token(i)) if all(c in back for c in tok.id_to_token(i)) else b""
            for i in range(tok.get_vocab_size())]
