"""Byte-level BPE encoding and decoding with a public rank file.

Texts are cut by a pattern; each distinct match not seen lately is encoded once. New matches are put into length-bucketed,
padded matrices of byte tokens. In each round every row merges its leftmost pair of least rank (found by a hashed pair lookup),
rows are compacted, and rows without a mergeable pair leave the matrix. If the least pair occurs several times in a row and no
merge of it makes a pair of lower rank, all of them are merged in the same round: the outcome is that of one merge at a time.

Cases: a null text counts as empty; an empty text has no tokens; rows are independent, so ties, repeated rows, empty tables and
further columns (kept; a column with an output's name is replaced) need no care. Nothing is shuffled.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import add_columns, store, text_bytes

NONE = np.int32(2**31 - 1)
MEMO_PIECES = 200_000
CELLS = 1 << 18
SLICE_BYTES = 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the joined bytes, in an open-addressing table that is searched by whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, out = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.bits = max(4, int(2 * len(found)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.out = np.full(1 << self.bits, NONE, np.int32)
        keys, todo = left << 32 | right, np.arange(len(found))
        slot = self.slots(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.out[slot[won]] = keys[won], out[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair cannot be merged (negative ids are padding)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        found = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self.slots(keys[todo])
        while len(todo):
            at = self.keys[slot]
            hit = at == keys[todo]
            found[todo[hit]] = self.out[slot[hit]]
            on = ~hit & (at >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return found


class Encoder:
    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.memo: dict[str, bytes] = {}
        self.cut = regex.compile(pattern).findall

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces])
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for w in np.unique(width[size > 0]):
            rows = np.flatnonzero((width == w) & (size > 0))
            for i in range(0, len(rows), max(1, CELLS // int(w))):
                self.merge_bucket(pieces, rows[i : i + max(1, CELLS // int(w))], int(w), out)
        return out

    def merge_bucket(self, pieces, rows, w, out) -> None:
        n = np.array([len(pieces[r]) for r in rows])
        cells = np.full((len(rows), w), -1, np.int32)
        cells[np.arange(w) < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)]
        rank = np.full((len(rows), w), NONE, np.int32)
        if w > 1:
            rank[:, :-1] = self.pairs.find(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), w - 1)
        while len(rows):
            best = rank.min(axis=1)
            done = best == NONE
            for r, c, k in zip(rows[done], cells[done], n[done], strict=True):
                out[r] = c[:k].astype("<u4").tobytes()
            on = ~done
            rows, cells, rank, n, best = rows[on], cells[on], rank[on], n[on], best[on]
            if len(rows):
                used = int(n.max())
                cells, rank, n = self.one_round(cells[:, :used], rank[:, :used], n, best)

    def one_round(self, cells, rank, n, best):
        at = np.arange(cells.shape[1])
        chosen = rank == best[:, None]
        several = np.flatnonzero(chosen.sum(axis=1) > 1)
        if len(several):
            s = chosen[several]
            start = s.copy()
            start[:, 1:] &= ~s[:, :-1]
            s &= (at - np.maximum.accumulate(np.where(start, at, 0), axis=1)) % 2 == 0
            # all at once only where no single merge makes a pair of lower rank
            r, p = np.nonzero(s)
            row, merged = several[r], best[several[r]]
            wide = np.pad(cells, ((0, 0), (1, 2)), constant_values=-1)
            left = np.where((p >= 2) & s[r, np.maximum(p - 2, 0)], merged, wide[row, p])
            low = (self.pairs.find(left, merged) < merged) | (self.pairs.find(merged, wide[row, p + 3]) < merged)
            careful = np.unique(r[low])
            first = s[careful].argmax(axis=1)
            s[careful] = at == first[:, None]
            chosen[several] = s
        row, p = np.nonzero(chosen)
        keep = at < n[:, None]
        keep[row, p + 1] = False
        cells[row, p] = best[row]
        to = np.cumsum(keep, axis=1) - 1
        q = to[row, p]
        r, c = np.nonzero(keep)
        n = keep.sum(axis=1)
        packed = np.full_like(cells, -1)
        packed[r, to[r, c]] = cells[r, c]
        ranks = np.full_like(rank, NONE)
        ranks[r, to[r, c]] = rank[r, c]
        wide = np.pad(packed, ((0, 0), (0, 1)), constant_values=-1)
        ranks[row, q] = self.pairs.find(wide[row, q], wide[row, q + 1])
        inner = q > 0
        row, q = row[inner], q[inner] - 1
        ranks[row, q] = self.pairs.find(wide[row, q], wide[row, q + 1])
        return packed, ranks, n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        new = [p for p in set().union(*cut) if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo = {}
            new = list(set().union(*cut))
        self.memo.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        get = self.tokens.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in ids]


_encoders = store()


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and ids (little-endian unsigned 32-bit integers). `path` is read by each worker."""

    def fn(b: pa.RecordBatch):
        ids = encoder(path, pattern).encode(b.column(text).to_pylist())
        return [[len(x) // 4 for x in ids], ids]

    return add_columns(docs, "n_tokens long, ids binary", fn, SLICE_BYTES)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids and decoded (the bytes of those ids) in one pass."""

    def fn(b: pa.RecordBatch):
        coder = encoder(path, pattern)
        ids = coder.encode(b.column(text).to_pylist())
        return [[len(x) // 4 for x in ids], ids, coder.decode(ids)]

    return add_columns(docs, "n_tokens long, ids binary, decoded binary", fn, SLICE_BYTES)


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the bytes of the ids (not all id lists are valid UTF-8)."""

    def fn(b: pa.RecordBatch):
        return [encoder(path, pattern).decode(text_bytes(b.column(ids)))]

    return add_columns(coded, "decoded binary", fn)
