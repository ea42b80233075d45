"""SentencePiece encoding and decoding with a table of distinct marked words.

A whitespace marker starts every word (spaces become markers, one more stands before the text). If no piece of the model has a
marker behind another character, no merge crosses from a word to the next marker, so a text is the chain of its chunks: a run of
markers and the word behind it. The chunks of a batch become a table of distinct chunks and, for each place, a row number of that
table; only new rows are segmented by the library, and the ids are gathered back by place. A worker remembers a bounded number of rows.
A model whose normalizer changes texts, or with such pieces, is applied to whole texts, each as one chunk.

Cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; rows are independent, so ties, repeated
rows, empty tables and further columns (kept; a column with an output's name is replaced) need no care. Nothing is shuffled.
"""
from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, store

MARK = "▁"
MEMO_CHUNKS = 300_000
MEMO_BYTES = 64
SLICE_BYTES = 4 << 20
SPACE = 32
#: Texts that tell whether a model's normalizer only marks spaces.
PROBES = ("a", " a  b ", "\t\n\r\x0b\x0c", "\x00\x1f\x7f\x85\xa0", "\xe9 e\u0301 \ufb01 \uff21 \u3000\u200b\u200d\ufeff \xad", "A\u0130\xdf")


class Segmenter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        plain = all(self.library.normalize(t) == MARK + t.replace(" ", MARK) for t in PROBES)
        self.by_chunk = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.memo: dict[bytes, list[int]] = {}

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk. The library sets the first marker of a chunk itself, but none before nothing."""
        found = self.library.encode([c[1:].decode() for c in chunks], num_threads=1)
        alone = [self.library.piece_to_id(MARK)]
        return [alone if len(c) == 1 else ids for c, ids in zip(chunks, found, strict=True)]

    def rows(self, chunks: list[bytes]) -> list[list[int]]:
        new = [c for c in chunks if c not in self.memo]
        made = dict(zip(new, self.segment(new), strict=True))
        out = [made[c] if c in made else self.memo[c] for c in chunks]
        if len(self.memo) + len(made) > MEMO_CHUNKS:
            self.memo = {}
        if len(made) <= MEMO_CHUNKS:
            self.memo.update((c, ids) for c, ids in made.items() if len(c) <= MEMO_BYTES)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and how many each text has."""
        if not self.by_chunk:
            return in_a_row(self.library.encode([t or "" for t in texts], num_threads=1))
        chunks, count = cut([t.replace(MARK, " ").encode() if t else b"" for t in texts])
        coded = chunks.dictionary_encode()
        at = coded.indices.to_numpy()
        ids, size = in_a_row(self.rows(coded.dictionary.to_pylist()))
        begin = np.cumsum(size) - size
        n = size[at]
        end = np.cumsum(n)
        upto = np.concatenate([[0], end])[np.cumsum(np.concatenate([[0], count]))]
        return ids[np.repeat(begin[at] - end + n, n) + np.arange(int(n.sum()))], np.diff(upto)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        cut_at = np.cumsum(count)[:-1]
        return [self.library.decode(x.tolist()) if len(x) else "" for x in np.split(ids, cut_at)] if len(count) else []


def in_a_row(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows))


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, a space set before each that is not empty, and how many each text has."""
    filled = [b" " + t if t else t for t in texts]
    size = np.fromiter(map(len, filled), np.int64, len(filled))
    data = np.frombuffer(b"".join(filled), np.uint8)
    space = data == SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[(np.cumsum(size) - size)[size > 0]] = True
    start = np.flatnonzero(first)
    offsets = np.append(start, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return chunks, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])))


_segmenters = store()


def segmenter(path: str) -> Segmenter:
    """One for each worker process."""
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def as_lists(ids: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and ids. `path` is read by each worker."""

    def fn(b: pa.RecordBatch):
        ids, count = segmenter(path).encode(b.column(text).to_pylist())
        return [pa.array(count, pa.int64()), as_lists(ids, count)]

    return add_columns(docs, "n_tokens long, ids array<int>", fn, SLICE_BYTES)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the library's text of the ids; null ids count as none."""
    return add_columns(coded, "decoded string", lambda b: [segmenter(path).decode(*in_a_row([x or [] for x in b.column(ids).to_pylist()]))])


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids and decoded (the text of those ids) in one pass."""

    def fn(b: pa.RecordBatch):
        coder = segmenter(path)
        ids, count = coder.encode(b.column(text).to_pylist())
        return [pa.array(count, pa.int64()), as_lists(ids, count), coder.decode(ids, count)]

    return add_columns(docs, "n_tokens long, ids array<int>, decoded string", fn, SLICE_BYTES)
