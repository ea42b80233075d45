"""Removal of word passages that an earlier document has, with difference-cover anchors.

A window is `window` consecutive words. {0, 1, 3} is a difference cover modulo 7: for any two places i, j there is k < 7 such that
i + k and j + k are both cover places. So two equal windows share an equal anchor of window - 6 words at cover places, and only the
anchors (three of seven places) are looked up in the whole corpus. Windows that hold an anchor seen in two documents are extended
to their whole length and compared by hash; of each window the least doc_id is found; later documents lose the words under it.

1. Texts are packed into rows of some megabytes, which are kept for the later passes.
2. Each row sends its distinct anchors, 32-bit hashes dealt to parts by other 32 bits; a part answers with one bit for each: seen in
   another row. A wrong yes only costs work.
3. Each row sends its distinct candidate windows (64-bit hash within a part, parts by an independent hash, so that the bits in use
   grow with the number of parts) with its least doc_id; a part answers with one bit: there is a smaller one.
4. Each row removes words.

Rows combine equal anchors and windows before they send, so a passage that every document has comes once from each row, and no
step makes pairs. Parts grow in number with the input.

Cases: null or empty texts have no words; fewer words than a window: nothing is removed; a document does not lose words to itself
or to a row with the same id; null ids neither lose words nor take any; further columns are not passed on; empty tables give
empty results.
"""
from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import claim, mix, part_count, slices, text_bytes, text_words

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ROW_BYTES = 4 << 20
PART_BYTES = 128 << 20
ONE, TWO, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def pack(docs: DataFrame, doc_id: str, text: str, summarise=None) -> DataFrame:
    """Rows of about ROW_BYTES of text: row, doc_ids, sizes (bytes), texts (all texts, compressed), summary (of the texts, bytes)."""

    def run(batches):
        claim(__name__)
        n, parts = 0, TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3)
        held, ids, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([parts << 32 | n]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in held]], pa.list_(pa.int32())),
                                               pa.array([press.compress(b"".join(held))], pa.binary()), pa.array([summarise(held) if summarise else None], pa.binary())],
                                              names=["row", "doc_ids", "sizes", "texts", "summary"])

        for whole in batches:
            for b in slices(whole, ROW_BYTES):
                held += text_bytes(b.column("text"))
                ids += b.column("doc_id").to_pylist()
                size += b.nbytes
                if size >= ROW_BYTES:
                    yield row()
                    held, ids, size, n = [], [], 0, n + 1
        if held:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_ids array<long>, sizes array<int>, texts binary, summary binary")


def by_row(packed: DataFrame) -> DataFrame:
    """The packed rows, shuffled once by row and kept on the executors' disks, so that every join with answers moves answers only.

    Row numbers and contents follow from the input's partitions alone, so blocks of a lost executor are made again alike. The
    rows are let go with spark.catalog.clearCache().
    """
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "row").persist(StorageLevel.DISK_ONLY)


def rolled(h: np.ndarray, size: int, base: np.uint64, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * base + h[at + k]
    return mix(out)


class Packed:
    """Words of a packed row."""

    def __init__(self, doc_ids, sizes, texts, window: int):
        raw = zstandard.ZstdDecompressor().decompress(texts) if sizes else b""
        ends = np.cumsum(sizes).tolist()
        self.texts = [raw[e - n : e] for n, e in zip(sizes, ends, strict=True)]
        self.doc_ids = doc_ids
        self.window = window
        self.hash, count = text_words(self.texts)
        self.count, self.first = count, np.cumsum(count) - count
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(self.hash)) - self.first[self.doc]
        takes_part = np.array([i is not None for i in doc_ids], bool)
        self.left = np.where(takes_part, count, 0)[self.doc] - self.at  # words from here to the document's end

    def anchors(self, parts: int):
        """Places of all anchors, (part, 32 bits) of the distinct ones in order, which of them each anchor is, seen in two documents here."""
        size = self.window - PERIOD + 1
        phase = self.at % PERIOD
        place = np.flatnonzero((self.left >= size) & np.isin(phase, COVER))
        x = rolled(self.hash, size, ONE, place)
        key = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))
        distinct, which = np.unique(key, return_inverse=True)
        return place, distinct, which, self.in_two(which, self.doc[place], len(distinct))

    @staticmethod
    def in_two(which, doc, n) -> np.ndarray:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        return low != high

    def windows(self, parts: int, seen: np.ndarray):
        """Candidate windows: places, part and hash of the distinct ones in order, which is which, least doc_id of each."""
        place, distinct, which, local = self.anchors(parts)
        marked = np.zeros(len(self.hash) + PERIOD + 1, np.int64)
        marked[place[(local | seen)[which]] + 1] = 1
        upto = np.cumsum(marked)
        all_at = np.arange(len(self.hash))
        start = all_at[(self.left >= self.window) & (upto[all_at + PERIOD] > upto[all_at])]
        x, y = rolled(self.hash, self.window, TWO, start), rolled(self.hash, self.window, THREE, start)
        part = (y >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.lexsort((x, part))
        new = np.ones(len(order), bool)
        new[1:] = (x[order[1:]] != x[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        ids = np.array([0 if i is None else i for i in self.doc_ids], np.int64)[self.doc[start]]
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        return start, part[order][new], x[order][new], which, least, ids


def read_rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def in_parts(part: np.ndarray):
    """Ranges of equal values in a sorted array."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    return [(int(part[a]), a, b) for a, b in zip(cut, cut[1:], strict=False)]


def gathered(answers: list[dict] | None, n: int) -> np.ndarray:
    """Bits of all parts, in part order."""
    bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers or [], key=lambda a: a["part"])]
    out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    assert len(out) == n, "answers do not fit the row"
    return out


SENT = "part int, row long, n int, keys binary, ids binary"
ANSWER = "row long, part int, n int, bits binary"


def answered(sent: DataFrame, parts: int, with_ids: bool) -> DataFrame:
    """For each key of each sent row one bit: another row has it too (with ids: with a smaller id). One row for each packed row."""

    def run(batches):
        got = [r for b in batches for r in read_rows(b)]
        for part in sorted({r["part"] for r in got}):
            mine = [r for r in got if r["part"] == part]
            keys = np.concatenate([np.frombuffer(r["keys"], "<u8" if with_ids else "<u4") for r in mine])
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            run_of = np.cumsum(new) - 1
            if with_ids:
                ids = np.concatenate([np.frombuffer(r["ids"], f"<i{len(r['ids']) // r['n']}").astype(np.int64) + r["low"] for r in mine])[order]
                bit = ids > np.minimum.reduceat(ids, np.flatnonzero(new))[run_of]
            else:
                bit = np.bincount(run_of)[run_of] > 1
            back = np.empty(len(keys), bool)
            back[order] = bit
            ends = np.cumsum([r["n"] for r in mine])
            yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r in mine], pa.int64()), pa.array([part] * len(mine), pa.int32()), pa.array([r["n"] for r in mine], pa.int32()),
                                              pa.array([np.packbits(back[e - r["n"] : e]).tobytes() for r, e in zip(mine, ends, strict=True)], pa.binary())], names=["row", "part", "n", "bits"])

    back = sent.repartitionById(parts, "part").mapInArrow(run, ANSWER)
    return materialize(back.groupBy("row").agg(F.collect_list(F.struct("part", "n", "bits")).alias("answers")), "answers")


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Least value, and what is above it in as few bytes as it needs."""
    low = int(x.min())
    top = int(x.max()) - low
    kind = next(k for k, m in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**64)) if top < m)
    return low, (x - low).astype(kind).tobytes()


def sent_rows(made, names_types):
    names, types = zip(*names_types, strict=True)
    columns = list(zip(*made, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the kept words joined by one space)."""
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words or more")
    packed = by_row(pack(docs, doc_id, text).drop("summary"))
    size = packed.select(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    parts = part_count(docs.sparkSession, size, part_bytes)
    columns = [("part", pa.int32()), ("row", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("low", pa.int64())]
    ddl = SENT + ", low long"

    def send_anchors(batches):
        for b in batches:
            for r in read_rows(b):
                _, distinct, _, _ = Packed(r["doc_ids"], r["sizes"], r["texts"], window).anchors(parts)
                low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield sent_rows([(p, r["row"], j - i, low[i:j].tobytes(), None, 0) for p, i, j in in_parts((distinct >> np.uint64(32)).astype(np.int64))], columns)

    seen = answered(packed.mapInArrow(send_anchors, ddl), parts, False).withColumnRenamed("answers", "seen")

    def seen_bits(p: Packed, r) -> np.ndarray:
        return gathered(r["seen"], len(p.anchors(parts)[1]))

    def send_windows(batches):
        for b in batches:
            for r in read_rows(b):
                p = Packed(r["doc_ids"], r["sizes"], r["texts"], window)
                _, part, x, _, least, _ = p.windows(parts, seen_bits(p, r))
                made = []
                for k, i, j in in_parts(part.astype(np.int64)):
                    low, ids = narrow(least[i:j])
                    made.append((k, r["row"], j - i, x[i:j].astype("<u8").tobytes(), ids, low))
                yield sent_rows(made, columns)

    asked = packed.join(seen, "row", "left")
    smaller = answered(asked.mapInArrow(send_windows, ddl), parts, True).withColumnRenamed("answers", "smaller")

    def finish(batches):
        for b in batches:
            for r in read_rows(b):
                p = Packed(r["doc_ids"], r["sizes"], r["texts"], window)
                start, part, _, which, least, ids = p.windows(parts, seen_bits(p, r))
                gone = gathered(r["smaller"], len(part))[which] | (ids > least[which])
                edge = np.zeros(len(p.hash) + window + 1, np.int64)
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, start[gone] + window, -1)
                keep = np.cumsum(edge)[: len(p.hash)] == 0
                n_kept = np.add.reduceat(np.concatenate([keep, [0]]), p.first) * (p.count > 0) if len(p.count) else p.count
                kept = [b" ".join(t.split() if k == n else compress(t.split(), keep[f : f + n].tolist())) for t, f, n, k in zip(p.texts, p.first.tolist(), p.count.tolist(), n_kept.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p.doc_ids, pa.int64()), pa.array(p.count), pa.array((p.count - n_kept).astype(np.int64)), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return asked.join(smaller, "row", "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept binary")
