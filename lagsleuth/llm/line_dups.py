"""Removal of lines that are like an earlier line, by an exact set-similarity join.

A line is the set of its words (A-Z in lower case). A line goes if an earlier line, in a document with a smaller id or further up in
the same document, has a Jaccard similarity of `percent` or more; lines are judged on the input, not on what is left.

1. Texts are packed into rows of some megabytes; each row sums the counts of its words by hash slots.
2. The counts of all rows give the rarity of every slot, a table of fixed size. Words are ordered by rarity, then by hash.
3. Lines whose very bytes an earlier line has are found by a digest.
4. Each other line offers the rarest words of its prefix (n - ceil(percent * n) + 1 of n words), with its size, the word's position
   and a bitmap of its words. For each offer one bit comes back: another line with that word passes the length filter, the
   positional filter and the bound that the bitmaps give. Most offers end here.
5. For the offers that are left, lines send their words. Within a word, in document order, each line is compared with earlier
   lines of fitting length, in growing blocks, until one is similar enough.

Two similar lines share the rarest of their common words in both prefixes, and there all filters hold, so none is lost. Parts
grow in number with the input; nothing that grows with it comes to the driver. Equal lines are one line in steps 4
and 5. A word that is among the rarest of very many different lines of which each is like no earlier one is the costly case: its
offers are compared in one task.

Cases: lines without words are kept and match nothing; null texts have no lines and give an empty text; null ids neither lose lines nor take
any; a row with the same id in another row of the table takes none; further columns are not passed on; empty tables give empty results.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import SPACE, digest_spans, hash_spans, joined, mix, part_count, text_words, word_spans
from .substrings import answered, by_row, gathered, in_parts, narrow, pack, read_rows, sent_rows

PERCENT = 80
SLOT_BITS = 20
CHUNKS = 16
PART_BYTES = 64 << 20
WIDTHS = ((48, 1), (96, 2), (None, 4))
BLOCK = 16
OFFER = "part int, row long, n int, keys binary, sizes binary, places binary, lines binary, bitmaps binary"


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def word_counts(texts: list[bytes]) -> bytes:
    n = np.bincount(slots(text_words([t.lower() for t in texts])[0]), minlength=1 << SLOT_BITS)
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(n, 2**32 - 1).astype("<u4").tobytes())


def rarity(packed: DataFrame) -> np.ndarray:
    """A rising step function of each slot's count, 0 to 255."""
    width = (1 << SLOT_BITS) // CHUNKS

    def add(batches):
        total = np.zeros(1 << SLOT_BITS, np.uint64)
        for b in batches:
            for s in b.column("summary").to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(s), "<u4")
        press = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([press.compress(total[i * width : (i + 1) * width].tobytes()) for i in range(CHUNKS)], pa.binary())], names=["chunk", "counts"])

    def finish(batches):
        total = {}
        for b in batches:
            for k, s in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(s), np.uint64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(255, 6 * np.log2(n.astype(float) + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "steps"])

    sums = packed.select("summary").mapInArrow(add, "chunk int, counts binary").repartitionById(CHUNKS, "chunk")
    steps = {r.chunk: bytes(r.steps) for r in sums.mapInArrow(finish, "chunk int, steps binary").collect()}
    return np.frombuffer(b"".join(steps.get(k, bytes(width)) for k in range(CHUNKS)), np.uint8)


class Lines:
    """Lines of a packed row that have words; after `words`, also as sets in order of rarity."""

    def __init__(self, r: dict):
        raw = zstandard.ZstdDecompressor().decompress(r["texts"]) if r["sizes"] else b""
        ends = np.cumsum(r["sizes"]).tolist()
        self.row, self.doc_ids = r["row"], r["doc_ids"]
        self.texts = [raw[e - n : e] for n, e in zip(r["sizes"], ends, strict=True)]
        self.data, begin = joined(self.texts)
        end = np.flatnonzero(self.data[:-8] == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        doc = np.searchsorted(begin, start, "right") - 1
        first = np.searchsorted(start, begin)
        has = np.logical_or.reduceat(~SPACE[self.data[:-8]], start) if len(start) else np.zeros(0, bool)
        self.n_lines = np.bincount(doc[has], minlength=len(self.texts))
        part = has & np.array([i is not None for i in self.doc_ids], bool)[doc] if len(doc) else has
        self.start, self.length, self.doc = start[part], (end - start)[part], doc[part]
        self.number = (np.arange(len(start)) - first[doc])[part] if len(doc) else doc
        self.id = np.array([0 if i is None else i for i in self.doc_ids], np.int64)[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def words(self, steps: np.ndarray, only: np.ndarray | None = None):
        """hash and line of all distinct words of the lines (or some of them), rarest first in each line."""
        data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        start, size = word_spans(data)
        line = np.searchsorted(self.start, start, "right") - 1
        mine = line >= 0
        mine[mine] = start[mine] < self.start[line[mine]] + self.length[line[mine]]
        if only is not None:
            wanted = np.zeros(len(self.start), bool)
            wanted[only] = True
            mine[mine] = wanted[line[mine]]
        h, line = hash_spans(data, start[mine], size[mine]), line[mine]
        step, low = steps[slots(h)], h & np.uint64(0xFFFFFFFF)
        if len(self.start) < 1 << 24:
            order = np.argsort(line.astype(np.uint64) << np.uint64(40) | step.astype(np.uint64) << np.uint64(32) | low, kind="stable")
        else:
            order = np.lexsort((low, step, line))
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.hash, self.line = h[new], line[new]
        self.size = np.bincount(self.line, minlength=len(self.start))
        self.first = np.cumsum(self.size) - self.size
        self.at = np.arange(len(self.hash)) - self.first[self.line]
        return self

    def sets(self, parts: int):
        """Distinct lines: parts, digests, which one a line is, least id of each; repeats of a line of this row."""
        digest = digest_spans(self.data, self.start, self.length)
        part = ((mix(digest ^ self.length.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((self.number, self.doc, self.id, digest, part))
        p, x, d, i = part[order], digest[order], self.doc[order], self.id[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1])
        run = np.cumsum(new) - 1
        least = i[new]
        repeat = np.zeros(len(order), bool)
        repeat[1:] = ~new[1:] & (d[1:] == d[:-1])
        repeat |= i > least[run]
        which, local = np.empty(len(order), np.int64), np.empty(len(order), bool)
        which[order], local[order] = run, repeat
        return p[new], x[new], which, least, local

    def offers(self, parts: int, gone: np.ndarray, percent: int):
        """Prefix words of the lines that are not gone, in order of part and key: index of the word, part, 32-bit key."""
        need = -(-percent * self.size // 100)
        word = np.flatnonzero((self.at <= (self.size - need)[self.line]) & ~gone[self.line])
        return self.keyed(word, parts)

    def keyed(self, word: np.ndarray, parts: int):
        x = mix(self.hash[word] ^ np.uint64(0x5BD1E995))
        part = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        key = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((self.line[word], key, part))
        return word[order], part[order], key[order]

    def bitmaps(self, lines: np.ndarray) -> np.ndarray:
        """256 bits for each of the given lines (rising)."""
        out = np.zeros((len(lines), 4), np.uint64)
        mine = np.isin(self.line, lines)
        bit = (mix(self.hash[mine]) & np.uint64(255)).astype(np.int64)
        row = np.searchsorted(lines, self.line[mine])
        np.bitwise_or.at(out.reshape(-1), row * 4 + (bit & 3), np.uint64(1) << (bit >> 2).astype(np.uint64))
        return out


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    out = maps[:, :width].copy()
    for k in range(width, maps.shape[1], width):
        out |= maps[:, k : k + width]
    return out


def width_of(size: np.ndarray) -> np.ndarray:
    return np.where(size <= WIDTHS[0][0], WIDTHS[0][1], np.where(size <= WIDTHS[1][0], WIDTHS[1][1], WIDTHS[2][1]))


def wanted_overlap(n, m, percent):
    """Least overlap of sets of n and m words that are similar."""
    return -(-(n + m) * percent // (100 + percent))


def useful(key, size, place, maps, percent: int) -> np.ndarray:
    """Which offers have a partner with the same key that passes the filters. maps: bitmaps of four words, wide ones only where size is large."""
    order = np.lexsort((size, key))
    key, size, place = key[order], size[order], place[order]
    width = width_of(size)
    levels = {w: fold(maps[order], w) for w in (1, 2, 4)}
    good = np.zeros(len(key), bool)
    left, step = np.arange(len(key)), 1
    while len(left):
        left = left[left + step < len(key)]
        right = left + step
        on = (key[left] == key[right]) & (100 * size[left] >= percent * size[right])
        left, right = left[on], right[on]
        need = wanted_overlap(size[left], size[right], percent)
        ok = np.minimum(size[left] - place[left], size[right] - place[right]) >= need
        ok &= ~(good[left] & good[right])
        a, b, need = left[ok], right[ok], need[ok]
        common = np.minimum(width[a], width[b])
        apart = np.zeros(len(a), np.int64)
        for w, level in levels.items():
            at = np.flatnonzero(common == w)
            apart[at] = np.bitwise_count(level[a[at]] ^ level[b[at]]).sum(axis=1)
        ok = (size[a] + size[b] - apart) // 2 >= need
        good[a[ok]] = good[b[ok]] = True
        step += 1
    out = np.empty(len(key), bool)
    out[order] = good
    return out


def asked(sent: DataFrame, parts: int, percent: int) -> DataFrame:
    """The offers that pass, as lines and places of words in them, by packed row."""

    def run(batches):
        got = [r for b in batches for r in read_rows(b)]
        for part in sorted({r["part"] for r in got}):
            mine = [r for r in got if r["part"] == part]
            key, size, place, maps = [], [], [], []
            for r in mine:
                n = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                w = width_of(n)
                m = np.zeros((len(n), 4), np.uint64)
                flat, ends = np.frombuffer(r["bitmaps"], "<u8"), np.cumsum(w)
                for k in range(4):
                    m[w > k, k] = flat[(ends - w)[w > k] + k]
                key.append(np.frombuffer(r["keys"], "<u4"))
                size.append(n)
                place.append(np.frombuffer(r["places"], "<u4").astype(np.int64))
                maps.append(m)
            bit = useful(np.concatenate(key), np.concatenate(size), np.concatenate(place), np.concatenate(maps), percent)
            ends = np.cumsum([r["n"] for r in mine])
            on = [np.flatnonzero(bit[e - r["n"] : e]) for r, e in zip(mine, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r, k in zip(mine, on, strict=True) if len(k)], pa.int64()), *[
                pa.array([np.frombuffer(r[c], "<u4")[k].astype(np.int64) for r, k in zip(mine, on, strict=True) if len(k)], pa.list_(pa.int64())) for c in ("lines", "places")]], names=["row", "lines", "places"])

    back = sent.repartitionById(parts, "part").mapInArrow(run, "row long, lines array<long>, places array<long>")
    back = back.groupBy("row").agg(F.collect_list(F.struct("lines", "places")).alias("u"))
    return materialize(back.select("row", F.flatten("u.lines").alias("lines"), F.flatten("u.places").alias("places")), "useful")


def first_match(words: list[np.ndarray], size, order_key, percent: int) -> np.ndarray:
    """For lines of one word in document order, which have a similar earlier one. order_key: (id, packed row, document, number)."""
    out = np.zeros(len(words), bool)
    for i in range(1, len(words)):
        fits = np.flatnonzero((100 * size[:i] >= percent * size[i]) & (100 * size[i] >= percent * size[:i]))
        # rows with the same id come earlier only within one document
        fits = fits[(order_key[fits, 0] < order_key[i, 0]) | (order_key[fits, 1:3] == order_key[i, 1:3]).all(axis=1)]
        at, block = 0, BLOCK
        while at < len(fits) and not out[i]:
            some = fits[at : at + block]
            lengths = np.array([len(words[j]) for j in some])
            flat = np.concatenate([words[j] for j in some])
            near = np.searchsorted(words[i], flat)
            hit = words[i][np.minimum(near, len(words[i]) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
            out[i] = (100 * both >= percent * (size[i] + size[some] - both)).any()
            at, block = at + block, block * 4
    return out


def matched(sent: DataFrame, parts: int, percent: int) -> DataFrame:
    """By packed row, the lines (index among lines with words) that have a similar earlier line."""

    def run(batches):
        got = [r for b in batches for r in read_rows(b)]
        for part in sorted({r["part"] for r in got}):
            mine = [r for r in got if r["part"] == part]
            key = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in mine])
            info = np.concatenate([np.frombuffer(r["places"], "<i8").reshape(-1, 5) for r in mine])  # id, document, number, line, size
            row = np.repeat([r["row"] for r in mine], [r["n"] for r in mine])
            data = np.concatenate([np.frombuffer(r["bitmaps"], "<u8") for r in mine])
            ends = np.cumsum(info[:, 4])
            order = np.lexsort((info[:, 2], info[:, 1], row, info[:, 0], key))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
            hits: dict[int, set] = {}
            for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                if b - a > 1:
                    o = order[a:b]
                    words = [data[ends[k] - info[k, 4] : ends[k]] for k in o]
                    found = first_match(words, info[o, 4], np.column_stack([info[o, 0], row[o], info[o, 1], info[o, 2]]), percent)
                    for k in o[found]:
                        hits.setdefault(int(row[k]), set()).add(int(info[k, 3]))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.int64()), pa.array([sorted(x) for x in hits.values()], pa.list_(pa.int64()))], names=["row", "lines"])

    back = sent.repartitionById(parts, "part").mapInArrow(run, "row long, lines array<long>")
    return materialize(back.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("alike")), "alike")


def remove_similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, part_bytes: int = PART_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, kept (the kept lines, joined by line feeds); if asked for, sha256 of the input text.

    Rows of one id and text have the same result, so both tell the rows of a table apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    packed = pack(rows, "doc_id", "text", word_counts)
    packed = by_row(packed)
    size = packed.select(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    parts = part_count(docs.sparkSession, size, part_bytes)
    steps = docs.sparkSession.sparkContext.broadcast(rarity(packed))
    packed = packed.drop("summary")
    digests = [("part", pa.int32()), ("row", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("low", pa.int64())]
    offers = [("part", pa.int32()), ("row", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("lines", pa.binary()), ("bitmaps", pa.binary())]

    def each(batches):
        for b in batches:
            for r in read_rows(b):
                yield r, Lines(r)

    def send_digests(batches):
        for r, x in each(batches):
            part, digest, _, least, _ = x.sets(parts)
            made = []
            for p, i, j in in_parts(part):
                low, ids = narrow(least[i:j])
                made.append((p, r["row"], j - i, digest[i:j].astype("<u8").tobytes(), ids, low))
            yield sent_rows(made, digests)

    repeats = answered(packed.mapInArrow(send_digests, "part int, row long, n int, keys binary, ids binary, low long"), parts, True).withColumnRenamed("answers", "smaller")
    one = packed.join(repeats, "row", "left")

    def gone(r, x: Lines) -> np.ndarray:
        part, _, which, _, local = x.sets(parts)
        return gathered(r["smaller"], len(part))[which] | local

    def send_offers(batches):
        for r, x in each(batches):
            word, part, key = x.words(steps.value).offers(parts, gone(r, x), percent)
            lines = np.unique(x.line[word])
            maps = x.bitmaps(lines)
            levels = {w: fold(maps, w) for w in (1, 2, 4)}
            made = []
            for p, i, j in in_parts(part):
                line = x.line[word[i:j]]
                n = x.size[line]
                w = width_of(n)
                flat, ends = np.zeros(int(w.sum()), "<u8"), np.cumsum(w)
                at = np.searchsorted(lines, line)
                for k in range(4):
                    for width, level in levels.items():
                        mine = (w == width) & (width > k)
                        flat[(ends - w)[mine] + k] = level[at[mine], k] if width > k else 0
                made.append((p, r["row"], j - i, key[i:j].astype("<u4").tobytes(), n.astype("<u4").tobytes(), x.at[word[i:j]].astype("<u4").tobytes(), line.astype("<u4").tobytes(), flat.tobytes()))
            yield sent_rows(made, offers)

    kept_offers = asked(one.mapInArrow(send_offers, OFFER), parts, percent)
    two = packed.join(kept_offers, "row")

    def send_words(batches):
        for r, x in each(batches):
            if not r["lines"]:
                continue
            chosen = np.array(r["lines"], np.int64)
            word, part, key = x.words(steps.value, chosen).keyed(x.first[chosen] + np.array(r["places"], np.int64), parts)
            made = []
            for p, i, j in in_parts(part):
                line = x.line[word[i:j]]
                info = np.column_stack([x.id[line], x.doc[line], x.number[line], line, x.size[line]])
                data = [np.sort(x.hash[x.first[k] : x.first[k] + x.size[k]]) for k in line.tolist()]
                made.append((p, r["row"], j - i, key[i:j].astype("<u4").tobytes(), None, info.astype("<i8").tobytes(), None, np.concatenate(data).tobytes()))
            yield sent_rows(made, offers)

    alike = matched(two.mapInArrow(send_words, OFFER), parts, percent)

    def finish(batches):
        for r, x in each(batches):
            out = gone(r, x)
            out[np.array(r["alike"] or [], np.int64)] = True
            drop: dict[int, set] = {}
            for d, k in zip(x.doc[out].tolist(), x.number[out].tolist(), strict=True):
                drop.setdefault(d, set()).add(k)
            kept = [b"\n".join(line for k, line in enumerate(t.split(b"\n")) if k not in drop[d]) if d in drop else t for d, t in enumerate(x.texts)]
            made = [pa.array(x.doc_ids, pa.int64()), pa.array(x.n_lines, pa.int64()), pa.array([len(drop.get(d, ())) for d in range(len(kept))], pa.int64()), pa.array([k.decode() for k in kept])]
            if digest:
                made.append(pa.array([hashlib.sha256(t).hexdigest() for t in x.texts]))
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_lines", "n_removed", "kept", "sha256"][: len(made)])

    return one.join(alike, "row", "left").mapInArrow(finish, "doc_id long, n_lines long, n_removed long, kept string" + ", sha256 string" * digest)
