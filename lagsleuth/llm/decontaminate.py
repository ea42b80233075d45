"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its documents into shards (word ids of some megabytes of text) and sorts their suffixes. Every suffix of every
benchmark item is looked up in every shard by binary search, which gives its longest verbatim match; suffixes that match at least
a window (ten words, or the whole item if it is shorter) give all their locations as a range of the suffix array. Words that occur
in no item break every match, so only runs of item words that are as long as the shortest window enter a suffix array.

Documents are not shuffled. Items are sent to the tasks in blocks of a bounded size; the documents are passed once for each block.

Cases: null or word-free texts have no words; null or word-free items have no window; a null item id counts as the empty string;
repeated items are one item for each distinct id and text; repeated documents are judged one by one; further columns are kept (one with an
output's name is replaced); empty tables give an empty result or no match.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import add_columns, text_bytes, utf8_size

WINDOW = 10
BLOCK_BYTES = 32 << 20
MATCH = "array<struct<item_id: string, item_start: int, doc_start: int, n_words: int>>"
#: Lower case for A-Z; ASCII other than letters and digits parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Items:
    """A block of benchmark items: word ids in one row, and where each suffix and window starts."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.ids, self.vocabulary = [], {}
        flat, start, end, owner = [], [], [], []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            first = len(flat)
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            start += range(first, len(flat))
            end += [len(flat)] * len(words)
            owner += [(len(self.ids), first)] * len(words)
            self.ids.append(item_id)
        self.words = np.array(flat, np.int64)
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.item, self.first = np.array(owner, np.int64).reshape(-1, 2).T
        size = np.minimum(self.end - self.first, window)
        whole = self.start + size <= self.end
        self.window = np.where(whole, size, 0)
        self.shortest = int(size.min()) if len(size) else 0
        self.longest = int((self.end - self.first).max()) if len(size) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a word (not 0), sorted by their first `depth` words, by prefix doubling."""
    at = np.flatnonzero(text)
    rank, k = text, 1
    order = at[np.argsort(rank[at], kind="stable")]
    while k < depth:
        beyond = np.zeros_like(rank)
        beyond[: len(rank) - k] = rank[k:]
        key = rank * (int(rank.max(initial=0)) + 1) + beyond
        key[text == 0] = 0
        order = at[np.argsort(key[at], kind="stable")]
        new = np.ones(len(order), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.zeros_like(rank)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        k *= 2
    return order


def common_prefix(text, at, words, start, end) -> np.ndarray:
    """Length of the longest common prefix of text[at:] and words[start:end]."""
    n, todo = np.zeros(len(at), np.int64), np.flatnonzero((at >= 0) & (at < len(text)))
    while len(todo):
        i, j = at[todo] + n[todo], start[todo] + n[todo]
        same = (j < end[todo]) & (i < len(text))
        same[same] = text[i[same]] == words[j[same]]
        todo = todo[same]
        n[todo] += 1
    return n


def bound(text, order, words, start, end, after: bool) -> np.ndarray:
    """First place in `order` whose suffix is not below words[start:end] (after: and does not begin with it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        at, s, e = order[mid], start[open_], end[open_]
        n = common_prefix(text, at, words, s, e)
        whole = s + n == e
        i = at + n
        mine = np.where(i < len(text), text[np.minimum(i, len(text) - 1)], 0)
        below = np.where(whole, after, mine < words[np.minimum(s + n, len(words) - 1)])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def shard_matches(ids: np.ndarray, items: Items):
    """(item suffix, place in ids, length) of all matches of a window or more that cannot be extended to the left."""
    none = (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= items.shortest
    if not items.shortest or not long.any():
        return none
    start, size = start[long], (end - start)[long]
    new = np.cumsum(size + 1) - size - 1
    place = np.full(int((size + 1).sum()), -1, np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place[np.repeat(new, size) + inner] = np.repeat(start, size) + inner
    text = np.where(place >= 0, ids[place], 0)
    order = suffix_array(text, items.longest)
    lo = bound(text, order, items.words, items.start, items.end, False)
    longest = np.zeros(len(lo), np.int64)
    for near in (lo - 1, lo):
        ok = (near >= 0) & (near < len(order))
        at = np.where(ok, order[np.clip(near, 0, len(order) - 1)], -1)
        longest = np.maximum(longest, common_prefix(text, at, items.words, items.start, items.end))
    hit = np.flatnonzero((items.window > 0) & (longest >= items.window))
    s, e = items.start[hit], items.start[hit] + items.window[hit]
    lo, hi = (bound(text, order, items.words, s, e, after) for after in (False, True))
    n = hi - lo
    which = np.repeat(hit, n)
    at = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    before = (at > 0) & (items.start[which] > items.first[which])
    before[before] = text[at[before] - 1] == items.words[items.start[which[before]] - 1]
    which, at = which[~before], at[~before]
    return which, place[at], common_prefix(text, at, items.words, items.start[which], items.end[which])


def covered(starts, sizes) -> int:
    n = last = 0
    for a, k in sorted(zip(starts, sizes, strict=True)):
        n += max(0, a + k - max(a, last))
        last = max(last, a + k)
    return n


def find_block(docs: DataFrame, rows: list[tuple[str, bytes]], window: int, text: str, first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    made: list[Items] = []

    def fn(b: pa.RecordBatch):
        if not made:
            made.append(Items(sent.value, window))
        items = made[0]
        get = items.vocabulary.get
        words = [words_of(t) for t in text_bytes(b.column(text))]
        count = np.array([len(w) for w in words], np.int64)
        ids = np.zeros(int(count.sum()) + len(words), np.int64)
        begin = np.cumsum(count + 1) - count - 1
        for w, i in zip(words, begin.tolist(), strict=True):
            ids[i : i + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        which, at, size = shard_matches(ids, items)
        doc = np.searchsorted(begin, at, "right") - 1
        found = [[] for _ in words] if first else [list(x) for x in b.column("matches").to_pylist()]
        for d, w, p, k in zip(doc.tolist(), which.tolist(), (at - begin[doc]).tolist(), size.tolist(), strict=True):
            found[d].append({"item_id": items.ids[items.item[w]], "item_start": int(items.start[w] - items.first[w]), "doc_start": p, "n_words": k})
        return [count, [covered([m["doc_start"] for m in f], [m["n_words"] for m in f]) for f in found], found]

    return add_columns(docs, f"n_words long, n_hit long, matches {MATCH}", fn)


def find(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit (words inside a match) and matches (item, its first matching word, place in the document, length)."""
    clean = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    size = clean.agg(F.sum(utf8_size(F.col("t")) + utf8_size(F.col("i")))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        rows = [(r.i, r.t.encode()) for r in clean.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]
        docs = find_block(docs, rows, window, text, k == 0)
        if k + 1 < blocks:
            docs = materialize(docs, "matches")
    return docs


def remove(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents without any match, with their own columns."""
    return find(docs, items, **how).where("n_hit = 0").select(*docs.columns)
