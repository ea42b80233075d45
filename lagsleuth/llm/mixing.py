"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z in lower case) and one end. Words are counted over all training documents. The most frequent words, the end
and an escape have Huffman codes; any other word is spelled, after the escape, in Huffman-coded bytes. Every code bit has three
predictions: without a context, and in two contexts (words: the last one, the last two; bytes: the last three and five of the
word), from bit counts over the training documents. Their logits are added with weights that a gate chooses: how often the two
contexts have been seen, and whether a word or a byte is coded. The starting weights are learned on a fortieth of the training
documents, against the bit counts of the others; scores use the bit counts of all. Each document refines them while it is read:
after each block of BLOCK tokens, each weight moves along the gradient of the bits just coded, over the curvature of all its bits
so far; texts of one block are scored with the starting weights. So a score depends on the document, the corpus
counts and the starting weights only. Training documents are scored with their own bits in the counts, as in the base score.

base_score is the unigram score with additive smoothing, over exact counts: frequent words by a table of fixed largest size, all
others by a join on the word.

Context and symbol are packed into one 64-bit key without loss, so contexts never share counts, and the counts grow with the
input. The documents are stored once, in parts of some 2**TABLE_BITS code bits, as the numbers of their words. The keys are dealt
into ranges of about equal size; a part asks each range for its keys by one packed row (sorted keys as differences, and how often
the part has them), and the task of the range sums the counts of all parts, makes the states of the code bits of each key from
them and answers each part by one packed row with the states of its keys in their order, without the keys. Only the top words, a
table of fixed largest size, and the bounds of the ranges are sent to all tasks.

Cases: null texts are empty (one end); a null id counts as the empty text for the hash; repeated documents are scored each; without
training documents every word is unknown; further columns are not passed on; empty tables give empty results.
"""
from __future__ import annotations

import contextlib
import heapq
import zlib
from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import claim, slices, text_bytes

TOP_WORDS = 1 << 18
TABLE_BITS = 23
SYMBOL_BITS, LETTER_BITS, KIND_AT = 19, 9, 58
PIECE_TOKENS, TOGETHER, WAVES = 1 << 17, 1 << 15, 4
ASKED, SAMPLED, SAMPLED_PARTS = 3 << 20, 512, 8
FOLDS = 10
BLOCK = 32
DELTA = 0.4
CONFIDENCE = np.array([0, 1, 3, 16])
QUARTER, REST = 0.25, 60.0
TUNING = 40
NEWTON, RIDGE = 5, 1.0
LOGIT_STEP = 0.3
LIMIT = 400_000
ESCAPE, END, SPELL_END = 0, 1, 256


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


CODEC = pa.Codec("zstd", 1)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def squeeze(*runs) -> bytes:
    """Each run compressed by itself, since other bytes are frequent in each."""
    frames = [CODEC.compress(x, asbytes=True) for x in runs]
    return b"".join(y for x, f in zip(runs, frames, strict=True) for y in (np.array([memoryview(x).nbytes, len(f)], "<u4").tobytes(), f))


def restore(data: bytes) -> bytes:
    """All runs, one after the other."""
    out, at = [], 0
    while at < len(data):
        size, n = np.frombuffer(data, "<u4", 2, at).tolist()
        out.append(CODEC.decompress(memoryview(data)[at + 8 : at + 8 + n], size, asbytes=True) if size else b"")
        at += 8 + n
    return b"".join(out)


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by bytes of equal weight, compressed together."""
    head, planes = [len(columns)], []
    for x in columns:
        wide = (int(x.max(initial=0)).bit_length() + 7) // 8
        head += [len(x), wide]
        planes.append(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    return np.array(head, "<u4").tobytes() + squeeze(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, "<u4", 2 * n, 4).reshape(-1, 2).astype(np.int64)
    ends = np.cumsum(head.prod(axis=1))
    planes, out = np.frombuffer(restore(data[4 + 8 * n :]), np.uint8), []
    for (size, wide), end in zip(head.tolist(), ends.tolist(), strict=True):
        x = np.zeros((size, 8), np.uint8)
        x[:, :wide] = planes[end - size * wide : end].reshape(wide, size).T
        out.append(x.view("<i8").ravel())
    return out


@contextlib.contextmanager
def shuffles_let_go(spark):
    """What a job has shuffled goes from the disks as soon as it has ended, not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes and their lengths."""
    n = len(counts)
    length = np.zeros(n, np.int64)
    if n == 1:
        return np.zeros(1, np.int64), np.ones(1, np.int64)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for new in range(n, 2 * n - 1):
        a, i = heapq.heappop(heap)
        b, j = heap[0]
        parent[i] = parent[j] = new
        heapq.heapreplace(heap, (a + b, new))
    depth = np.zeros(2 * n - 1, np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    length = depth[:n]
    code, last, out = 0, 0, np.zeros(n, np.int64)
    for i in np.lexsort((np.arange(n), length)):
        code <<= int(length[i]) - last
        last = int(length[i])
        out[i] = code
        code += 1
    return out, length


class Coder:
    """Codes of the symbols: escape, end, the top words by rank, then 257 spelling symbols (bytes, and the end of a spelled word).

    Code bits lie in flat arrays by (symbol, depth): the bit as a sign, and the logit of the first predictor, which is the share of
    ones under the node. Leaves are the symbols of either alphabet in the order of their codes, so the symbols under a node are neighbours.
    """

    def __init__(self, words: list[bytes], counts: list[int], ends: int, others: int, byte_counts: np.ndarray):
        self.words, self.count = words, np.array([0, ends, *counts], np.int64)
        self.weight = [np.array([others, ends, *counts], np.int64), np.asarray(byte_counts, np.int64)]
        self.codes, self.ready = [huffman(x) for x in self.weight], False

    def prepare(self):
        if self.ready:
            return self
        self.symbol = {w: i + 2 for i, w in enumerate(self.words)}
        self.spell = len(self.weight[0])
        start, length, sign, logit, leaf, by_leaf, left, at = [], [], [], [], [], [], [], 0
        for weight, (code, n) in zip(self.weight, self.codes, strict=True):
            first = np.cumsum(n) - n
            order = np.lexsort((np.arange(len(n)), n))
            left.append(code.astype(np.uint64) << (64 - n).astype(np.uint64))
            bits, share = np.zeros((2, int(n.sum())), np.float32)
            for deep, (on, bit, zeros, ones, of) in enumerate(depth_counts(n[order], left[-1][order], np.zeros(len(n), np.int64), weight[order])):
                bits[first[order[on]] + deep] = np.where(bit, 1, -1)
                share[first[order[on]] + deep] = np.log((ones + DELTA) / (zeros + DELTA)).astype(np.float32)[of]
            sign.append(bits)
            logit.append(share)
            start.append(first + at)
            length.append(n)
            at += len(bits)
            by_leaf.append(order + self.spell * len(by_leaf))
            leaf.append(np.argsort(order))
        self.start, self.length = np.concatenate(start).astype(np.int32), np.concatenate(length).astype(np.int32)
        self.sign, self.logit = np.concatenate(sign), np.concatenate(logit)
        self.one = self.sign > 0
        self.leaf, self.by_leaf, self.left = np.concatenate(leaf), np.concatenate(by_leaf), np.concatenate(left)
        self.ready = True
        return self

    def __getstate__(self):
        return {"words": self.words, "count": self.count, "weight": self.weight, "codes": self.codes, "ready": False}

    def coded(self, docs: list[list[bytes]]):
        """The words of the documents as numbers, how many tokens each has, and the letters and sizes (with their end) of the words to be spelled."""
        size = np.array([len(w) + 1 for w in docs], np.int64)
        token = np.full(int(size.sum()), END, np.int64)
        inner = np.ones(len(token), bool)
        inner[np.cumsum(size) - 1] = False
        words = list(chain.from_iterable(docs))
        flat = np.fromiter(map(self.symbol.get, words, repeat(ESCAPE)), np.int64, len(words))
        token[inner] = flat
        odd = [words[i] for i in np.flatnonzero(flat == ESCAPE).tolist()]
        return token, size, np.frombuffer(b"".join(odd), np.uint8), np.array([len(w) + 1 for w in odd], np.int64)

    def units(self, docs: list[list[bytes]]):
        """All coded symbols of the documents: symbol, two keys (context and symbol), document, place of the token; and symbol and document of all tokens."""
        return self.units_of(*self.coded(docs))

    def units_of(self, token, size, odd, n):
        """units() of documents from what coded() has of them."""
        ends = np.cumsum(size)
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(token)) - np.repeat(ends - size, size)
        last = np.where(place > 0, np.roll(token, 1), END)
        last2 = np.where(place > 1, np.roll(token, 2), END)
        one = last << SYMBOL_BITS | self.leaf[token]
        two = 1 << KIND_AT | last2 << 2 * SYMBOL_BITS | one
        where = np.flatnonzero(token == ESCAPE)
        owner = np.repeat(where, n)
        letter = np.full(int(n.sum()), SPELL_END, np.int64)
        at = np.arange(len(letter)) - np.repeat(np.cumsum(n) - n, n)
        letter[at < np.repeat(n - 1, n)] = odd
        back = [np.where(at >= k, np.roll(letter, k), SPELL_END) << LETTER_BITS * k for k in (1, 2, 3, 4, 5)]
        near = 2 << KIND_AT | back[0] | back[1] | back[2] | self.leaf[letter + self.spell]
        far = 1 << KIND_AT | near | back[3] | back[4]
        join = lambda a, b: np.concatenate([a, b])
        return join(token, letter + self.spell), [join(one, near), join(two, far)], join(doc, doc[owner]), join(place, place[owner]), token, doc

    def bits(self, symbol):
        """Of all code bits of the symbols: flat places, the symbol's number among `symbol`, places for a table in which the bits of each of these begin at 0; where they begin."""
        n = self.length[symbol].astype(np.int64)
        first = np.cumsum(n) - n
        unit = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(unit))
        return at + (self.start[symbol] - first)[unit], unit, at, first

    def symbols(self, key):
        """The symbols of packed keys."""
        return self.by_leaf[np.where(key >> KIND_AT < 2, key & (1 << SYMBOL_BITS) - 1, (key & (1 << LETTER_BITS) - 1) + self.spell)]


def contexts(key: np.ndarray) -> np.ndarray:
    return np.where(key >> KIND_AT < 2, key >> SYMBOL_BITS, key >> LETTER_BITS)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; the end is the empty word. Rows leave a task combined."""

    def run(batches):
        claim(__name__)
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for b in slices(whole):
                some = []
                for i, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                    if not held_out(i):
                        some += words_of(t)
                        some.append(b"")
                seen.update(some)
                if len(seen) > LIMIT:
                    yield rows()
                    seen.clear()
        yield rows()

    return materialize(docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def byte_counts(counts: DataFrame, top: DataFrame) -> np.ndarray:
    """How often each byte, and an end, is spelled in the training words that are not in `top`."""

    def run(batches):
        total = np.zeros(257, np.int64)
        for b in batches:
            n = b.column("n").to_numpy()
            words = b.column("word").to_pylist()
            size = np.array([len(w) for w in words], np.int64)
            total[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, size), minlength=256).astype(np.int64)
            total[SPELL_END] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total)], names=["byte", "n"])

    rest = counts.where(F.octet_length("word") > 0).join(top.select("word"), "word", "left_anti")
    found = {r.byte: r.n for r in rest.select("word", "n").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(b, 0) for b in range(257)], np.int64)


def tuning(doc_id) -> bool:
    """A fortieth of the training documents: they set the starting weights, against the bit counts of the others."""
    return zlib.crc32(b"weights" if doc_id is None else b"weights%d" % doc_id if isinstance(doc_id, int) else b"weights" + str(doc_id).encode()) % TUNING == 0


def states(two: np.ndarray) -> np.ndarray:
    """One byte for counts of (zeros, ones): confidence in the upper two bits, the logit in 64 steps below."""
    n = two.sum(axis=1)
    logit = np.log((two[:, 1] + DELTA) / (two[:, 0] + DELTA))
    step = np.clip(np.rint(logit / LOGIT_STEP) + 32, 0, 63)
    return ((np.searchsorted(CONFIDENCE, n, "right") - 1) * 64 + step).astype(np.uint8)


def in_parts(rows: DataFrame, coder) -> DataFrame:
    """A row for each part of about 2**TABLE_BITS code bits, one document at least: part, use of all its documents (0: held out, 1: bit
    counts, 2: starting weights), number of its first row, doc_ids, coded() and bytes of its documents, how many units they have, and
    every SAMPLED-th key of one in SAMPLED_PARTS."""
    limit = max(1, (1 << TABLE_BITS) // 3)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part long, use int, row long, doc_id array<{kind}>, coded binary, units long, sample array<long>"

    def run(batches):
        claim(f"{__name__}, parts")
        c = coder.value.prepare()
        first = TaskContext.get().partitionId() << 36
        made, ended, filled, number, held = 0, [0] * 3, [0] * 3, [0] * 3, [[], [], []]

        def part(use):
            nonlocal made
            ids = pa.concat_arrays([x[0] for x in held[use]])
            token, size, odd, n, n_bytes = (np.concatenate(x) for x in zip(*(x[1:] for x in held[use]), strict=True))
            some = np.zeros(0, np.int64)
            if sum(ended) % SAMPLED_PARTS == 0:
                _, keys, *_ = c.units_of(token.astype(np.int64), size, odd, n)
                some = np.unique(np.concatenate(keys))[SAMPLED // 2 :: SAMPLED]
            held[use].clear()
            ended[use] += 1
            made += len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made - len(ids)]), pa.array([use], pa.int32()), pa.array([first + made - len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([pack(token, size, odd, n, n_bytes)], pa.binary()), pa.array([len(token) + int(n.sum())]), pa.array([some], pa.list_(pa.int64()))],
                names=["part", "use", "row", "doc_id", "coded", "units", "sample"])

        for whole in batches:
            for b in slices(whole):
                raw, ids = text_bytes(b.column("text")), b.column("doc_id")
                uses = np.array([0 if held_out(i) else 2 if tuning(i) else 1 for i in ids.to_pylist()])
                size = np.array([len(t) + 1 for t in raw], np.int64)
                for use in range(3):
                    mine = np.flatnonzero(uses == use)
                    at = (filled[use] + np.cumsum(size[mine])) // limit
                    filled[use] += int(size[mine].sum())
                    for p in np.unique(at).tolist():
                        if p > number[use] and held[use]:
                            yield part(use)
                        number[use], docs = p, mine[at == p]
                        token, *others = c.coded([words_of(raw[i]) for i in docs.tolist()])
                        held[use].append((ids.take(pa.array(docs)), token.astype(np.int32), *others, size[docs] - 1))
        for use in range(3):
            if held[use]:
                yield part(use)

    return materialize(rows.mapInArrow(run, schema), "parts")


def key_ranges(parts: DataFrame) -> np.ndarray:
    """Rising keys that cut all keys into ranges about as large as each other; no context is parted."""
    units = parts.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units // ASKED))
    some = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.array(r.sample, np.int64) for r in parts.select("sample").where(F.size("sample") > 0).collect())]))
    bits = np.where(some >> KIND_AT < 2, SYMBOL_BITS, LETTER_BITS)
    return np.unique((some >> bits << bits)[np.arange(1, n) * len(some) // n]) if len(some) else some


def parted(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the ranges begin in sorted keys, and the end."""
    return np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])


def pack_keys(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys without repeats, and how often there are such."""
    context = contexts(key)
    first = np.flatnonzero(np.diff(context, prepend=-1))
    leaf = key - np.where(key >> KIND_AT < 2, context << SYMBOL_BITS, context << LETTER_BITS)
    step = np.diff(leaf, prepend=0)
    step[first] = leaf[first]
    return pack(np.diff(context[first], prepend=0), np.diff(np.append(first, len(key))) - 1, step, n)


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    context, more, step, n = unpack(data)
    context, first = np.cumsum(context), np.cumsum(more + 1) - more - 1
    leaf = np.cumsum(step)
    leaf -= np.repeat(leaf[first] - step[first], more + 1)
    words = context >> KIND_AT - SYMBOL_BITS
    leaf += np.repeat(np.where(words < 2, context << SYMBOL_BITS, context << LETTER_BITS), more + 1)
    return leaf, n.astype(np.min_scalar_type(n.max(initial=0)))


def part_keys(docs: DataFrame, coder, bounds: np.ndarray) -> DataFrame:
    """(range, part, use, asked): the keys of each part, by range, and how often its documents have them."""

    def run(batches):
        claim(f"{__name__}, keys")
        c = coder.value.prepare()
        for b in batches:
            for part, use, coded in zip(*(b.column(x).to_pylist() for x in ("part", "use", "coded")), strict=True):
                _, keys, *_ = c.units_of(*unpack(coded)[:4])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                cut = parted(key, bounds)
                ranges = np.flatnonzero(np.diff(cut))
                asked = [pack_keys(key[cut[r] : cut[r + 1]], n[cut[r] : cut[r + 1]] if use else n[:0]) for r in ranges.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(np.full(len(ranges), part, np.int64)), pa.array(np.full(len(ranges), use, np.int32)), pa.array(asked, pa.binary())], names=["range", "part", "use", "asked"])

    return docs.select("part", "use", "coded").mapInArrow(run, "range int, part long, use int, asked binary")


def whole_contexts(batches):
    """Sorted keys with their counts, cut so that no context is parted."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        ends = np.flatnonzero(np.diff(contexts(key))) + 1
        first = contexts(key[:1])[0]
        if held and contexts(held[-1][0][-1:])[0] != first:
            ends = np.concatenate([[0], ends])
        now = [key, *(b.column(x).to_numpy() for x in ("n", "m"))]
        if len(ends):
            yield [np.concatenate(x) for x in zip(*held, [x[: ends[-1]] for x in now], strict=True)]
            held = []
            now = [x[ends[-1] :] for x in now]
        held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


#: The states of two counts that are both below SMALL.
SMALL = 64
FEW = states(np.stack(np.divmod(np.arange(SMALL * SMALL), SMALL), axis=1))


def turned(one: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A state of a bit as if the bit were a one, and back."""
    back = state & np.uint8(192) | -state & np.uint8(63)
    return back ^ (back ^ state) & -np.asarray(one).view(np.uint8)


def states_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = FEW[np.minimum(zeros, SMALL - 1) * SMALL + np.minimum(ones, SMALL - 1)]
    many = np.flatnonzero((zeros >= SMALL) | (ones >= SMALL))
    out[many] = states(np.stack([zeros[many], ones[many]], axis=1))
    return out


def shared_bits(code: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How many first bits the code of each sorted key has in common with that of the key before; -1 in another context."""
    other = code[1:] ^ code[:-1]
    out = np.full(len(code), -1, np.int8)
    out[1:] = np.where(context[1:] == context[:-1], 64 - np.frexp((other & ~(other >> np.uint64(1))).astype(np.float64))[1], -1)
    return out


def depth_counts(size: np.ndarray, code: np.ndarray, context: np.ndarray, n: np.ndarray):
    """For each depth: which of the sorted keys (of some size and code, in a context) have a code bit there, the bit, how often its node has zeros and ones, and which node it is.

    Neighbours in a context with the same first bits are below one node.
    """
    shared, on, deep = shared_bits(code, context), np.arange(len(code)), 0
    while len(on):
        bit = (code >> np.uint64(63 - deep) & np.uint64(1)).astype(bool)
        new = shared < deep
        first = np.flatnonzero(new)
        ones = np.add.reduceat(n * bit, first)
        yield on, bit, np.add.reduceat(n, first) - ones, ones, np.cumsum(new) - 1
        deep += 1
        left = np.flatnonzero(size > deep)
        on, size, code, shared, n = (x[left] for x in (on, size, code, shared, n))


def crowd(code: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How many first bits of each sorted key lie in nodes that other ones share."""
    shared = shared_bits(code, context)
    return np.maximum(shared, np.append(shared[1:], np.int8(-1))) + np.int8(1)


def alone_states(n: np.ndarray) -> np.ndarray:
    """The state of the bits that no other key shares, as if the bit were a one; one that is cut at the lower end only stays 0."""
    return turned(np.zeros(len(n), bool), states_of(n, np.zeros_like(n)))


def path_states(c: Coder, key: np.ndarray, *counts: np.ndarray):
    """For each of the counts, the states of the code bits of each of the sorted keys, from the counts of all symbols of its context; where they end."""
    symbol, context = c.symbols(key), contexts(key)
    size, code = c.length[symbol].astype(np.int64), c.left[symbol]
    ends, out = np.cumsum(size), []
    for n in counts:
        out.append(np.zeros(int(size.sum()), np.uint8))
        for deep, (on, _, zeros, ones, of) in enumerate(depth_counts(size, code, context, n)):
            out[-1][(ends - size)[on] + deep] = states_of(zeros, ones)[of]
    return *out, ends


def key_states(keys: DataFrame, coder) -> DataFrame:
    """(key, states, fitted): a byte for each code bit of the key's symbol; fitted without the tuning documents, for their keys. The plain form of range_states, by rows."""

    def run(batches):
        claim(__name__)
        c = coder.value.prepare()
        for key, n, m in whole_contexts(batches):
            if not len(key):
                continue
            *both, ends = path_states(c, key, n + m, n)
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
            every, fitted = (pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, offsets, pa.py_buffer(x)]) for x in both)
            yield pa.RecordBatch.from_arrays([pa.array(key), every, pc.if_else(pa.array(m > 0), fitted, pa.scalar(None, pa.binary()))], names=["key", "states", "fitted"])

    counts = keys.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    context = F.when(F.shiftright("key", KIND_AT) < 2, F.shiftright("key", SYMBOL_BITS)).otherwise(F.shiftright("key", LETTER_BITS))
    return materialize(counts.repartition(context).sortWithinPartitions("key").mapInArrow(run, "key long, states binary, fitted binary"), "states")


def spread(c: Coder, key: np.ndarray, n: np.ndarray, at: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each of the runs of `at` that begin at `starts`: of key[at] the bits in shared nodes, the state of the others, and by depth the state of each shared node, as if the bit of the first key below it were a one."""
    context, code = contexts(key), c.left[c.symbols(key)]
    most, pair, column, node = crowd(code, context), np.arange(len(at), dtype=np.int32), alone_states(n), np.empty(len(key), np.int32)
    bounds = np.append(starts, len(at)).tolist()
    top, others = most[at], column[at]
    out = [[top[a:b].view(np.uint8), others[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    some = np.flatnonzero(most)
    for deep, (on, bit, zeros, ones, of) in enumerate(depth_counts(most[some], code[some], context[some], n[some])):
        left = np.flatnonzero(top > deep)
        at, pair, top = at[left], pair[left], top[left]
        where = some[on]
        column[where], node[where] = turned(bit, states_of(zeros, ones)[of]), of
        below, cut = node[at], np.searchsorted(pair, starts)
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = below[1:] != below[:-1]
        new[cut] = True
        new = np.flatnonzero(new[:-1])
        values, cut = column[at[new]], np.append(np.searchsorted(new, cut), len(new)).tolist()
        for x, a, b in zip(out, cut, cut[1:], strict=False):
            x.append(values[a:b])
    return [squeeze(top, others, np.concatenate([others[:0], *nodes])) for top, others, *nodes in out]


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys without repeats, and which of them each key is."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key[new], at


def answers(c: Coder, rows: list[tuple[int, int, bytes]]):
    """(part, states, fitted) for the (part, use, asked) of one range; fitted without the tuning documents, for their parts."""
    keys, times = zip(*(unpack_keys(x[2]) for x in rows), strict=True)
    size = np.array([len(k) for k in keys], np.int64)
    starts, use = np.cumsum(size) - size, np.array([x[1] for x in rows])
    key, at = numbered(np.concatenate(keys))
    del keys
    begin, (n, m) = starts.tolist(), np.zeros((2, len(key)), np.int64)
    for x, u, a in zip(times, use.tolist(), begin, strict=True):
        if u:
            (n if u == 1 else m)[at[a : a + len(x)]] += x
    del times
    every, fitted = spread(c, key, n + m, at, starts), [None] * len(rows)
    if len(some := np.flatnonzero(use == 2)):
        at = np.concatenate([at[begin[i] : begin[i] + size[i]] for i in some.tolist()])
        group = np.cumsum(np.diff(contexts(key), prepend=-1) != 0, dtype=np.int32) - 1
        wanted = np.zeros(group[-1] + 1, bool)
        wanted[group[at]] = True
        wanted = wanted[group]
        for i, x in zip(some.tolist(), spread(c, key[wanted], n[wanted], (np.cumsum(wanted) - 1)[at], np.cumsum(size[some]) - size[some]), strict=True):
            fitted[i] = x
    return [(x[0], a, b) for x, a, b in zip(rows, every, fitted, strict=True)]


def range_states(asked: DataFrame, coder, ranges: int) -> DataFrame:
    """(part, range, states, fitted, wave): the answers of all ranges, by the wave of the part."""

    def run(batches):
        claim(f"{__name__}, states")
        c, held = coder.value.prepare(), {}
        for b in batches:
            for r, *row in zip(*(b.column(x).to_pylist() for x in ("range", "part", "use", "asked")), strict=True):
                held.setdefault(r, []).append(row)
        for r in list(held):
            part, every, fitted = zip(*answers(c, held.pop(r)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([r] * len(part), pa.int32()), pa.array(every, pa.binary()), pa.array(fitted, pa.binary())], names=["part", "range", "states", "fitted"])

    return materialize(asked.repartitionById(ranges, "range").mapInArrow(run, "part long, range int, states binary, fitted binary").withColumn("wave", wave()), "states", "wave")


def wave() -> F.Column:
    return F.pmod(F.hash("part"), F.lit(WAVES))


def with_states(docs: DataFrame, known: DataFrame, fn, schema: str) -> DataFrame:
    """fn(a part, the states of its keys by range) for each part; wave by wave, so that only one wave's states lie on the disks twice."""
    def one(i):
        return docs.where(wave() == i).groupBy("part").cogroup(known.where(F.col("wave") == i).drop("wave").groupBy("part")).applyInArrow(fn, schema)

    return reduce(DataFrame.union, [materialize(one(i), "scored") for i in range(WAVES)])


def told(c: Coder, key: np.ndarray, bounds: np.ndarray, known: pa.Table) -> pa.Table:
    """The sorted keys of a part and their states, from the answers of the ranges."""
    symbol, cut = c.symbols(key), parted(key, bounds)
    n, found = np.diff(cut), [b""] * (len(bounds) + 1)
    for r, answer in zip(known.column("range").to_pylist(), known.column("states").to_pylist(), strict=True):
        found[r] = restore(answer)
    begin = np.cumsum([0, *map(len, found)])[:-1]  # of the answers of the ranges
    data = np.frombuffer(b"".join(found), np.uint8)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(key)) + (begin - cut[:-1])[owner]
    most, others = data[place], data[place + n[owner]]
    size = c.length[symbol].astype(np.int64)
    ends, shared = np.cumsum(size), most.astype(np.int64)
    first, done = ends - size, np.cumsum(shared)
    out = np.repeat(others, size)
    for a in range(0, len(key), TOGETHER):
        flat, *_ = c.bits(symbol[a : a + TOGETHER])
        to = slice(first[a], first[a] + len(flat))
        out[to] = turned(c.one[flat], out[to])
    for i in np.flatnonzero(others & np.uint8(63) == 0).tolist():
        out[first[i] : ends[i]] |= np.where(c.one[c.start[symbol[i]] : c.start[symbol[i]] + size[i]], np.uint8(63), np.uint8(0))
    unit = np.repeat(np.arange(len(key), dtype=np.int32), shared)
    deep = np.arange(len(unit), dtype=np.int32) - (done - shared).astype(np.int32)[unit]
    order = np.argsort((owner[unit] * 64 + deep).astype(np.min_scalar_type(64 * len(n))), kind="stable")
    unit, deep = unit[order], deep[order]
    before = shared_bits(c.left[symbol], contexts(key))
    before[cut[:-1][n > 0]] = -1
    new = before[unit] < deep
    left = np.ones(len(data), bool)
    left[place] = left[place + n[owner]] = False
    node = turned(c.one[c.start[symbol[unit[new]]] + deep[new]], data[left])
    out[first[unit] + deep] = node[np.cumsum(new, dtype=np.int32) - np.int32(1)]
    offsets = np.append(0, ends).astype(np.int32)
    return pa.table([pa.array(key), pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(out)])], names=["key", "states"])


GATES = 2 * 4 * 4


class Mixer:
    """Gated weights of the three predictors; the states of a context's code bits lie in the tables from a place on."""

    def __init__(self, coder: Coder, tables, start: np.ndarray):
        self.coder, self.tables, self.start = coder.prepare(), tables, start

    @classmethod
    def of_part(cls, coder: Coder, asked: pa.Table, start: np.ndarray):
        """The mixer of a part, from the keys asked for it and their states."""
        key, first = np.unique(asked.column("key").to_numpy(), return_index=True)
        found = asked.column("states").combine_chunks().take(pa.array(first))
        size = pc.binary_length(found).to_numpy().astype(np.int64)
        m = cls(coder, [np.frombuffer(found.buffers()[2] or b"", np.uint8)[: int(size.sum())]] * 2, start)
        m.key, m.place = key, (np.cumsum(size) - size).astype(np.uint32)
        return m

    def places(self, keys):
        """Where the states of the keys begin."""
        return [self.place[np.searchsorted(self.key, k)] for k in keys]

    def read(self, symbol, places, place_of_gates):
        """Sign, the three logits and the gate of every code bit; bits of each symbol."""
        c = self.coder
        flat, unit, at, first = c.bits(symbol)
        state = [t[at + (x.astype(np.int64) - first)[unit]] for t, x in zip(self.tables, places, strict=True)]
        gate = (place_of_gates + 16 * (symbol >= c.spell))[unit]
        gate += state[0] >> np.uint8(6) << np.uint8(2) | state[1] >> np.uint8(6)
        logit = [((x & np.uint8(63)).view(np.int8) - np.int8(32)).astype(np.float32) * np.float32(LOGIT_STEP) for x in state]
        return c.sign[flat], [c.logit[flat], *logit], gate, first

    @staticmethod
    def margin(sign, logit, gate, weights) -> np.ndarray:
        z = weights[0][gate] * logit[0]
        for k in (1, 2):
            z += weights[k][gate] * logit[k]
        z *= sign
        return z

    @staticmethod
    def learn(weights, curve, sign, logit, gate, margin):
        """Move each weight by a damped Newton step of its own over the coded bits; `curve` adds up what each weight has seen."""
        error = sign / (1 + np.exp(margin))
        for k in range(3):
            push = np.bincount(gate, error * logit[k], len(weights[k]))
            curve[k] += np.bincount(gate, logit[k] * logit[k], len(push))
            weights[k] += (push / (QUARTER * curve[k] + REST)).astype(np.float32)

    def scores(self, docs: list[list[bytes]]):
        """log10 probability of each document; symbol and document of all tokens."""
        symbol, keys, doc, place, token, token_doc = self.coder.units(docs)
        return self.scored(symbol, self.places(keys), doc, place, len(docs)), token, token_doc

    def scored(self, symbol, places, doc, place, n: int) -> np.ndarray:
        """log10 probability of each of n documents, from their units and the places of the states of these."""
        block = place // BLOCK
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(int(block.max(initial=0)) + 2))
        weights, curve = [np.tile(self.start[k], n) for k in range(3)], np.zeros((3, GATES * n))
        total = np.zeros(n)
        for i in range(len(cuts) - 1):
            u = order[cuts[i] : cuts[i + 1]]
            sign, logit, gate, first = self.read(symbol[u], [x[u] for x in places], doc[u] * GATES)
            margin = self.margin(sign, logit, gate, weights)
            lost = np.log1p(np.exp(np.minimum(-margin, np.float32(60))))
            total -= np.bincount(doc[u], np.add.reduceat(lost, first), n)
            if i + 2 < len(cuts):
                self.learn(weights, curve, sign, logit, gate, margin)
        return total / np.log(10)


class Part:
    """A part's documents, and the mixer that knows the states of their keys."""

    def __init__(self, coder: Coder, coded: bytes, bounds: np.ndarray, known: pa.Table, start: np.ndarray):
        self.token, self.size, self.odd, self.odd_size, self.n_bytes = unpack(coded)
        self.symbol, keys, self.doc, self.place, _, self.token_doc = coder.units_of(self.token, self.size, self.odd, self.odd_size)
        key, at = numbered(np.concatenate(keys))
        self.mixer = Mixer.of_part(coder, told(coder, key, bounds, known), start)
        self.places = np.split(self.mixer.place[at], 2)

    def pieces(self):
        """First and last document, and units, of pieces of about PIECE_TOKENS tokens."""
        piece = (np.cumsum(self.size) - 1) // PIECE_TOKENS
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        order = np.argsort(piece[self.doc], kind="stable")
        cut = np.append(np.searchsorted(piece[self.doc][order], piece[first]), len(order))
        for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(piece)], strict=True)):
            yield a, b, order[cut[i] : cut[i + 1]]

    def scores(self) -> np.ndarray:
        return np.concatenate([self.mixer.scored(self.symbol[u], [x[u] for x in self.places], self.doc[u] - a, self.place[u], b - a) for a, b, u in self.pieces()])

    def rare(self) -> list[Counter]:
        """The words of each document that have to be spelled."""
        data, ends = self.odd.astype(np.uint8).tobytes(), np.cumsum(self.odd_size - 1).tolist()
        out = [Counter() for _ in self.size]
        for d, a, b in zip(self.token_doc[self.token == ESCAPE].tolist(), [0, *ends], ends, strict=False):
            out[d][data[a:b]] += 1
        return out


def tuned_weights(docs: DataFrame, known: DataFrame, coder, bounds: np.ndarray) -> np.ndarray:
    """Starting weights by gate: logistic regression over all bits of the tuning documents, by Newton steps."""
    weights = np.array([[1.0] * GATES, [0.1] * GATES, [0.1] * GATES])

    def bits(rows, asked):
        claim(f"{__name__}, weights")
        c, out = coder.value.prepare(), []
        for coded in rows.column("coded").to_pylist():
            part = Part(c, coded, bounds, asked, np.zeros(0))
            for _, _, u in part.pieces():
                _, unit, at, first = c.bits(part.symbol[u])
                out.append([pack(part.symbol[u]), *(squeeze(t[at + (x[u].astype(np.int64) - first)[unit]]) for t, x in zip(part.mixer.tables, part.places, strict=True))])
        return pa.table([pa.array(x, pa.binary()) for x in zip(*out, strict=True)] or [pa.array([], pa.binary())] * 3, names=["symbol", "one", "two"])

    some = with_states(docs.where("use = 2").select("part", "coded"), known.where("fitted is not null").select("part", "range", "wave", F.col("fitted").alias("states")), bits, "symbol binary, one binary, two binary")
    cells = [(i, j) for i in range(3) for j in range(i, 3)]

    def step(start):
        def run(batches):
            c, sums = coder.value.prepare(), np.zeros((9, GATES))
            for b in batches:
                for symbol, *state in zip(*(b.column(x).to_pylist() for x in ("symbol", "one", "two")), strict=True):
                    (symbol,) = unpack(symbol)
                    m = Mixer(c, [np.frombuffer(restore(x), np.uint8) for x in state], start)
                    first = np.cumsum(c.length[symbol], dtype=np.int64) - c.length[symbol]
                    sign, logit, gate, _ = m.read(symbol, [first, first], np.zeros(len(symbol), np.int64))
                    missed = 1 / (1 + np.exp(m.margin(sign, logit, gate, start)))
                    sums[:3] += [np.bincount(gate, sign * missed * x, GATES) for x in logit]
                    sums[3:] += [np.bincount(gate, missed * (1 - missed) * logit[i] * logit[j], GATES) for i, j in cells]
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), pa.array(sums.T.tolist(), pa.list_(pa.float64()))], names=["gate", "sums"])

        parts = some.mapInArrow(run, "gate int, sums array<double>").select("gate", F.posexplode("sums").alias("at", "x")).groupBy("gate", "at").agg(F.sum("x").alias("x"))
        out = np.zeros((9, GATES))
        for r in parts.collect():
            out[r["at"], r["gate"]] = r["x"]
        return out

    for _ in range(NEWTON):
        sums = step(weights.astype(np.float32))
        for g in range(GATES):
            h = RIDGE * np.eye(3)
            for x, (i, j) in zip(sums[3:, g], cells, strict=True):
                h[i, j] = h[j, i] = h[i, j] + x
            weights[:, g] += np.clip(np.linalg.solve(h, sums[:3, g]), -0.5, 0.5)
    return weights.astype(np.float32)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if top_words + 2 >= 1 << SYMBOL_BITS:
        raise ValueError(f"top_words must be below {(1 << SYMBOL_BITS) - 2}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with shuffles_let_go(docs.sparkSession):
        counts, total, under, scored = scored_parts(rows, top_words)
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(float(under)))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    return scored.drop("words", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def scored_parts(rows: DataFrame, top_words: int):
    """Counts of all training words, their sum, log10 of the base score's denominator, and a row for each document with its words that are not in the top."""
    counts = count_words(rows)
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    top = materialize(counts.where(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(top_words), "top-words")
    best = [(bytes(r.word), r.n) for r in top.collect()]
    coder = Coder([w for w, _ in best], [n for _, n in best], ends, total - ends - sum(n for _, n in best), byte_counts(counts, top))
    sent = rows.sparkSession.sparkContext.broadcast(coder)
    parts = in_parts(rows, sent)
    bounds = key_ranges(parts)
    known = range_states(part_keys(parts, sent, bounds), sent, len(bounds) + 1)
    start = tuned_weights(parts, known, sent, bounds)
    under = np.log10(total + 0.1 * (distinct + 1))
    token_score = np.log10(coder.count + 0.1) - under
    kind = rows.schema["doc_id"].dataType.simpleString()

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, words array<binary>, times array<long>"

    def run(rows, asked):
        claim(f"{__name__}, scores")
        c, made = sent.value.prepare(), []
        for i in range(rows.num_rows):
            part = Part(c, rows.column("coded")[i].as_py(), bounds, asked, start)
            size, (first, out), rare = len(part.size), (rows.column(x)[i].as_py() for x in ("row", "use")), part.rare()
            base = np.bincount(part.token_doc, np.where(part.token == ESCAPE, 0.0, token_score[part.token]), minlength=size)
            known = np.bincount(part.token_doc, (part.token != ESCAPE) & (c.count[part.token] > 0), minlength=size).astype(np.int64)
            made.append(pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(size)), rows.column("doc_id")[i].values, pa.array(np.full(size, out == 0)), pa.array(part.size), pa.array(known), pa.array(base), pa.array(part.scores()),
                 pa.array(part.n_bytes), pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "words", "times"]))
        return pa.Table.from_batches(made)

    return counts, total, under, with_states(parts.select("part", "use", "row", "doc_id", "coded"), known.select("part", "range", "wave", "states"), run, schema)
