"""How the sources of a language differ: exact term counts by CountVectorizer, sums by source, and distances of all pairs of sources.

A document's terms carry its language in front, so one CountVectorizer with minDF and the largest vocabSize has the vocabulary of
every language with that language's own document frequency, in one pass. Its sparse vectors are summed by (language, source) in the
tasks and then over the tasks; a sum keeps only terms that occur. Shares are whole numbers: 1 + floor(10^9 (count + 5) / (N + 5 V)).

The distance of two sources is a sum over all kept terms, most of which occur in neither: those differ by the two default shares, and are
counted, not listed. Terms are dealt in blocks of TERM_BLOCK, sources in blocks of SOURCE_BLOCK; a task gets one block of terms
and two of sources, and gives a partial sum for each pair. A row is copied once for each block of sources of its language.

Terms are cut by whole arrays. A first pass counts documents by slots of term hashes; terms in slots with fewer than minDF documents are surely
rare and do not reach the CountVectorizer, which counts exactly what is left. The number of slots follows the size of the texts up to 2^24 (2 MB of
bits); beyond that more rare terms pass, which costs time but changes nothing. For the vocabulary every term comes once a document, for the vectors as
often as it occurs. The vocabulary is held by the driver and sent to the tasks, so its size is estimated first, from one of SAMPLED term hashes: it decides
into how many parts terms are cut by their hash, each of about VOCABULARY_TERMS; each part is fitted for itself.

Cases: null text, language or source counts as empty; a document without terms still makes its (language, source) occur; a language
without kept terms has distances of 0 and no term rows; a single source has no pairs; equal values are ordered by item, as UTF-8 bytes;
repeated rows are so many documents; an empty table gives no rows; other columns, whatever their names, play no part.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .common import claim, hash_spans, joined, mix, slices, text_bytes

SPLIT = b"\x00"
MOST = 2**31 - 1
VOCABULARY_TERMS = 1 << 21
TERM_BLOCK = 2048
SOURCE_BLOCK = 128
COUNT_BLOCK = 4096
HELD = 1 << 20
#: Texts are cut in pieces of so many bytes, for which arrays of places take some twenty times as much.
PIECE_BYTES = 1 << 20
#: Slots that sort out rare terms: one for so many bytes of text, within these powers of two; sent in ranges of so many, because Spark hands
#: rows to Python ten thousand at a time, whatever their size.
SLOT_BYTES, SLOT_BITS, SLOT_RANGE = 64, (16, 24), 1024
#: One of so many term hashes is counted exactly, to know the size of the vocabulary before it is made.
SAMPLED = 1024

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


class Terms:
    """All terms of the texts of a batch, in order: where they stand, whose they are, and a hash of language and term."""

    def __init__(self, b: pa.RecordBatch):
        texts = text_bytes(b.column(b.schema.get_field_index("text")))
        langs = [x.encode() + SPLIT for x in b.column(b.schema.get_field_index("lang")).to_pylist()]
        data, begin = joined(texts)
        data = LOWERED[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = LETTER[data]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.size = np.flatnonzero(step == -1) - self.start
        self.owner = np.searchsorted(begin, self.start, "right") - 1
        self.n = len(texts)
        known = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        of = np.array([known[x] for x in langs], np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in known], np.uint64)
        self.hash = mix(hash_spans(data, self.start, self.size) ^ seeds[of[self.owner]])
        # the languages stand behind the texts, so that a term's two parts are cut from one array
        self.data = np.concatenate([data, np.frombuffer(b"".join(known), np.uint8)])
        length = np.array([len(x) for x in known], np.int64)
        self.lang_start, self.lang_size = (len(data) + np.cumsum(length) - length)[of], length[of]

    def once(self) -> np.ndarray:
        """Places of the first of equal terms of each document."""
        key = self.owner.astype(np.uint64) << np.uint64(40) | self.hash >> np.uint64(24)
        order = np.argsort(key)
        key, h = key[order], self.hash[order]
        same = key[1:] == key[:-1]
        if (same & (h[1:] != h[:-1])).any():  # other terms with the same 40 bits
            order = np.lexsort((self.hash, self.owner))
            h, owner = self.hash[order], self.owner[order]
            same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        return np.sort(order[np.concatenate([np.ones(min(1, len(order)), bool), ~same])])

    def words(self, chosen: np.ndarray) -> pa.Array:
        """For each document the list of its chosen terms, each behind its language."""
        owner = self.owner[chosen]
        start = np.stack([self.lang_start[owner], self.start[chosen]], 1).ravel()
        size = np.stack([self.lang_size[owner], self.size[chosen]], 1).ravel()
        end = np.cumsum(size)
        at = np.repeat(start - end + size, size)
        at += np.arange(len(at))
        offsets = np.concatenate([[0], end[1::2]]).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_string(), len(chosen), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])]).cast(pa.string())
        lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(lists), flat)


def slot_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def frequent_slots(base: DataFrame, min_df: int, bits: int) -> tuple[bytes, int]:
    """(a bit for each slot of term hashes with at least min_df documents, about how many terms have so many).

    A slot counts the documents of all its terms, so a term in an unset slot is surely rare; counts beyond min_df are cut to it."""
    width = min(1 << bits, SLOT_RANGE)
    ranges = (1 << bits) // width
    kind = np.uint8 if min_df < 256 else np.uint32

    def count(batches):
        claim(f"{__name__}.slots")
        counts = np.zeros(1 << bits, np.uint32)
        exact: dict = {}
        for b in (x for whole in batches for x in slices(whole, PIECE_BYTES)):
            t = Terms(b)
            h = t.hash[t.once()]
            np.add.at(counts, slot_of(h, bits), np.uint32(1))
            some, n = np.unique(h[h % np.uint64(SAMPLED) == 0], return_counts=True)
            for x, k in zip(some.tolist(), n.tolist(), strict=True):
                exact[x] = exact.get(x, 0) + k
        cut = np.minimum(counts, min_df, out=counts).astype(kind, copy=False).reshape(ranges, width)
        del counts
        some = [r for r in range(ranges) if cut[r].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([cut[r].tobytes() for r in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names=["range", "counts", "hash", "docs"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(exact), pa.int32()), pa.nulls(len(exact), pa.binary()), pa.array(np.array(list(exact), np.uint64).view(np.int64)), pa.array(list(exact.values()), pa.int64())], names=["range", "counts", "hash", "docs"])

    def total(batches):
        sums: dict = {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, kind)
                sums[r] = np.minimum(sums[r].astype(np.uint64) + own, min_df).astype(kind) if r in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= min_df, bitorder="little").tobytes() for s in sums.values()], pa.binary())], names=["range", "bits"])

    made = materialize(base.mapInArrow(count, "range int, counts binary, hash long, docs long"), "slots")
    out = np.zeros((ranges, width // 8), np.uint8)
    for r in made.where("range is not null").select("range", "counts").repartition("range").mapInArrow(total, "range int, bits binary").collect():  # at most 2 MB
        out[r["range"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    kept = made.where("hash is not null").groupBy("hash").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_df).count()
    return out.tobytes(), kept * SAMPLED


def words_of(base: DataFrame, bits: int, frequent: bytes, part: int, parts: int, once: bool) -> DataFrame:
    """lang, source and words: the terms of a part that are not surely rare, all of them or once for each document."""

    def run(batches):
        claim(f"{__name__}.words")
        keep = np.frombuffer(frequent, np.uint8)
        for b in (x for whole in batches for x in slices(whole, PIECE_BYTES)):
            t = Terms(b)
            chosen = t.once() if once else np.arange(len(t.start))
            slot = slot_of(t.hash[chosen], bits)
            use = (keep[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            if parts > 1:
                use &= t.hash[chosen] % np.uint64(parts) == part
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("lang", "source")] + [t.words(chosen[use])], names=["lang", "source", "words"])

    return base.mapInArrow(run, "lang string, source string, words array<string>")


def summed(vectors: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, sparse vector) -> (lang, source, number, count): sums of a task, sent in blocks of numbers, then sums of a block."""
    packed = "lang string, source string, block int, numbers binary, counts binary"

    def flush(names, keys, values):
        key = np.concatenate(keys)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.add.reduceat(np.concatenate(values)[order], first).astype("<i8")
        key = key[first]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] // COUNT_BLOCK != key[:-1] // COUNT_BLOCK]))
        ends = np.append(cuts[1:], len(key))
        own = [names[k >> 32] for k in key[cuts].tolist()]
        place = (key % COUNT_BLOCK).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in own], pa.string()), pa.array([n[1] for n in own], pa.string()), pa.array(((key[cuts] & 0xFFFFFFFF) // COUNT_BLOCK).astype(np.int32)),
                                          pa.array([place[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()), pa.array([count[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())],
                                         names=["lang", "source", "block", "numbers", "counts"])

    def by_task(batches):
        known: dict = {}
        keys, values, held = [], [], 0
        for b in batches:
            owner = np.array([known.setdefault(k, len(known)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
            v = b.column(2)
            at = v.field("indices")
            n = np.diff(at.offsets.to_numpy())
            keys.append(np.repeat(owner, n) << 32 | at.flatten().to_numpy().astype(np.int64))
            values.append(v.field("values").flatten().to_numpy())
            held += len(keys[-1])
            if held > most or len(known) > most:
                yield from flush(list(known), keys, values)
                known, keys, values, held = {}, [], [], 0
        if known:
            yield from flush(list(known), keys, values)

    def rows(key, sums):
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.string()), pa.array([key[1]] * len(at), pa.string()), pa.array((key[2] * COUNT_BLOCK + at).astype(np.int32)), pa.array(sums[at])],
                                          names=["lang", "source", "number", "count"])

    def by_block(batches):
        key, sums = None, None
        for b in batches:
            for lang, source, block, numbers, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (lang, source, block):
                    if key is not None:
                        yield rows(key, sums)
                    key, sums = (lang, source, block), np.zeros(COUNT_BLOCK, np.int64)
                sums[np.frombuffer(numbers, "<u2")] += np.frombuffer(counts, "<i8")
        if key is not None:
            yield rows(key, sums)

    group = ["lang", "source", "block"]
    sent = vectors.select("lang", "source", "vector").mapInArrow(by_task, packed)
    return sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(by_block, "lang string, source string, number int, count long")


def count_terms(base: DataFrame, min_df: int, limit: int = VOCABULARY_TERMS, slot_bits: int | None = None) -> DataFrame:
    """(lang, source, term, count) of the kept terms that occur there (stored)."""
    from pyspark.ml.feature import CountVectorizer  # here, because each Python worker that imports it has 50 MB more

    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = slot_bits or min(max((size // SLOT_BYTES).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    frequent, kept = frequent_slots(base, min_df, bits)
    parts, made = -(-kept // limit) or 1, []
    for k in range(parts):
        try:
            model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(min_df), vocabSize=MOST).fit(words_of(base, bits, frequent, k, parts, once=True))
        except Exception as e:
            if "vocabulary size should be > 0" not in str(e):
                raise
            continue  # no term is in enough documents
        vocabulary = [w.rpartition(SPLIT.decode()) for w in model.vocabulary]
        named = pa.table({"number": pa.array(range(len(vocabulary)), pa.int32()), "term": pa.array([v[2] for v in vocabulary], pa.string())})
        terms = materialize(base.sparkSession.createDataFrame(named), "vocabulary")
        counts = summed(model.transform(words_of(base, bits, frequent, k, parts, once=False)))
        made.append(materialize(counts.join(terms, "number").select("lang", "source", "term", "count"), "counts"))
    if not made:
        return base.sparkSession.createDataFrame([], "lang string, source string, term string, count long")
    return reduce(DataFrame.unionAll, made)


def share(count: str, total: str = "total", kept: str = "kept") -> F.Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)) in whole numbers; null if no term is kept."""
    return F.expr(f"case when {kept} > 0 then 1 + cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0)) div cast({total} + 5 * {kept} as decimal(20,0)) end")


def distances(rows: DataFrame, groups: DataFrame, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, a, b, value) for each pair of groups of a language, a before b.

    rows: lang, slot, number (of the term, gapless within the language), p; groups: lang, slot, kept, p0. A mark of each group
    goes to every block of terms, so that a task knows all its sources.
    """
    marks = groups.select("lang", "slot", F.explode(F.expr(f"sequence(0L, (kept - 1) div {term_block})")).alias("block"), F.lit(-1).cast("long").alias("number"), F.col("p0").alias("p"))
    entries = rows.select("lang", "slot", F.expr(f"number div {term_block}").alias("block"), "number", "p").unionAll(marks.where("p is not null"))
    most = groups.groupBy("lang").agg(F.expr(f"max(slot) div {source_block}").alias("last"))
    own = F.expr(f"slot div {source_block}")
    dealt = entries.join(most, "lang").select("lang", "slot", "block", "number", "p", F.explode(F.expr("sequence(0L, last)")).alias("other"))
    tiles = dealt.select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "slot", "number", "p").repartition("lang", "block", "low", "high")
    schema = "lang string, a long, b long, part long, terms long"
    partial = tiles.groupBy("lang", "block", "low", "high").applyInArrow(tile_sums(source_block), schema)
    return partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))


def tile_sums(source_block: int):
    """Sums of differences over the terms of a block that occur in a tile; `terms` counts them."""

    def run(key, t):
        lang, _, low, high = (k.as_py() for k in key)
        slot, number, p = (t.column(c).to_numpy() for c in ("slot", "number", "p"))
        marks = number < 0
        slots, first = np.unique(slot[marks], return_index=True)
        found, at = np.unique(number[~marks], return_inverse=True)
        m = np.repeat(p[marks][first][:, None], len(found), axis=1)
        m[np.searchsorted(slots, slot[~marks]), at] = p[~marks]
        a, b, part = [], [], []
        for i in np.flatnonzero(slots // source_block == low):
            others = np.flatnonzero((slots > slots[i]) & (slots // source_block == high))
            a.append(np.full(len(others), slots[i]))
            b.append(slots[others])
            part.append(np.abs(m[others] - m[i]).sum(axis=1))
        a, b, part = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b, part))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "part": part, "terms": np.full(len(a), len(found), np.int64)})

    return run


def audit(docs: DataFrame, min_df: int = 30, top: int = 50, limit: int = VOCABULARY_TERMS, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK, slot_bits: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` compares a source with each other one of its language, `term` lists the `top`
    terms of which it has more than its language."""
    base = columns(docs)
    counts = count_terms(base, min_df, limit, slot_bits)
    numbers = counts.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"))
    numbers = materialize(number_terms(numbers), "terms")
    langs = numbers.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    occurring = base.select("lang", "source").distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("slot", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = materialize(groups.withColumn("p0", share("0")), "groups")
    rows = counts.join(numbers, ["lang", "term"]).join(groups.drop("p0"), ["lang", "source"])
    rows = materialize(rows.select("lang", "source", "slot", "number", "term", share("count").alias("p"), share("in_lang", "lang_total").alias("q")), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = groups.select("lang", "slot", "source", "p0", "kept")
    a, b = (named.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("slot", "source", "p0")), *(["kept"] if x == "a" else [])) for x in "ab")
    sums = distances(rows, groups, term_block, source_block)
    both = a.join(b, (a.lang == b.lang) & (a.slot_a < b.slot_b)).drop(b.lang)
    pairs = both.join(sums.withColumnsRenamed({"a": "slot_a", "b": "slot_b"}), ["lang", "slot_a", "slot_b"], "left")
    absent = (F.col("kept") - F.col("terms")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    pairs = materialize(pairs.select("lang", "source_a", "source_b", F.coalesce(F.col("part") + absent, F.lit(0)).cast("long").alias("value")), "pairs")
    ways = reduce(DataFrame.unionAll, [pairs.select("lang", F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), "value") for x, y in ("ab", "ba")])
    ways = ways.withColumn("rank", F.row_number().over(order))
    return reduce(DataFrame.unionAll, [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", ways), ("term", over))])


def number_terms(terms: DataFrame) -> DataFrame:
    """Gapless numbers of the terms of a language, in any order, without a window over all of them: by hash range, then offsets."""
    ranges = 1024
    cut = terms.withColumn("_range", F.pmod(F.xxhash64("term"), F.lit(ranges)))
    inside = cut.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_range").orderBy("term")))
    before = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("lang", "_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return inside.join(starts, ["lang", "_range"]).select("lang", "term", "in_lang", (F.col("_start") + F.col("_place") - 1).alias("number"))
