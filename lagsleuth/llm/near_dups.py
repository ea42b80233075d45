"""Near-duplicate groups with fast similarity sketching, banding and exact verification.

Sketch of a set, t coordinates: in round i every element is hashed to a coordinate with a value between i and i + 1; in the rounds
from t on all elements compete for coordinate i - t, so that every coordinate is filled after 2t rounds at most (about log t for
sets larger than t). A coordinate holds its least value; two sets agree in it with the probability of their similarity, and the
share of agreeing coordinates is concentrated as for independent ones. Bands of `rows` coordinates make the buckets; with 50 bands
of 5, a pair of similarity 0.8 shares no bucket with a probability of 2.4e-9. The last round compares sketches first; they agree
less than it asks for (0.8 - SLACK of the coordinates) with a probability of 4e-11, so a pair is lost with 2.5e-9 at most.

Equal sets are one node from the start. Links are found in three rounds, so that a group of n copies costs about n comparisons:
1. each node with one bucket leader (the node that shares most buckets with others), that with which it shares most buckets;
2. all (node, bucket leader) pairs in different components;
3. nodes outside a bucket's main component with the partner whose sketch agrees most, and then, in blocks of bounded size, with all
   partners in other components whose sketches agree enough; a block returns links, not pairs.
Every pair is confirmed on the full shingle sets. Components are joined by rounds of least labels over written tables. Nothing that
grows with the documents comes to the driver.

Cases: a text without words has an empty set and no link; one with fewer words than a shingle is one shingle; rows with the same id
are one document (each row is returned); rows with a null id link nothing and have no component, kept is true; further columns are
not passed on; empty tables give empty results.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import add_columns, mix, text_bytes, text_words

COORDINATES, ROWS = 250, 5
SLACK = 0.18
BLOCK = 4096
EMPTY = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct hashed shingles of each text, sorted. Words are parted by ASCII white space, A-Z are lower case."""
    h, count = text_words([t.lower() for t in texts])
    first = np.cumsum(count) - count
    n = max(0, len(h) - size + 1)
    runs = h[:n].copy()
    for k in range(1, size):
        runs = mix(runs) + h[k : k + n]
    runs = mix(runs)
    out = []
    for a, m in zip(first.tolist(), count.tolist(), strict=True):
        if m >= size:
            out.append(np.unique(runs[a : a + m - size + 1]))
        else:
            whole = np.full(1, m, np.uint64)
            for x in h[a : a + m]:
                whole = mix(whole) + x
            out.append(mix(whole)[: min(m, 1)])
    return out


def shingles(text: bytes, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t 64-bit coordinates for each set; an empty set has EMPTY everywhere."""
    out = np.full((len(sets), t), EMPTY, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    open_ = size > 0
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    for i in range(2 * t):
        if not len(items):
            break
        x = mix(items ^ mix(np.full(1, i + 1, np.uint64))[0])
        at = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out.reshape(-1), owner * t + at, np.uint64(i << 32) | (x & np.uint64(0xFFFFFFFF)))
        still = open_ & (out == EMPTY).any(axis=1)
        if not (still == open_).all():
            stay = still[owner]
            items, owner, open_ = items[stay], owner[stay], still
    return out


def short(sketch: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate, enough for bands and estimates."""
    return (mix(sketch) & np.uint64(0xFFFF)).astype("<u2")


def sketch_rows(docs: DataFrame, doc_id: str, text: str, size: int, t: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def fn(b: pa.RecordBatch):
        sets = shingle_sets(text_bytes(b.column("text")), size)
        s = short(sketches(sets, t))
        return [[len(x) for x in sets], [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets], [r.tobytes() if len(x) else None for r, x in zip(s, sets, strict=True)]]

    return add_columns(rows, "n long, digest binary, sketch binary", fn).select("id", "n", "digest", "sketch")


def band_keys(nodes: DataFrame, t: int, rows: int) -> DataFrame:
    """(key, id) for each band of each node."""
    bands = t // rows

    def run(batches):
        for b in batches:
            s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u2").reshape(-1, t)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(s), bands)).copy()
            for k in range(rows):
                key = mix(key) + s[:, k : bands * rows : rows].astype(np.uint64)
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64).ravel()), pa.array(ids, pa.int64())], names=["key", "id"])

    return nodes.select("id", "sketch").mapInArrow(run, "key long, id long")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets have 100 * intersection >= percent * union."""
    left, right = (texts.select(F.col("id").alias(c), F.col("packed").alias(f"{c}_packed")) for c in "ab")

    def run(batches):
        open_, known = zstandard.ZstdDecompressor(), {}
        for b in batches:
            keep = []
            for i, (p, q) in enumerate(zip(b.column("a_packed").to_pylist(), b.column("b_packed").to_pylist(), strict=True)):
                two = []
                for x in (p, q):
                    if x not in known:
                        if len(known) > 64:
                            known.clear()
                        known[x] = shingles(open_.decompress(x), size)
                    two.append(known[x])
                both = len(np.intersect1d(*two, assume_unique=True))
                if 100 * both >= percent * (len(two[0]) + len(two[1]) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    found = pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")
    return materialize(found, "links")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after the links are added: comp is the least comp that is reachable."""
    def named(c):
        return labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))

    edges = links.join(named("a"), "a").join(named("b"), "b").where("a_comp <> b_comp").select(F.col("a_comp").alias("x"), F.col("b_comp").alias("y"))
    edges = materialize(edges.union(edges.select("y", "x")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    least = edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("comp"))
    least = materialize(least, "least")
    while True:
        near = edges.join(least.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        new = least.join(near.withColumnRenamed("x", "id"), "id").select("id", "comp", F.least("comp", "m").alias("low"))
        jump = new.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = materialize(new.join(jump, "low").select("id", F.least("low", "far").alias("comp"), F.col("comp").alias("old")), "least")
        least = new.select("id", "comp")
        if new.where("comp <> old").isEmpty():
            break
    return materialize(labels.join(least.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")


def other_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, dealt to blocks.

    Each node outside the bucket's main component (`other`) meets all rows of the bucket, in a grid of blocks of bounded size.
    `in_main` stays what it is here when components are merged later: it says which rows never look from their side.
    """
    rows_of = shared.join(labels, "id")
    sizes = rows_of.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("size"), F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("main_size"))
    mixed = sizes.where("comps > 1").select("key", "main", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks"), F.expr(f"cast(ceil((size - main_size) / {BLOCK}) as int)").alias("other_blocks"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = rows_of.join(mixed, "key").withColumn("other", F.explode(F.expr("if(comp = main, array(false), array(false, true))")))
    each = each.withColumn("x", F.explode(F.when(F.col("other"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block("blocks")))))
    each = each.withColumn("y", F.explode(F.when(F.col("other"), F.array(block("other_blocks"))).otherwise(F.sequence(F.lit(0), F.col("other_blocks") - 1))))
    return each.select("key", "x", "y", "id", "comp", (F.col("comp") == F.col("main")).alias("in_main"), "other")


def block_groups(batches):
    """Rows sorted by key, x, y: (batch, ranges of whole groups)."""
    held = []

    def cut(b, last):
        change = np.zeros(b.num_rows - 1, bool)
        for c in ("key", "x", "y"):
            v = b.column(c).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        ends = [*(np.flatnonzero(change) + 1).tolist(), *[b.num_rows] * last]
        return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        first, last = held[0], b
        if all(first.column(c)[0] == last.column(c)[last.num_rows - 1] for c in ("key", "x", "y")):
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else b
        ranges = cut(whole, False)
        yield whole, ranges
        held = [whole.slice(ranges[-1][1])]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, cut(whole, True)


class Block:
    """One group of rows; partners(i): places of rows of other components that agree enough with row i."""

    def __init__(self, b, start, end, t, percent):
        self.id, self.comp = (b.column(c).to_numpy(zero_copy_only=False)[start:end] for c in ("id", "comp"))
        self.other = b.column("other").to_numpy(zero_copy_only=False)[start:end]
        self.key = b.column("key")[start].as_py()
        self.t, self.need = t, (percent / 100 - SLACK) * t
        self.sketch = np.frombuffer(b"".join(b.column("sketch").slice(start, end - start).to_pylist()), "<u2").reshape(-1, t)
        self.all = np.flatnonzero(~self.other)
        self.in_main = b.column("in_main").to_numpy(zero_copy_only=False)[start:end][self.all]

    def partners(self, i):
        c = self.all[(self.comp[self.all] != self.comp[i]) & ((self.id[self.all] > self.id[i]) | self.in_main)]
        same = self.sketch[c] == self.sketch[i]
        agree = same.sum(axis=1)
        on = agree >= self.need
        return c[on], same[on], agree[on]

    def here_first(self, i, same, rows):
        """Whether this bucket is the first that the pair shares."""
        bands = self.t // rows
        first = same[:, : bands * rows].reshape(len(same), bands, rows).all(axis=2).argmax(axis=1)
        k = first.astype(np.uint64)
        for r in range(rows):
            k = mix(k) + self.sketch[i, first * rows + r].astype(np.uint64)
        return mix(k).view(np.int64) == self.key


def marked(rows_of: DataFrame, nodes: DataFrame, t: int, percent: int) -> DataFrame:
    """Rows of other_rows that have partners, each node outside the main component with its best partner."""

    def run(batches):
        for b, ranges in block_groups(batches):
            take, partner = [], []
            for start, end in ranges:
                g = Block(b, start, end, t, percent)
                more = np.zeros(end - start, bool)
                for i in np.flatnonzero(g.other):
                    c, _, agree = g.partners(i)
                    if len(c):
                        take.append(start + int(i))
                        partner.append(int(g.id[c[agree.argmax()]]))
                        more[c] |= len(c) > 1
                take += (start + np.flatnonzero(more)).tolist()
                partner += [None] * int(more.sum())
            some = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(c) for c in ("key", "x", "y", "id", "in_main", "other")] + [pa.array(partner, pa.int64())], names=["key", "x", "y", "id", "in_main", "other", "partner"])

    ready = rows_of.join(nodes.select("id", "sketch"), "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return materialize(ready.mapInArrow(run, "key long, x int, y int, id long, in_main boolean, other boolean, partner long"), "marked")


def links_in_blocks(rows_of: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, t: int, rows: int, size: int, percent: int) -> DataFrame:
    """(a, b): of each marked node one link into each other component that it is linked with in a block, confirmed on the full sets."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for b, ranges in block_groups(batches):
            out = []
            for start, end in ranges:
                comp = b.column("comp").to_numpy(zero_copy_only=False)[start:end]
                if (comp == comp[0]).all():
                    continue
                g = Block(b, start, end, t, percent)
                sets: dict[int, np.ndarray] = {}

                def words_of(k, start=start, sets=sets, b=b):
                    if k not in sets:
                        sets[k] = shingles(open_.decompress(b.column("packed")[start + k].as_py()), size)
                    return sets[k]

                for i in np.flatnonzero(g.other):
                    c, same, agree = g.partners(i)
                    if len(c):
                        on = g.here_first(i, same, rows)
                        c, done = c[on][np.argsort(-agree[on], kind="stable")], set()
                        for k in c.tolist():
                            if g.comp[k] not in done:
                                both = len(np.intersect1d(words_of(int(i)), words_of(k), assume_unique=True))
                                if 100 * both >= percent * (len(words_of(int(i))) + len(words_of(k)) - both):
                                    out.append((int(g.id[i]), int(g.id[k])))
                                    done.add(g.comp[k])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])

    ready = rows_of.drop("partner", "comp").distinct().join(labels, "id").join(nodes.select("id", "sketch"), "id").join(texts, "id")
    ready = ready.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return materialize(ready.mapInArrow(run, "a long, b long"), "links")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, t: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the group), kept (its first document)."""
    sketched = materialize(sketch_rows(docs, doc_id, text, size, t), "sketches")
    sets = sketched.where("id is not null and digest is not null")
    first = materialize(sets.groupBy("digest").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch")), "nodes")
    nodes = first.select(F.col("node").alias("id"), "sketch")
    same_id = sets.select("id", "digest").join(first.select("digest", "node"), "digest").select("id", "node").where("id <> node").distinct()

    keys = materialize(band_keys(nodes, t, rows), "bands")
    shared = materialize(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").dropDuplicates(["key", "id"]), "buckets")
    score = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("score"))
    leader = shared.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("low"))).alias("best")).select("key", (-F.col("best.low")).alias("leader"))
    led = materialize(shared.join(leader, "key").where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("both")), "led")

    body = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    wanted = body.join(shared.select("id").distinct(), "id", "left_semi")

    def packed(b: pa.RecordBatch):
        press = zstandard.ZstdCompressor(level=3)
        return [[press.compress(x) for x in text_bytes(b.column("text"))]]

    texts = materialize(add_columns(wanted, "packed binary", packed).drop("text"), "texts")
    labels = materialize(shared.select("id").union(same_id.select("id")).union(same_id.select("node")).distinct().select("id", F.col("id").alias("comp")), "labels")
    labels = merge(labels, same_id.select(F.col("id").alias("a"), F.col("node").alias("b")))

    one = led.groupBy("id").agg(F.max_by("leader", F.struct("both", "leader")).alias("leader"))
    labels = merge(labels, linked(one.select(F.col("id").alias("a"), F.col("leader").alias("b")), texts, size, percent))
    rest = led.join(one, ["id", "leader"], "left_anti").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    labels = merge(labels, linked(apart(rest, labels), texts, size, percent))
    some = marked(other_rows(shared.select("key", "id"), labels), nodes, t, percent)
    best = some.where("partner is not null").select(F.col("id").alias("a"), F.col("partner").alias("b")).distinct()
    labels = merge(labels, linked(best, texts, size, percent))
    labels = merge(labels, links_in_blocks(some, labels, nodes, texts, t, rows, size, percent))
    return sketched.select("id", "n").join(labels, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), F.coalesce(F.coalesce("comp", "id") == F.col("id"), F.lit(True)).alias("kept"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs in different components."""
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp")), c)
    return pairs.where("a_comp <> b_comp").select("a", "b")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows whose document is the first of its group, with all their columns; rows with one id are one document and stay or go together."""
    gone = components(docs, doc_id, text, **how).where("not kept").select("doc_id").distinct()
    return docs.join(gone.withColumnRenamed("doc_id", doc_id), doc_id, "left_anti").select(*docs.columns)
