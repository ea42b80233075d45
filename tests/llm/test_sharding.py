import random
import zlib

from pyspark.sql import functions as F

from lagsleuth.llm import sharding as sh


def one_by_one(sizes, shards):
    """Loads after plain LPT, one item after another."""
    load, take = [0.0] * shards, {}
    for c, s, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        for _ in range(n):
            k = min(range(shards), key=lambda i: (load[i], i))
            load[k] += s
            take[c, k] = take.get((c, k), 0) + 1
    return take


def test_schedule_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [(i, rng.randint(1, 40), rng.choice([1, 2, 9, 60, 300])) for i in range(rng.randint(0, 8))]
        shards = rng.randint(1, 9)
        got = sh.schedule(sizes, shards)
        assert {(c, s): n for c, _, s, n in got} == one_by_one(sizes, shards)
        for c, _, n in sizes:
            runs = sorted((f, k) for x, f, _, k in got if x == c)
            assert sum(k for _, k in runs) == n and [f for f, _ in runs] == [sum(k for _, k in runs[:i]) for i in range(len(runs))]


def test_table(spark):
    rng = random.Random(2)
    texts = ["é" * rng.choice([0, 1, 5, 40, 900, 7000]) + str(rng.randint(0, 50)) for _ in range(900)] + ["hot copy"] * 400 + [None, "", None]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "x", 3), (5, texts[5], 3), (5, texts[5], 3)], "doc_id long, text string, shard int")
    got = sh.shard_by_bytes(docs, 7).collect()
    assert len(got) == docs.count()
    shard_of, load, slots = {}, [0] * 7, {}
    for r in got:
        t = (texts[r.doc_id] if r.doc_id is not None else "x") or ""
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
        assert shard_of.setdefault(t, r.shard) == r.shard
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= 0.02 * sum(load) / 7 + 100, load


def test_classes(spark):
    sizes = [1, 16, 4095, 4096, 4097, 4098, 5000, 8191, 8192, 10**6, 10**6 + 300, 10**9, 10**12]
    got = [r.c for r in spark.createDataFrame([(s,) for s in sizes], "size long").select(sh.size_class(F.col("size")).alias("c"), "size").orderBy("size").collect()]
    assert got == sorted(got) and got[:4] == [1, 16, 4095, 4096] and got[-1] < 2**12 + 2**11 * 30


def test_empty(spark):
    assert sh.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
