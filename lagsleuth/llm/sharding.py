"""Longest-processing-time sharding of documents by bytes.

Documents with equal texts form a group and stay together. Groups, largest first, go to the least loaded shard through a heap
(ties: the lower shard). Groups of one size are alike, so the heap is fed with sizes and counts, not with groups: sizes up to
2**12 one by one, larger ones in classes of 1/2**11 relative width with their mean as the size. Their number is bounded, whatever
the input (2**12, and 2**11 for each doubling above), and so is what the driver holds. Within a class groups are numbered in the order of
a hash of their text, and each shard takes a run of numbers. A group larger than an even share makes its shard that much fuller.

Numbers are made in two steps, counts of (class, slice) and places inside a slice, so no class and no shard is sorted in one task.

Cases: a null text counts as an empty one (one group with empty texts); repeated rows and ids are members like all others; shards
may stay empty; further columns are not passed on; an empty table gives an empty result.
"""
from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import part_count, utf8_size

ROW_BYTES = 16
EXACT = 12
FINE = 11
RANK_ROWS = 500_000


def size_class(size) -> F.Column:
    """The size itself up to 2**EXACT, then a number that grows by 2**FINE with each doubling."""
    power = F.floor(F.log2(size.cast("double"))).cast("int")
    return F.when(size < 2**EXACT, size).otherwise(F.lit(2**EXACT) + (power - EXACT) * 2**FINE + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 2**FINE)).cast("long")


def schedule(sizes: list[tuple[int, float, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, size, count) -> runs (class, first number, shard, count): each item to the least loaded shard, largest first.

    Of a large count, as many as surely go below a common level are placed at once; the heap places the rest one by one.
    """
    load = np.zeros(shards)
    out = []
    for cls, size, count in sorted(sizes, key=lambda x: (-x[1], x[0])):
        take = np.zeros(shards, np.int64)
        if count > 2 * shards and size > 0:
            low, high = load.min(), load.max() + size * count
            for _ in range(200):
                level = (low + high) / 2
                if np.maximum(0, np.floor((level - load) / size)).sum() <= count - shards:
                    low = level
                else:
                    high = level
            take = np.maximum(0, np.floor((low - load) / size)).astype(np.int64)
        heap = [(load[s] + size * take[s], s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(count - int(take.sum())):
            full, s = heap[0]
            take[s] += 1
            heapq.heapreplace(heap, (full + size, s))
        load += size * take
        first = 0
        for s in np.flatnonzero(take):
            out.append((cls, first, int(s), int(take[s])))
            first += int(take[s])
    return out


def numbered(df: DataFrame, group: list[str], order: list[str], slices: int, name: str) -> DataFrame:
    """Adds the place, from 0, of each row within its group: by slice (a hash of `order`), then by `order`."""
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = cut.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = counts.select(*group, "_slice", F.expr(f"sum(_n) over (partition by {', '.join(group)} order by _slice) - _n").alias("_before"))
    inside = cut.withColumn("_in", F.expr(f"row_number() over (partition by {', '.join(group)}, _slice order by {', '.join(order)}) - 1"))
    return inside.join(before, [*group, "_slice"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_slice", "_in", "_before")


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (from 0 in each shard, without gaps), grown_shard (null for this law)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), (utf8_size(body) + row_bytes).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                                   F.unhex(F.sha2(body, 256)).alias("group")), "sizes")
    slices = part_count(spark, rows.count() * 64, RANK_ROWS * 64)
    groups = rows.groupBy("group").agg(F.sum("size").alias("size")).withColumn("class", size_class(F.col("size")))
    groups = materialize(groups, "groups")
    sizes = [(r["class"], r.size_sum / r.n, r.n) for r in groups.groupBy("class").agg(F.sum("size").alias("size_sum"), F.count("*").alias("n")).collect()]
    runs = spark.createDataFrame(schedule(sizes, shards), "class long, first long, shard int, count long")
    runs = runs.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    placed = numbered(groups, ["class"], ["group"], slices, "number").join(runs, "class")
    placed = placed.select("group", F.expr("element_at(filter(runs, r -> r.first <= number), -1).shard").alias("shard"))
    out = numbered(rows.join(placed, "group").withColumn("h", F.xxhash64("doc_id", "group")), ["shard"], ["h", "doc_id", "group"], slices, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
