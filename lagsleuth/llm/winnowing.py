"""Document fingerprints by winnowing.

Every run of k code points is hashed by a polynomial; in every window of w such hashes the least is chosen, the rightmost of
ties, and its place is kept. Two texts that share a run of w + k - 1 code points share a fingerprint. Texts shorter than k are
one gram; texts with fewer than w grams are one window; an empty or null text has no fingerprint.

`compare_with_next` sees the documents as a ring in ascending id order. Documents are dealt once into id ranges, and each range
also gets the first document of the next range that has any. Inside a range documents pass one at a time in order. Only one value
for each range comes to the driver. Likeness is the Jaccard index of the distinct hashes, 1 if both texts are empty. Repeated ids
follow each other in the order of a text hash; null ids come first; a single document is its own next; further columns are not
passed on; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, mix, part_count, range_bounds, slices

K, W = 24, 40
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = 22
BLOCK = 1 << 20
PART_BYTES = 64 << 20


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k codes, put together from runs of powers of two."""
    run, power, size = mix(codes.astype(np.uint64) + np.uint64(1)), BASE, 1
    out, done, left = None, 0, k
    n = len(codes) - k + 1
    while left:
        if left & 1:
            part = run[done : done + n]
            with np.errstate(over="ignore"):
                out = part.copy() if out is None else out * power + part
            done += size
        left >>= 1
        if left:
            with np.errstate(over="ignore"):
                run = run[: len(run) - size] * power + run[size:]
                power = power * power
            size *= 2
    return mix(out)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen grams, by place."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(codes, min(k, len(codes)))
    low = np.uint64((1 << PLACE_BITS) - 1)
    places = []
    for at in range(0, max(1, len(hashes) - w + 1), BLOCK):
        least = hashes[at : at + BLOCK + w - 1] & ~low
        least |= low - np.arange(len(least), dtype=np.uint64)
        span, width = 1, min(w, len(least))
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        places.append(at + (low - (least & low)).astype(np.int64))
    place = np.unique(np.concatenate(places))
    return place, hashes[place]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(place: np.ndarray, hashes: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(place.tobytes() + hashes.tobytes())


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Adds places array<long> and hashes array<long> (bits of the unsigned hashes)."""

    def fn(b: pa.RecordBatch):
        found = [winnow(t, k, w) for t in b.column(text).to_pylist()]
        return [[p for p, _ in found], [h.view(np.int64) for _, h in found]]

    return add_columns(docs, "places array<long>, hashes array<long>", fn)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the following text's first, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W, part_bytes: int = PART_BYTES) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("place"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = range_bounds(rows, "place", part_count(spark, size, part_bytes))
    parts = len(bounds) + 1

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), "right").astype(np.int32))

    heads = sorted((r.p, r.place) for r in rows.select("place", part_of("place").alias("p")).groupBy("p").agg(F.min("place").alias("place")).collect())
    first = np.array([h for _, h in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)

    @F.pandas_udf("array<int>")
    def targets(place: pd.Series) -> pd.Series:
        """The own range, and for the first document of a range also the range before, as -1 - range."""
        v = place.to_numpy(np.int64)
        own = np.searchsorted(bounds, v, "right")
        at = np.minimum(np.searchsorted(first, v), len(first) - 1)
        return pd.Series([[o, -1 - before[i]] if h else [o] for o, i, h in zip(own, at, first[at] == v, strict=True)])

    dealt = rows.select(F.explode(targets("place")).alias("t"), "place", "doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = dealt.select(F.expr("if(t < 0, -1 - t, t)").alias("p"), (F.col("t") < 0).alias("look"), "place", "doc_id", "text", "h")
    dealt = dealt.repartitionById(parts, "p").sortWithinPartitions("look", "place", "h").select("look", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_prints"]

    def run(batches):
        held = None
        for whole in batches:
            for b in slices(whole):
                out = []
                for look, i, t in zip(*(b.column(c).to_pylist() for c in ("look", "doc_id", "text")), strict=True):
                    if look and held is None:
                        continue
                    place, hashes = winnow(t, k, w)
                    kept = np.unique(hashes)
                    if held is not None:
                        was_id, was, was_print, was_kept = held
                        new = edited(was, t)
                        new_place, new_hashes = winnow(new, k, w)
                        out.append((was_id, len(was), hashlib.sha256(new.encode()).hexdigest(), was_print, digest(new_place, new_hashes),
                                    likeness(was_kept, np.unique(new_hashes)), likeness(was_kept, kept), len(was_kept)))
                    held = None if look else (i, t, digest(place, hashes), kept)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if any(r[0] is not None for r in out) else
                                                     [pa.array([None] * len(out), pa.int64())] + [pa.array(c) for c in list(zip(*out, strict=True))[1:]], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_prints long")
