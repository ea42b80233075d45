"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here the values are counted, counts are
summed into order-preserving logarithmic buckets, and only the buckets that hold a wanted rank are ranked.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import join_on

BUCKETS_PER_E = 256.0
BUCKET_SHIFT = 200000


def order_bucket(v: Column) -> Column:
    """Integer that never decreases with v; within a bucket values differ by at most 0.4 %."""
    b = F.floor(F.ln(F.abs(v)) * BUCKETS_PER_E) + BUCKET_SHIFT
    return F.when(v > 0, b).when(v < 0, -b).otherwise(F.lit(0)).cast("long")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c): how often each value occurs; combines on the map side."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))


def counted_quantiles(counts: DataFrame, keys: list[str], specs: dict[str, tuple[float, str]]) -> DataFrame:
    """Quantiles from (keys, v, c). ``specs``: name -> (p, "linear" | "nearest" | "lower" |
    "upper" | "conformal"); lower and upper are the two values linear interpolates between, conformal is the
    ceil((n+1)p)-th value and null beyond the last. Adds the row count ``n``."""
    counts = counts.withColumn("b", order_bucket(F.col("v")))
    wk = Window.partitionBy(*keys).orderBy("b")
    hist = (counts.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
            .select(*keys, "b", "bc",
                    F.coalesce(F.sum("bc").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"),
                    F.sum("bc").over(Window.partitionBy(*keys)).alias("n")))

    def ranks(p: float, kind: str) -> tuple[Column, Column]:
        if kind == "nearest":
            r = F.greatest(F.ceil(F.col("n") * F.lit(p)) - 1, F.lit(0))
            return r, r
        if kind == "conformal":
            r = F.ceil((F.col("n") + 1) * F.lit(p)) - 1
            return r, r
        lo, hi = F.floor((F.col("n") - 1) * F.lit(p)), F.ceil((F.col("n") - 1) * F.lit(p))
        return {"linear": (lo, hi), "lower": (lo, lo), "upper": (hi, hi)}[kind]

    hit = None
    for p, kind in specs.values():
        for r in ranks(p, kind):
            c = (r >= F.col("b0")) & (r < F.col("b0") + F.col("bc"))
            hit = c if hit is None else hit | c
    wanted = hist.where(hit).drop("bc")
    w = Window.partitionBy(*keys, "b").orderBy("v")
    ranked = (join_on(counts, wanted, [*keys, "b"])
              .withColumn("end", F.col("b0") + F.sum("c").over(w)))
    aggs = [F.max("n").alias("n")]
    for name, (p, kind) in specs.items():
        for tag, r in zip(("lo", "hi"), ranks(p, kind)):
            at = (r < F.col("end")) & (r >= F.col("end") - F.col("c"))
            aggs.append(F.max(F.when(at, F.col("v"))).alias(f"__{name}_{tag}"))
    got = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for name, (p, kind) in specs.items():
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        pos = (F.col("n") - 1) * F.lit(p)
        cols.append((lo if kind != "linear" else lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, "n", *cols)


def quantiles(df: DataFrame, keys: list[str], value: str, specs: dict[str, tuple[float, str]]) -> DataFrame:
    return counted_quantiles(value_counts(df, keys, value), keys, specs)


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and median absolute deviation: (keys, n, med, mad)."""
    return counted_median_mad(value_counts(df, keys, value), keys)


def recount(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser keys for value counts."""
    return counts.groupBy(*keys, "v").agg(F.sum("c").alias("c"))


def counted_median_mad(counts: DataFrame, keys: list[str]) -> DataFrame:
    med = counted_quantiles(counts, keys, {"med": (0.5, "linear")})
    dev = (join_on(counts, med, keys)
           .groupBy(*keys, F.abs(F.col("v") - F.col("med")).alias("v")).agg(F.sum("c").alias("c")))
    mad = counted_quantiles(dev, keys, {"mad": (0.5, "linear")}).drop("n")
    return join_on(med, mad, keys)


def latency_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, p50, mad, p95, p99 (linear interpolation) and the two tail spreads."""
    counts = value_counts(df, keys, value)
    q = counted_quantiles(counts, keys, {"p50": (0.5, "linear"), "p95": (0.95, "linear"), "p99": (0.99, "linear")})
    dev = (join_on(counts, q.select(*keys, "p50"), keys)
           .groupBy(*keys, F.abs(F.col("v") - F.col("p50")).alias("v")).agg(F.sum("c").alias("c")))
    mad = counted_quantiles(dev, keys, {"mad": (0.5, "linear")}).drop("n")
    return join_on(q, mad, keys).select(
        *keys, "n", "p50", "mad", "p95", "p99",
        (F.col("p95") - F.col("p50")).alias("tail95"), (F.col("p99") - F.col("p50")).alias("tail99"))


def p99_nearest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, {"p99": (0.99, "nearest")})


def log_sketch(df: DataFrame, keys: list[str], value: str, accuracy: float = 0.01, bins: int = 512) -> DataFrame:
    """Mergeable relative-error sketch as rows (keys, bucket, c, lo); bucket null counts zeros.

    Buckets more than ``bins`` below the highest are folded into the lowest kept one (``collapsed``)."""
    gamma = (1 + accuracy) / (1 - accuracy)
    v = F.col(value)
    bucket = F.when(v > 0, F.ceil(F.ln(v) / F.lit(math.log(gamma))).cast("long"))
    raw = (df.where(v >= 0).groupBy(*keys, bucket.alias("bucket"))
           .agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo")))
    return collapse(raw, keys, bins)


def collapse(sketch: DataFrame, keys: list[str], bins: int = 512) -> DataFrame:
    """Fold low buckets; also the merge step for a union of sketches (same accuracy)."""
    floor = F.max("bucket").over(Window.partitionBy(*keys)) - (bins - 1)
    kept = F.when(F.col("bucket").isNotNull(), F.greatest(F.col("bucket"), floor))
    moved = F.col("bucket") < floor
    s = sketch.withColumn("__m", moved).withColumn("__k", kept)
    return (s.groupBy(*keys, F.col("__k").alias("bucket"))
            .agg(F.sum("c").alias("c"), F.min("lo").alias("lo"),
                 F.coalesce(F.max("__m"), F.lit(False)).alias("collapsed")))


def sketch_quantile(sketch: DataFrame, keys: list[str], q: float, accuracy: float = 0.01) -> DataFrame:
    """Bounds of the q-quantile: value/(1+a) .. value/(1-a), or [minimum, bound/(1-a)] in a collapsed bucket."""
    gamma = (1 + accuracy) / (1 - accuracy)
    wk = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    cum = sketch.select(*keys, "bucket", "collapsed",
                        F.sum("c").over(wk).alias("cum"),
                        F.sum("c").over(Window.partitionBy(*keys)).alias("n"),
                        F.min("lo").over(Window.partitionBy(*keys)).alias("minimum"))
    hit = cum.where(F.col("cum") > F.lit(q) * (F.col("n") - 1))
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("bucket", "collapsed", "n", "minimum"), "cum").alias("s"))
    value = F.exp(F.col("s.bucket") * F.lit(math.log(gamma))) * F.lit(2 / (1 + gamma))
    zero = F.col("s.bucket").isNull()
    return first.select(
        *keys, F.col("s.n").alias("n"),
        F.when(zero, 0.0).when(F.col("s.collapsed"), F.col("s.minimum")).otherwise(value / (1 + accuracy)).alias("lower"),
        F.when(zero, 0.0).otherwise(value / (1 - accuracy)).alias("upper"),
        (~zero & F.col("s.collapsed")).alias("collapsed"))
