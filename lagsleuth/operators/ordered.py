"""Ordered scans that survive a hot key.

A plain ``Window.partitionBy(run).orderBy(time)`` puts a whole run into one task. Here each
group is cut into order segments sized from the data; only one summary row per (group, segment) is
windowed over the whole group, and every segment gets that prefix back as an extra header row.
The big rows are shuffled once, on (keys, segment), so no task holds more than one segment.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEG, ROLE = "__seg", "__role"
SKETCH, PIECES = 8192, 256


def segment_rows(spark) -> int:
    return int(spark.conf.get("lagsleuth.segmentRows", "1000000"))


def with_segment(df: DataFrame, lead: str, rows: int | None = None) -> DataFrame:
    """Add a segment number that never decreases with the numeric column ``lead``.

    Segments are cut at quantiles of ``lead`` over all rows, from a mergeable sketch, so outliers and crowded stretches do not make them uneven.
    If more than ``PIECES`` are needed, each piece between two quantiles is cut into even slices. Rows are counted first; at most PIECES numbers come to the driver."""
    at = F.col(lead).cast("double")
    n = -(-df.count() // (rows or segment_rows(df.sparkSession)))
    if n <= 1:
        return df.withColumn(SEG, F.when(at.isNull(), -1).otherwise(0).cast("long"))
    k, m = min(n, PIECES), -(-n // PIECES)
    ranks = F.lit([i / k for i in range(1, k)])
    lo, hi, cuts = df.agg(F.min(at), F.max(at), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(at, F.lit(SKETCH)), ranks)).first()
    cuts = sorted(set(cuts or []))
    piece = F.size(F.filter(F.lit(cuts), lambda c: c < at)) if cuts else F.lit(0)
    seg = piece * m
    if m > 1:
        ends = F.lit([lo, *cuts, hi])
        low, high = F.get(ends, piece), F.get(ends, piece + 1)
        seg = seg + F.when(high > low, F.least(F.floor((at - low) / (high - low) * m), F.lit(m - 1))).otherwise(0)
    return df.withColumn(SEG, F.when(at.isNull(), -1).otherwise(seg).cast("long"))


def _carry(kind: str, x: str, order: Column, wk, wall) -> tuple[Column, Column]:
    """(aggregate over one segment, the same aggregate brought in from the other segments)."""
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col(x)
    if kind == "lag":
        return F.max_by(c, order), F.lag(c).over(wk)
    if kind == "lead":
        return F.min_by(c, order), F.lead(c).over(wk)
    if kind in ("sum", "sum_before"):
        return F.sum(c), F.sum(c).over(before)
    if kind in ("max", "max_before"):
        return F.max(c), F.max(c).over(before)
    if kind in ("last", "last_before"):
        return F.max_by(c, F.when(c.isNotNull(), order)), F.last(c, ignorenulls=True).over(before)
    agg = {"total_sum": F.sum, "total_max": F.max, "total_min": F.min}[kind]
    return agg(c), agg(c).over(wall)


def _local(kind: str, x: str, w, wseg) -> Column:
    c = F.col(x)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "lag":
        return F.lag(c).over(w)
    if kind == "lead":
        return F.lead(c).over(w)
    if kind in ("sum", "max"):
        return (F.sum if kind == "sum" else F.max)(c).over(upto)
    if kind == "sum_before":
        return F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    if kind == "max_before":
        return F.max(c).over(before)
    if kind == "last":
        return F.last(c, ignorenulls=True).over(upto)
    if kind == "last_before":
        return F.last(c, ignorenulls=True).over(before)
    return F.max(F.when(F.col(ROLE) == 0, c)).over(wseg)


def scan(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None,
         **items: tuple[str, Column]) -> DataFrame:
    """Add one column per item, computed over ``keys`` in ``order`` (ascending, first column numeric).

    An item is ``name=(kind, expression)``; kinds: lag, lead, sum, sum_before, max, max_before,
    last / last_before (latest non-null), total_sum, total_max, total_min. ``rank=("sum", lit(1))`` numbers rows.
    The input is read three times (bounds, summaries, rows): pass a stored table or one that is cheap to read again.
    """
    cols = df.columns
    xs = {name: f"__x_{name}" for name in items}
    base = df.select("*", *[e.alias(xs[n]) for n, (_, e) in items.items()])
    base = with_segment(base, order[0], rows)
    at = F.struct(*order)
    wk, wall = Window.partitionBy(*keys).orderBy(SEG), Window.partitionBy(*keys)
    pair = {n: _carry(k, xs[n], at, wk, wall) for n, (k, _) in items.items()}
    seg = base.groupBy(*keys, SEG).agg(*[a.alias(xs[n]) for n, (a, _) in pair.items()])
    leads = [n for n, (k, _) in items.items() if k == "lead"]
    heads = [n for n in items if n not in leads]
    body = base.withColumn(ROLE, F.lit(1))
    for role, names in ((0, heads), (2, leads)):
        if names:
            extra = seg.select(*keys, SEG, F.lit(role).alias(ROLE), *[pair[n][1].alias(xs[n]) for n in names])
            body = body.unionByName(extra, allowMissingColumns=True)
    w = Window.partitionBy(*keys, SEG).orderBy(ROLE, *order)
    wseg = Window.partitionBy(*keys, SEG)
    out = body.select(*cols, ROLE, *[_local(k, xs[n], w, wseg).alias(n) for n, (k, _) in items.items()])
    return out.where(F.col(ROLE) == 1).select(*cols, *items)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join on ``keys``; the right side's copies are dropped."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def pair_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], pieces: int = 16) -> DataFrame:
    """Inner equi join (left column, right column; nulls never match) with many pairs per key and few keys.

    A key's left rows are dealt over ``pieces`` tasks and its right rows are copied to each; a plain join makes all pairs of a key,
    or with a small right side all pairs there are, in one task. The number of partitions is given, as tasks here are long, not large."""
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism) * 2
    row = F.pmod(F.xxhash64(*left.columns), F.lit(pieces))
    a = left.withColumn("__pl", row).repartition(n, *[l for l, _ in on], "__pl")
    b = right.withColumn("__pr", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)).cast("array<bigint>"))).repartition(n, *[r for _, r in on], "__pr")
    cond = F.col("__pl") == F.col("__pr")
    for l, r in on:
        cond = cond & (F.col(l) == F.col(r))
    return a.join(b.hint("merge"), cond).drop("__pl", "__pr")


def range_union(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Union of closed ranges per key; touching ranges merge. Bad ranges (negative, reversed) are left out
    and are listed by :func:`bad_ranges`."""
    ok = df.where((F.col(lo) >= 0) & (F.col(hi) >= F.col(lo))).select(*keys, lo, hi)
    prev = scan(ok, keys, [lo, hi], reach=("max_before", F.col(hi)))
    new = F.when(F.col("reach").isNull() | (F.col(lo) > F.col("reach")), 1).otherwise(0)
    isl = scan(prev.withColumn("__new", new), keys, [lo, hi], island=("sum", F.col("__new")))
    return isl.groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island")


def bad_ranges(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    return df.where((F.col(lo) < 0) | (F.col(hi) < F.col(lo))).select(*keys, lo, hi)
