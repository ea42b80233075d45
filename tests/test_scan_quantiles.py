"""The two scale primitives against brute force, with one key holding a third of the rows and tiny segments."""
import random

import numpy as np
from pyspark.sql import functions as F

from lagsleuth.operators import ordered as O, quantiles as Q


def rows(n=600, seed=1):
    r = random.Random(seed)
    return [(("hot" if r.random() < 0.34 else f"k{r.randrange(6)}"), r.randrange(0, 300), i, r.choice([None, r.randrange(50)])) for i in range(n)]


def test_scan_matches_plain_windows(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, id long, v long")
    got = O.scan(df, ["k"], ["t", "id"], rows=40, lag=("lag", F.col("v")), lead=("lead", F.col("id")), s=("sum", F.col("v")), sb=("sum_before", F.lit(1)), mb=("max_before", F.col("v")),
                 m=("max", F.col("v")), lb=("last_before", F.col("v")), la=("last", F.col("v")), ts=("total_sum", F.lit(1)), tm=("total_max", F.col("v")), tn=("total_min", F.col("v"))).collect()
    assert O.with_segment(df, "t", 40).select(O.SEG).distinct().count() > 5
    by = {}
    for k, t, i, v in sorted(data, key=lambda x: (x[0], x[1], x[2])):
        by.setdefault(k, []).append((t, i, v))
    for r in got:
        g = by[r.k]
        p = [x[1] for x in g].index(r.id)
        before = [x[2] for x in g[:p] if x[2] is not None]
        upto = before + ([g[p][2]] if g[p][2] is not None else [])
        every = [x[2] for x in g if x[2] is not None]
        assert r.lag == (g[p - 1][2] if p else None)
        assert r.lead == (g[p + 1][1] if p + 1 < len(g) else None)
        assert r.s == (sum(upto) if upto else None)
        assert r.sb == p and r.ts == len(g)
        assert r.mb == (max(before) if before else None) and r.m == (max(upto) if upto else None)
        assert r.lb == (before[-1] if before else None) and r.la == (upto[-1] if upto else None)
        assert r.tm == (max(every) if every else None) and r.tn == (min(every) if every else None)
    assert len(got) == len(data)


def test_exact_quantiles_match_numpy(spark):
    r = random.Random(3)
    vals = [(k, r.choice([0.0, -1.5, r.gauss(0, 1e3), r.lognormvariate(0, 5)])) for k in ["hot"] * 300 + ["a"] * 31 + ["b"] * 2 + ["c"]]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {x.k: x for x in Q.latency_stats(df, ["k"], "v").collect()}
    mm = {x.k: x for x in Q.median_mad(df, ["k"], "v").collect()}
    near = {x.k: x.p99 for x in Q.p99_nearest(df, ["k"], "v").collect()}
    for k in got:
        v = np.array(sorted(x for kk, x in vals if kk == k))
        assert np.isclose(got[k].p50, np.median(v)) and np.isclose(got[k].p95, np.percentile(v, 95)) and np.isclose(got[k].p99, np.percentile(v, 99))
        assert np.isclose(mm[k].mad, np.median(np.abs(v - np.median(v))))
        assert near[k] == v[max(0, int(np.ceil(0.99 * len(v))) - 1)]


def test_range_union_touching_merges(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 8, 12), ("b", 0, 10), ("b", 11, 20), ("c", 0, 5), ("c", 5, 9), ("d", -1, 3), ("d", 9, 2)], "k string, lo long, hi long")
    assert sorted(map(tuple, O.range_union(df, ["k"], "lo", "hi").collect())) == [("a", 0, 12), ("b", 0, 10), ("b", 11, 20), ("c", 0, 9)]
    assert O.bad_ranges(df, ["k"], "lo", "hi").count() == 2


def test_sketch_bounds_hold_and_merge(spark):
    r = random.Random(5)
    vals = [(i % 2, r.lognormvariate(0, 2)) for i in range(400)]
    df = spark.createDataFrame(vals, "half int, v double")
    whole = Q.log_sketch(df, [], "v")
    merged = Q.collapse(Q.log_sketch(df, ["half"], "v").drop("half"), [])
    assert sorted((x.bucket, x.c) for x in whole.collect()) == sorted((x.bucket, x.c) for x in merged.collect())
    s = sorted(v for _, v in vals)
    q = Q.sketch_quantile(whole, [], 0.9).first()
    assert q.lower <= s[int(0.9 * 399)] * 1.0001 and q.upper >= s[int(0.9 * 399)] * 0.9999


def test_segments_are_even_whatever_the_values(spark):
    """A far outlier, a large offset, a crowded stretch: no segment holds more than twice the target, and order is kept."""
    r = random.Random(9)
    n = 4000
    shapes = {"outlier": [float(i) for i in range(n - 1)] + [1e18], "offset": [1.7e18 + 1000.0 * i for i in range(n)],
              "crowded": [r.random() * 1e-9 for _ in range(n // 2)] + [r.random() * 1e9 for _ in range(n // 2)], "few": [1.0, 2.0, None]}
    for name, values in shapes.items():
        df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
        seg = O.with_segment(df, "v", 100).groupBy(O.SEG).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
        assert max(x.n for x in seg) <= 200, name
        known = [x for x in seg if x.lo is not None]
        assert all(a.hi < b.lo and a[O.SEG] < b[O.SEG] for a, b in zip(known, known[1:])), name
        assert name == "few" or len(seg) >= 30
        many = O.with_segment(df, "v", 5).groupBy(O.SEG).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null").orderBy("lo").collect()
        assert all(a.hi < b.lo and a[O.SEG] < b[O.SEG] for a, b in zip(many, many[1:])), name


def test_scan_with_an_outlier_equals_plain(spark):
    df = spark.createDataFrame([("k", float(i % 700) if i else 1e17, i) for i in range(1500)], "k string, t double, id long")
    got = O.scan(df, ["k"], ["t", "id"], rows=50, pos=("sum", F.lit(1)), nxt=("lead", F.col("id"))).orderBy("t", "id").collect()
    ids = [x[1] for x in sorted((r.t, r.id) for r in got)]
    assert [r.pos for r in got] == list(range(1, 1501)) and [r.nxt for r in got] == ids[1:] + [None]
