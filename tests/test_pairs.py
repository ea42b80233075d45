"""Joins with many pairs per key: right on odd rows, and their pairs dealt over tasks."""
from pyspark.sql import functions as F

from lagsleuth.operators import ledger, validate


def parts(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def advice_rows(spark):
    s = [("a", {"x": "1"}, ["base"], ["m", "k", "m"]), ("b", {"x": "1"}, ["base", "rare"], []), ("c", {"x": "1"}, [], ["z"]), ("d", {"x": "1"}, None, ["z"]), ("e", {"x": "1"}, [None], ["z"]),
         ("f", {"x": "1"}, ["base", None, "base"], None), ("g", None, ["base"], ["z"]), ("h", {"x": "2", "y": "3"}, ["null"], ["z"]), ("a", {"x": "1"}, ["base"], ["m"]), ("i", {"x": "1"}, ["nobody"], ["z"])]
    c = [(1, {"x": "1"}, ["base", "base"]), (2, {"x": "1"}, ["rare", "base", None]), (3, {"x": "1"}, None), (4, {"x": "1"}, []), (5, {"y": "3", "x": "2"}, ["null"]), (6, {"y": "3", "x": "2"}, [None]), (1, {"x": "1"}, ["base"]), (7, None, ["base"])]
    return (spark.createDataFrame(s, "incident string, context map<string,string>, capabilities array<string>, mechanisms array<string>"),
            spark.createDataFrame(c, "ask long, context map<string,string>, capabilities array<string>"), s, c)


def test_prior_advice_odd_rows(spark):
    sums, asks, s, c = advice_rows(spark)
    want = sorted(((a, i, None if m is None else tuple(sorted(set(m)))) for i, k, need, m in s for a, k2, have in c
                   if k is not None and k == k2 and need is not None and have is not None and set(need) <= set(have)), key=repr)
    got = sorted(((r.ask, r.incident, None if r.mechanisms is None else tuple(r.mechanisms)) for r in ledger.prior_advice(sums, asks).collect()), key=repr)
    assert got == want and len(want) == 14


def test_prior_advice_pairs_in_many_tasks(spark):
    sums = spark.createDataFrame([(i, {"x": "1"}, ["base", "r"], ["m"]) for i in range(400)], "incident long, context map<string,string>, capabilities array<string>, mechanisms array<string>")
    asks = spark.createDataFrame([(i, {"x": "1"}, ["base", "r" if i < 40 else "q"]) for i in range(50)], "ask long, context map<string,string>, capabilities array<string>")
    n = parts(ledger.prior_advice(sums.coalesce(1), asks.coalesce(1)))
    assert sum(n) == 400 * 40 and n[-1] < 0.7 * sum(n)


def clocks(spark, n):
    rows = [(i, 1, 1, 0.9, 1.1, -1.0, 1.0, 0.0, 100.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, source long, target long, rate_lo double, rate_hi double, off_lo double, off_hi double, valid_lo double, valid_hi double").coalesce(1)


def test_compose_clocks_pairs_in_many_tasks(spark):
    a = clocks(spark, 300)
    n = parts(validate.compose_clocks(a, a.withColumn("valid_lo", F.lit(-5.0)).withColumn("valid_hi", F.lit(1000.0))))
    assert sum(n) == 300 * 300 and n[-1] < 0.7 * sum(n)


def test_compose_clocks_odd_rates(spark):
    rows = [(1, 1, 2, 0.5, 1.5), (2, 2, 1, None, None), (3, 2, 3, -0.5, 1.0), (4, None, 2, 1.0, 1.0), (5, 1, None, 1.0, 1.0), (6, 2, 2, 0.0, 1.0), (7, 2, 4, 2.0, None), (8, 2, 5, float("nan"), 1.0)]
    m = spark.createDataFrame(rows, "id long, source long, target long, rate_lo double, rate_hi double")
    m = m.selectExpr("*", "0.0d off_lo", "1.0d off_hi", "0.0d valid_lo", "10.0d valid_hi")
    got = {(r.first_id, r.second_id): (r.rate_lo, r.rate_hi) for r in validate.compose_clocks(m, m.withColumn("valid_lo", F.lit(-100.0)).withColumn("valid_hi", F.lit(100.0))).collect()}
    assert set(got) == {(1, 2), (1, 7), (1, 8), (4, 2), (4, 7), (4, 8)}
    assert got[1, 2] == (None, None) and got[1, 7] == (1.0, 3.0) and got[4, 8][0] == 1.0
