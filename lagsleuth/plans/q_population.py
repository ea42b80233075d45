"""Request population queries over orders and lineitem."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import population as P, quantiles as Q
from ..operators.storage import materialize
from .registry import query
from .views import DAY_NS, POPULATION, REQUESTS, population, requests, table

def r6(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


ORDER = ["start_ns", "request_id", "total_ns", "price"]
O_SQL = "start_ns, request_id, total_ns, price"
MISSED = """CASE WHEN finish_ns IS NOT NULL AND deadline_ns IS NOT NULL AND status = 'ok' THEN finish_ns > deadline_ns
  WHEN finish_ns IS NOT NULL AND deadline_ns IS NOT NULL AND finish_ns >= deadline_ns AND status IN ('timeout', 'censored', 'not_submitted') THEN true END"""
POP = f"""{REQUESTS}, m AS (SELECT *, {MISSED} AS missed FROM requests),
pop AS (SELECT arm, block, priority, count(*) AS eligible, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'timeout') AS timeout,
 count(*) FILTER (status = 'error') AS error, count(*) FILTER (missed) AS missed, count(*) FILTER (NOT missed) AS on_time,
 count(*) FILTER (missed IS NULL) AS unknown_deadline, count(DISTINCT delivery_id) AS logical_deliveries, least(1.0, 16.0 / count(*))::DOUBLE AS inclusion_probability
 FROM m GROUP BY arm, block, priority)"""


def pop(spark, d):
    return P.population(requests(spark, d), ["arm", "block", "priority"])


@query("A7", "population", f"WITH {POP} SELECT * REPLACE (round(inclusion_probability, 6) AS inclusion_probability) FROM pop")
def _(spark, d):
    return r6(pop(spark, d), "inclusion_probability")


@query("A8", "threshold_exceedance", f"""WITH {REQUESTS} SELECT arm, block, count(*) FILTER (status <> 'ok') AS censored,
 {', '.join(f"count(*) FILTER (status = 'ok' AND total > {t}) AS over_{t}" for t in (1, 10, 30, 45))} FROM requests GROUP BY ALL""")
def _(spark, d):
    return P.threshold_exceedance(requests(spark, d), ["arm", "block"], F.col("total_ns") / DAY_NS, (1, 10, 30, 45))


RUNS = f"""{REQUESTS}, m AS (SELECT *, coalesce({MISSED}, false) AS hit FROM requests),
g AS (SELECT arm, block, hit, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY arm, block ORDER BY {O_SQL}) AS grp,
 sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY arm, block) AS br FROM m),
r AS (SELECT arm, block, grp, max(br) AS br, count(*) FILTER (hit) AS len, count(*) AS n FROM g GROUP BY ALL),
runs AS (SELECT arm, block, max(len) AS max_run, coalesce(max(CASE WHEN grp = 0 THEN len END), 0) AS prefix, coalesce(max(CASE WHEN grp = br THEN len END), 0) AS suffix,
 sum(n)::BIGINT AS eligible, max(br) = 0 AS all_missed FROM r GROUP BY ALL)"""


def stored_requests(spark, d):
    """The joined requests once, for scans that read their input several times."""
    return materialize(requests(spark, d).select("arm", "block", *ORDER, "status", "finish_ns", "deadline_ns", "clock_domain"), "requests")


def runs(spark, d):
    return P.miss_runs(stored_requests(spark, d), ["arm", "block"], ORDER)


@query("W5", "miss_runs", f"WITH {RUNS} SELECT * FROM runs")
def _(spark, d):
    return runs(spark, d)


DROUGHT = f"""d1 AS (SELECT *, max(finish_ns) OVER (PARTITION BY arm, block ORDER BY {O_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unused,
 last_value(finish_ns IGNORE NULLS) OVER (PARTITION BY arm, block ORDER BY {O_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_any FROM requests),
d2 AS (SELECT *, lag(finish_ns) OVER (PARTITION BY arm, block ORDER BY {O_SQL}) AS last_done, first_value(clock_domain) OVER (PARTITION BY arm, block ORDER BY {O_SQL}) AS fc
 FROM d1 WHERE status = 'ok'),
d3 AS (SELECT arm, block, greatest(0, max(finish_ns - last_done)) AS max_gap, arg_min(finish_ns, ({O_SQL})) AS first_finish, arg_max(finish_ns, ({O_SQL})) AS last_finish,
 max(fc) AS clock, count(*) FILTER (clock_domain <> fc) AS wrong FROM d2 GROUP BY ALL),
d4 AS (SELECT arm, block, count(*) FILTER (finish_ns < last_any) AS back FROM d1 GROUP BY ALL),
dr AS (SELECT arm, block, coalesce(max_gap, 0) AS max_gap, back + coalesce(wrong, 0) = 0 AS ordered, first_finish, last_finish, clock FROM d4 LEFT JOIN d3 USING (arm, block))"""


@query("W6", "drought", f"WITH {REQUESTS}, {DROUGHT} SELECT * FROM dr")
def _(spark, d):
    return P.drought(stored_requests(spark, d), ["arm", "block"], ORDER)


# The check recomputes runs from all rows of an arm, not from the block summaries.
@query("A12", "merge_blocks", f"""WITH {REQUESTS}, m AS (SELECT *, coalesce({MISSED}, false) AS hit FROM requests),
g AS (SELECT arm, hit, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY arm ORDER BY {O_SQL}) AS grp,
 sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY arm) AS br FROM m),
r AS (SELECT arm, grp, max(br) AS br, count(*) FILTER (hit) AS len FROM g GROUP BY ALL),
w AS (SELECT arm, max(len) AS max_run, coalesce(max(CASE WHEN grp = 0 THEN len END), 0) AS prefix, coalesce(max(CASE WHEN grp = br THEN len END), 0) AS suffix,
 max(br) = 0 AS all_missed FROM r GROUP BY ALL), {DROUGHT},
s AS (SELECT *, lag(last_finish) OVER (PARTITION BY arm ORDER BY block) AS lf, first_value(clock) OVER (PARTITION BY arm ORDER BY block) AS c0 FROM dr),
x AS (SELECT arm, greatest(max(max_gap), coalesce(max(CASE WHEN clock = c0 AND first_finish >= lf THEN first_finish - lf END), 0)) AS max_gap,
 bool_and(ordered AND (lf IS NULL OR (clock = c0 AND first_finish >= lf))) AS ordered FROM s GROUP BY arm),
t AS (SELECT arm, {', '.join(f"count(*) FILTER (status = 'ok' AND total > {t}) AS over_{t}" for t in (1, 10, 30))} FROM requests GROUP BY arm)
SELECT * FROM w JOIN x USING (arm) JOIN t USING (arm)""")
def _(spark, d):
    k = ["arm", "block"]
    req = stored_requests(spark, d)
    s = (P.miss_runs(req, k, ORDER).join(P.drought(req, k, ORDER), k)
         .join(P.threshold_exceedance(req, k, F.col("total_ns") / DAY_NS, (1, 10, 30)), k)
         .withColumn("ord", F.regexp_replace("block", "-", "").cast("long")))
    return P.merge_blocks(s, ["arm"], "ord", ["over_1", "over_10", "over_30"])


RB = f"""{POP}, rb AS (SELECT priority, arm, sum(eligible)::BIGINT AS eligible, sum(missed)::BIGINT AS missed, sum(unknown_deadline)::BIGINT AS unknown_deadline FROM pop GROUP BY ALL),
rr AS (SELECT *, missed / eligible AS rate_lo, (missed + unknown_deadline) / eligible AS rate_hi FROM rb)"""


@query("A11", "rate_bounds", f"WITH {RB} SELECT * REPLACE (round(rate_lo, 6) AS rate_lo, round(rate_hi, 6) AS rate_hi) FROM rr")
def _(spark, d):
    return r6(P.rate_bounds(pop(spark, d), ["priority", "arm"]), "rate_lo", "rate_hi")


@query("A11", "rate_change", f"""WITH {RB}, s AS (SELECT priority, count(DISTINCT CASE WHEN priority = '5-LOW' THEN left(block, 2) ELSE 'x' END) = 1 AND count(DISTINCT arm) = 2 AS supported FROM pop GROUP BY ALL),
p AS (SELECT priority, max(rate_lo) FILTER (arm = 'reference') AS rl, max(rate_hi) FILTER (arm = 'reference') AS rh, max(rate_lo) FILTER (arm = 'current') AS cl,
 max(rate_hi) FILTER (arm = 'current') AS ch FROM rr GROUP BY ALL)
SELECT priority, supported, CASE WHEN supported THEN round(cl - rh, 6) END AS change_lo, CASE WHEN supported THEN round(ch - rl, 6) END AS change_hi FROM p JOIN s USING (priority)""")
def _(spark, d):
    p = pop(spark, d).withColumn("ctx", F.when(F.col("priority") == "5-LOW", F.substring("block", 1, 2)).otherwise("x"))
    return r6(P.rate_change(p, ["priority"], ["ctx"]), "change_lo", "change_hi")


def long_sql(fields, keys):
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS field, {f}::DOUBLE AS value FROM requests WHERE status = 'ok'" for f in fields) + \
        f" UNION ALL SELECT {keys}, 'attempt_total', total FROM requests"


PS = f"""{REQUESTS}, lng AS ({long_sql(('total', 'server', 'cuda', 'price'), 'arm, priority')}),
q AS (SELECT arm, priority, field, count(*) AS n, median(value) AS p50, quantile_cont(value, .95) AS p95, quantile_cont(value, .99) AS p99 FROM lng GROUP BY ALL),
st AS (SELECT arm, priority, field, n, p50, median(abs(value - p50)) AS mad, p95, p99, p95 - p50 AS tail95, p99 - p50 AS tail99
 FROM lng JOIN q USING (arm, priority, field) GROUP BY ALL)"""


def phases(spark, d):
    return P.phase_summary(requests(spark, d), ["arm", "priority"], ["total", "server", "cuda", "price"], "total")


@query("A5", "phase_summary", f"""WITH {PS}, c AS (SELECT arm, priority, count(*) AS requests, count(*) FILTER (status = 'ok') AS completed, count(*) FILTER (status <> 'ok') AS errors FROM requests GROUP BY ALL)
SELECT arm, priority, field, n, requests, completed, errors, {', '.join(f'round({c}, 4) AS {c}' for c in P.STATS)} FROM st JOIN c USING (arm, priority)""")
def _(spark, d):
    c, s = phases(spark, d)
    return r6(s.join(c, ["arm", "priority"]), *P.STATS, digits=4)


@query("A6", "phase_delta", f"""WITH {PS}, u AS (UNPIVOT (SELECT * EXCLUDE n FROM st) ON p50, mad, p95, p99, tail95, tail99 INTO NAME metric VALUE value)
SELECT a.priority, a.field, a.metric, round(a.value - b.value, 4) AS delta FROM u a JOIN u b USING (priority, field, metric) WHERE a.arm = 'current' AND b.arm = 'reference'""")
def _(spark, d):
    _, s = phases(spark, d)
    s = s.drop("n")
    return r6(P.phase_delta(s.where("arm = 'current'").drop("arm"), s.where("arm = 'reference'").drop("arm"), ["priority"]), "delta", digits=4)


@query("P5", "check_run_config", """WITH r AS (SELECT l_suppkey, l_linestatus, max(l_quantity) AS request_bytes, count(*) % 3 AS response_bytes, max(l_tax) AS timeout_s FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey, a.request_bytes, a.response_bytes, a.timeout_s, concat_ws(',', CASE WHEN a.request_bytes <> b.request_bytes THEN 'request_bytes' END,
 CASE WHEN a.response_bytes <> b.response_bytes THEN 'response_bytes' END, CASE WHEN a.timeout_s <> b.timeout_s THEN 'timeout_s' END) AS mismatch
FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'""")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(
        F.max("l_quantity").alias("request_bytes"), (F.count(F.lit(1)) % 3).alias("response_bytes"), F.max("l_tax").alias("timeout_s"))
    return P.check_run_config(r.where("l_linestatus = 'O'").drop("l_linestatus"), r.where("l_linestatus = 'F'").drop("l_linestatus"),
                              ["l_suppkey"], ["request_bytes", "response_bytes", "timeout_s"])


@query("A15", "case_headlines", f"""WITH {REQUESTS}, m AS (SELECT *, priority AS "case", {MISSED} AS missed FROM requests),
c AS (SELECT "case", arm, count(*) AS requests, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (missed) AS misses, count(*) FILTER (missed IS NULL) AS unknown,
 {', '.join(f"round(quantile_cont({f}, {q}) FILTER (status = 'ok'), 6) AS {f}_{n}" for f in ('total', 'server', 'cuda') for n, q in (('p50', .5), ('p95', .95)))} FROM m GROUP BY ALL),
b AS (SELECT "case", max(total_p95) FILTER (arm = 'reference') AS h, max(total_p95) FILTER (arm = 'current') AS i FROM c GROUP BY ALL)
SELECT c.*, coalesce(i - h > greatest(20, .2 * h) AND h <> 0, false) AS tail_shift FROM c JOIN b USING ("case")""")
def _(spark, d):
    r = requests(spark, d).withColumn("case", F.col("priority"))
    return r6(P.case_headlines(r), *[f"{f}_{q}" for f in ("total", "server", "cuda") for q in ("p50", "p95")])


@query("A16", "regression_blocks", f"""WITH {POP}, h AS (SELECT priority, sum(missed + unknown_deadline) / sum(eligible) AS hi FROM pop WHERE arm = 'reference' GROUP BY ALL)
SELECT priority AS "case", count(*) FILTER (arm = 'current') AS incidents, count(*) FILTER (arm <> 'current') AS controls,
 count(*) FILTER (arm = 'current' AND missed / eligible - hi > -.1) AS clear FROM pop LEFT JOIN h USING (priority) GROUP BY ALL""")
def _(spark, d):
    return P.regression_blocks(pop(spark, d).withColumnRenamed("priority", "case"), -0.1)


@query("A19", "timing_verdict", f"""WITH {REQUESTS}, q AS (SELECT arm, priority, quantile_cont(price, .5) AS p50, quantile_cont(price, .95) AS p95, quantile_cont(price, .99) AS p99 FROM requests GROUP BY ALL)
SELECT a.priority, round(b.p50 / a.p50 - 1, 6) AS median_change, round(b.p95 / a.p95 - 1, 6) AS p95_change, round(b.p99 / a.p99 - 1, 6) AS p99_change,
 abs(b.p50 / a.p50 - 1) <= .05 AND abs(b.p95 / a.p95 - 1) <= .1 AS pass FROM q a JOIN q b ON a.priority = b.priority AND a.arm = 'reference' AND b.arm = 'current'""")
def _(spark, d):
    r = requests(spark, d)
    return r6(P.timing_verdict(r.where("arm = 'reference'"), r.where("arm = 'current'"), ["priority"], "price"), "median_change", "p95_change", "p99_change")


@query("J8", "compare_outputs", """WITH c AS (SELECT conv_id, turn, md5(text) AS h, length(text)::DOUBLE AS m, role FROM conversations)
SELECT count(*) AS frames, count(*) FILTER (a.h = b.h) AS identical, count(*) FILTER (a.h <> b.h) AS diverged, max(abs(a.m - b.m)) AS max_mean_diff
FROM c a JOIN (SELECT conv_id + 1 AS conv_id, turn, h, m FROM c) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("frame"), F.concat_ws("-", F.col("conv_id") + 1, "turn").alias("next"),
                                                F.md5("text").alias("h"), F.length("text").cast("double").alias("m"))
    return P.compare_outputs(c, c.select(F.col("next").alias("frame"), "h", "m"), "frame", "h", "m")


@query("A20", "overhead_summary", """WITH d AS (SELECT l_returnflag AS name, l_linenumber AS rate, avg(l_extendedprice) FILTER (l_linestatus = 'O') - avg(l_extendedprice) FILTER (l_linestatus = 'F') AS m,
 stddev_pop(l_extendedprice) FILTER (l_linestatus = 'O') - stddev_pop(l_extendedprice) FILTER (l_linestatus = 'F') AS j FROM lineitem GROUP BY ALL)
SELECT name, rate, round(m, 4) AS d_mean, round(j, 4) AS d_jitter, (SELECT arg_min(rate, m) FROM d x WHERE x.name = d.name AND x.rate * 20 >= 60) AS best_rate FROM d""")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("rate"),
                                           (F.col("l_linestatus") == "O").alias("collector_on"), F.col("l_extendedprice").alias("value"))
    t, best = P.overhead_summary(s, 20, 60)
    return r6(t.join(best, "name", "left"), "d_mean", "d_jitter", digits=4)


@query("A21", "operations_summary", """WITH l AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'skipped' END AS outcome,
 epoch_us(o_orderdate) AS ended, o_orderkey AS seq, o_totalprice, o_orderpriority FROM orders)
SELECT id, count(*) AS attempts, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failure') AS failures, round(sum(o_totalprice), 2) AS elapsed,
 max(ended) FILTER (outcome = 'failure') AS last_failure, arg_max(o_orderpriority, (ended, seq)) FILTER (outcome = 'failure') AS last_reason FROM l GROUP BY id""")
def _(spark, d):
    from .views import micros
    o = table(spark, d, "orders").selectExpr("o_custkey id", "case o_orderstatus when 'F' then 'success' when 'O' then 'failure' else 'skipped' end outcome",
                                             f"{micros('o_orderdate')} ended_at", "o_orderkey seq", "o_totalprice elapsed", "o_orderpriority reason")
    return r6(P.operations_summary(o), "elapsed", digits=2)


@query("T3", "sample_blocks", f"""WITH {REQUESTS}, q AS (SELECT arm, block, md5('7|' || request_id) AS h, count(*) OVER (PARTITION BY arm, block) AS n,
 row_number() OVER (PARTITION BY arm, block ORDER BY md5('7|' || request_id)) AS rn FROM requests)
SELECT arm, block, h, round(least(1.0, 16.0 / n), 6)::DOUBLE AS inclusion_probability FROM q WHERE rn <= 16""")
def _(spark, d):
    s = P.sample_blocks(requests(spark, d).select("arm", "block", "request_id"), ["arm", "block"], 16, "7")
    return r6(s.select("arm", "block", F.md5(F.concat(F.lit("7|"), "request_id")).alias("h"), "inclusion_probability"), "inclusion_probability")


@query("D3", "dedup_identity", f"""WITH {POPULATION}, g AS (SELECT id, count(*) AS copies, count(DISTINCT (lane, owner)) AS kinds FROM population GROUP BY id)
SELECT id, copies, kinds > 1 AS conflict FROM g""")
def _(spark, d):
    ok, bad = P.dedup_identity(population(spark, d), ["id"], ["lane", "owner"])
    return ok.select("id", "copies", F.lit(False).alias("conflict")).unionByName(bad.withColumn("conflict", F.lit(True)))


SKETCH = f"""{REQUESTS}, raw AS (SELECT arm, CASE WHEN price > 0 THEN ceil(ln(price) / ln(1.01 / 0.99))::BIGINT END AS b, count(*) AS c, min(price) AS lo FROM requests GROUP BY ALL),
fl AS (SELECT *, max(b) OVER (PARTITION BY arm) - 511 AS fl FROM raw),
sk AS (SELECT arm, greatest(b, fl) AS bucket, sum(c)::BIGINT AS c, min(lo) AS lo, coalesce(max(b < fl), false) AS collapsed FROM fl GROUP BY ALL)"""


@query("A9", "log_sketch", f"WITH {SKETCH} SELECT * FROM sk")
def _(spark, d):
    return Q.log_sketch(requests(spark, d), ["arm"], "price", 0.01, 512)


@query("A9", "log_sketch_quantile", f"""WITH {SKETCH}, cu AS (SELECT *, sum(c) OVER (PARTITION BY arm ORDER BY bucket) AS cum, sum(c) OVER (PARTITION BY arm)::BIGINT AS n,
 min(lo) OVER (PARTITION BY arm) AS mn FROM sk), f AS (SELECT arm, arg_min({{'b': bucket, 'k': collapsed, 'n': n, 'm': mn}}, cum) AS s FROM cu WHERE cum > .95 * (n - 1) GROUP BY arm)
SELECT arm, s.n AS n, round(CASE WHEN s.k THEN s.m ELSE exp(s.b * ln(1.01 / .99)) * (2 / (1 + 1.01 / .99)) / 1.01 END, 4) AS lower,
 round(exp(s.b * ln(1.01 / .99)) * (2 / (1 + 1.01 / .99)) / .99, 4) AS upper, s.k AS collapsed FROM f""")
def _(spark, d):
    s = Q.log_sketch(requests(spark, d), ["arm"], "price", 0.01, 512)
    return r6(Q.sketch_quantile(s, ["arm"], 0.95), "lower", "upper", digits=4)
