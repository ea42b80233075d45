"""Statistical comparison, pooling and drill-down queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as N, pooling as G, spans as S
from ..operators.storage import materialize
from .q_population import POP, pop
from .registry import query
from .views import REQUESTS, SPANS, requests, spans, table


def r6(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


CONTRACT_ROWS = [("1-URGENT", 0.05, 0.0, "confirmatory", 0, "independent_blocks", "shop", "r", 1), ("2-HIGH", 0.05, 0.0, "exploratory", 0, "independent_blocks", "shop", "r", 1),
                 ("3-MEDIUM", 0.05, 0.0, "confirmatory", 10**19 // 10, "independent_blocks", "shop", "r", 2), ("4-NOT SPECIFIED", 0.05, 0.0, "confirmatory", 0, "unknown", "", "r", 1),
                 ("5-LOW", 0.01, -0.9, "confirmatory", 0, "independent_blocks", "shop", "r", 3), ("6-NONE", 0.01, 0.0, "confirmatory", 0, "independent_blocks", "shop", "r", 1)]
CONTRACT_COLS = "priority string, alpha double, threshold double, selection string, frozen_at bigint, dependence string, basis string, regime string, look int"
CONTRACTS = "ct AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in CONTRACT_ROWS) + ") t(priority, alpha, threshold, selection, frozen_at, dependence, basis, regime, look))"


@query("C4", "block_compare", f"""WITH {POP}, {CONTRACTS}, n AS (SELECT priority, arm, count(*) AS nb FROM pop GROUP BY ALL),
b AS (SELECT priority, arm, missed / eligible AS lo, (missed + unknown_deadline) / eligible AS hi, 1.0 / nb AS w FROM pop JOIN n USING (priority, arm)),
g AS (SELECT priority, sum(w * lo) FILTER (arm = 'reference') AS rl, sum(w * hi) FILTER (arm = 'reference') AS rh, sum(w * lo) FILTER (arm = 'current') AS cl, sum(w * hi) FILTER (arm = 'current') AS ch,
 sum(w * w) FILTER (arm = 'reference') AS rw, sum(w * w) FILTER (arm = 'current') AS cw FROM b GROUP BY ALL),
x AS (SELECT ct.*, rl, rh, cl, ch, alpha / (look * (look + 1)) AS sa, least(1, sqrt(ln(4 / (alpha / (look * (look + 1)))) * rw / 2)) AS rr, least(1, sqrt(ln(4 / (alpha / (look * (look + 1)))) * cw / 2)) AS cr FROM ct LEFT JOIN g USING (priority)),
y AS (SELECT *, greatest(0, cl - cr) - least(1, rh + rr) AS lo, least(1, ch + cr) - greatest(0, rl - rr) AS hi,
 CASE priority WHEN '2-HIGH' THEN 'exploratory selection cannot confirm itself' WHEN '3-MEDIUM' THEN 'confirmation reused selection data' WHEN '4-NOT SPECIFIED' THEN 'insufficient statistical resolution'
 WHEN '6-NONE' THEN 'insufficient statistical resolution' END AS refusal FROM x)
SELECT priority, round(sa, 9) AS spent_alpha, round(cl - rh, 6) AS observed_lo, round(ch - rl, 6) AS observed_hi, CASE WHEN refusal IS NULL THEN round(lo, 6) END AS lo, CASE WHEN refusal IS NULL THEN round(hi, 6) END AS hi,
 coalesce(refusal IS NULL AND lo > threshold, false) AS regression, coalesce(refusal, CASE WHEN lo > threshold THEN 'material regression' ELSE 'material change not established' END) AS reason FROM y""")
def _(spark, d):
    p = pop(spark, d)
    n = p.groupBy("priority", "arm").agg(F.count(F.lit(1)).alias("nb"))
    b = p.join(n, ["priority", "arm"]).select(
        "priority", "arm", F.concat_ws("/", "arm", "block").alias("unit"), (F.col("missed") / F.col("eligible")).alias("lo"), ((F.col("missed") + F.col("unknown_deadline")) / F.col("eligible")).alias("hi"),
        (1.0 / F.col("nb")).alias("weight"), F.regexp_replace("block", "-", "").cast("long").alias("start"), F.lit("r").alias("regime"))
    c = spark.createDataFrame(CONTRACT_ROWS, CONTRACT_COLS)
    out = N.block_compare(b, c, "priority")
    return r6(r6(out, "spent_alpha", digits=9), "observed_lo", "observed_hi", "lo", "hi").withColumn("regression", F.coalesce("regression", F.lit(False)))


PAIRS = f"""{REQUESTS}, pr AS (SELECT priority, right(block, 2) AS pair, round(avg(total) FILTER (arm = 'current'), 6) AS c, round(avg(total) FILTER (arm = 'reference'), 6) AS t FROM requests GROUP BY ALL),
dl AS (SELECT priority, c - t AS d, row_number() OVER (PARTITION BY priority ORDER BY c - t) - 1 AS i FROM pr)"""


@query("C5", "paired_randomization", f"""WITH {PAIRS}, o AS (SELECT priority, avg(d) AS eff, count(*) AS n FROM dl GROUP BY ALL),
m AS (SELECT priority, mask, sum(CASE WHEN (mask >> i) % 2 = 1 THEN d ELSE -d END) AS s FROM dl CROSS JOIN (SELECT unnest(range(4096)) AS mask) GROUP BY ALL)
SELECT priority, n, round(eff, 6) AS effect, round(count(*) FILTER (s / n >= eff - 1e-12) / count(*), 6) AS p_value, count(*) AS assignments FROM m JOIN o USING (priority) GROUP BY priority, n, eff""")
def _(spark, d):
    r = requests(spark, d).groupBy("priority", F.substring("block", 6, 2).alias("pair")).agg(
        F.round(F.avg(F.when(F.col("arm") == "current", F.col("total"))), 6).alias("control"), F.round(F.avg(F.when(F.col("arm") == "reference", F.col("total"))), 6).alias("treatment"))
    return r6(N.paired_randomization(r, "priority"), "effect", "p_value").select("priority", "n", "effect", "p_value", "assignments")


DRAWS = 10000


@query("C5", "paired_randomization_draws", f"""WITH {REQUESTS}, pr AS (SELECT substring(block, 6, 2) || '/' || priority AS pair, round(avg(total) FILTER (arm = 'current'), 6) - round(avg(total) FILTER (arm = 'reference'), 6) AS d FROM requests GROUP BY ALL),
o AS (SELECT count(d) AS n, avg(d) AS eff FROM pr), bs AS (SELECT d, ('0x' || substring(md5('0|' || pair), 1, 15))::BIGINT AS base FROM pr WHERE d IS NOT NULL),
dr AS (SELECT j, j::HUGEINT * {N.SPREAD_DRAW} % 18446744073709551616 AS st FROM (SELECT unnest(range(1, {DRAWS} + 1)) AS j)),
sg AS (SELECT j, d, xor(base::UBIGINT, st::UBIGINT)::HUGEINT * {N.SPREAD} % 18446744073709551616 // {2**N.SIGN_BIT} % 2 AS bit FROM bs, dr),
s AS (SELECT j, sum(CASE WHEN bit = 0 THEN d ELSE -d END) AS s FROM sg GROUP BY j)
SELECT 'all' AS grp, any_value(n) AS n, round(any_value(eff), 6) AS effect, round((count(*) FILTER (s / n >= eff - 1e-12) + 1) / ({DRAWS} + 1), 6) AS p_value, {DRAWS}::BIGINT AS assignments, round(sqrt(ln(40) / (2.0 * {DRAWS})), 6) AS error_bound, 'monte carlo' AS method FROM s, o""")
def _(spark, d):
    r = requests(spark, d).groupBy(F.lit("all").alias("grp"), F.concat_ws("/", F.substring("block", 6, 2), "priority").alias("pair")).agg(
        F.round(F.avg(F.when(F.col("arm") == "current", F.col("total"))), 6).alias("control"), F.round(F.avg(F.when(F.col("arm") == "reference", F.col("total"))), 6).alias("treatment"))
    return r6(N.paired_randomization(r, "grp", DRAWS), "effect", "p_value", "error_bound")


@query("T5", "paired_schedule", """WITH p AS (SELECT DISTINCT o_custkey AS pair FROM orders), q AS (SELECT pair, md5('s|' || pair || '|control') < md5('s|' || pair || '|treatment') AS f FROM p)
SELECT pair, 0 AS position, CASE WHEN f THEN 'control' ELSE 'treatment' END AS arm FROM q UNION ALL SELECT pair, 1, CASE WHEN f THEN 'treatment' ELSE 'control' END FROM q""")
def _(spark, d):
    return N.paired_schedule(table(spark, d, "orders").select(F.col("o_custkey").alias("pair")).distinct(), "s")


STR = f"""{REQUESTS}, rs AS (SELECT arm, priority, CASE WHEN l_returnflag = 'R' AND lineno = 7 THEN NULL ELSE l_returnflag END AS flag, CASE WHEN price >= 50000 THEN 2 WHEN price >= 20000 THEN 1 ELSE 0 END AS bin, total AS value FROM requests),
st AS (SELECT priority, flag, bin, avg(value) FILTER (arm = 'reference') AS rf, avg(value) FILTER (arm = 'current') AS cu, count(*) FILTER (arm = 'reference') AS n_ref, count(*) FILTER (arm = 'current') AS n_cur FROM rs GROUP BY ALL),
su AS (SELECT *, flag IS NOT NULL AND n_ref > 0 AND n_cur > 0 AS supported FROM st)"""


def strata_rows(spark, d):
    from ..functions.scalars import numeric_bin
    r = requests(spark, d)
    return r.select("arm", "priority", F.when(~((F.col("l_returnflag") == "R") & (F.col("lineno") == 7)), F.col("l_returnflag")).alias("flag"), numeric_bin(F.col("price"), [20000, 50000]).alias("bin"), F.col("total").alias("value"))


@query("C6", "stratified_change", f"WITH {STR} SELECT priority, flag, bin, n_ref, n_cur, supported, CASE WHEN supported THEN round(cu - rf, 6) END AS change FROM su")
def _(spark, d):
    return r6(N.stratified_change(strata_rows(spark, d), "priority", ["flag", "bin"]), "change").drop("ref", "cur")


@query("C6", "stratified_summary", f"""WITH {STR}, w AS (SELECT DISTINCT priority, unnest(['N', 'R']) AS flag, 1 AS bin, CASE WHEN priority = '5-LOW' THEN .7 ELSE .5 END AS weight FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders) p),
g AS (SELECT priority, count(*) FILTER (NOT supported) AS unsupported, 1 - sum(CASE WHEN supported THEN n_cur ELSE 0 END) / sum(n_cur) AS ef FROM su GROUP BY ALL),
t AS (SELECT priority, avg(value) FILTER (arm = 'current') - avg(value) FILTER (arm = 'reference') AS tc FROM rs GROUP BY ALL),
s AS (SELECT priority, sum(weight) AS sw, sum(weight * (cu - rf)) AS sc FROM w JOIN su USING (priority, flag, bin) GROUP BY ALL)
SELECT priority, unsupported, round(ef, 6) AS excluded_fraction, round(tc, 6) AS total_change, CASE WHEN abs(sw - 1) < 1e-9 THEN round(sc, 6) END AS standardized_change FROM g JOIN t USING (priority) JOIN s USING (priority)""")
def _(spark, d):
    r = strata_rows(spark, d)
    s = N.stratified_change(r, "priority", ["flag", "bin"])
    w = r.select("priority").distinct().select("priority", F.explode(F.array(F.lit("N"), F.lit("R"))).alias("flag"), F.lit(1).alias("bin"), F.when(F.col("priority") == "5-LOW", 0.7).otherwise(0.5).alias("weight"))
    return r6(N.stratified_summary(s, "priority", ["flag", "bin"], w, r), "excluded_fraction", "total_change", "standardized_change")


@query("C7", "joint_outcomes", """SELECT l_returnflag, l_linenumber, round(avg(CASE WHEN l_quantity > 20 AND l_discount * 400 > 20 THEN 1.0 ELSE 0 END), 6) AS simultaneous_exceedance,
 round(avg(greatest(l_quantity, l_discount * 400)), 6) AS completion_mean FROM lineitem GROUP BY ALL""")
def _(spark, d):
    l = table(spark, d, "lineitem").withColumn("other", F.col("l_discount") * 400)
    return r6(N.joint_outcomes(l, ["l_returnflag", "l_linenumber"], "l_quantity", "other", 20), "simultaneous_exceedance", "completion_mean")


@query("C8", "diff_in_diff", f"""WITH {REQUESTS}, x AS (SELECT priority, clock_domain = 'O' AS t, arm = 'current' AS a, total FROM requests)
SELECT priority, round((avg(total) FILTER (t AND a) - avg(total) FILTER (t AND NOT a)) - (avg(total) FILTER (NOT t AND a) - avg(total) FILTER (NOT t AND NOT a)), 6) AS effect,
 CASE WHEN priority < '3' THEN 'qualified natural contrast' ELSE 'observational association' END AS interpretation FROM x GROUP BY priority""")
def _(spark, d):
    r = requests(spark, d).select("priority", (F.col("clock_domain") == "O").alias("treated"), (F.col("arm") == "current").alias("after"), F.col("total").alias("value"))
    return r6(N.diff_in_diff(r, ["priority"], F.col("priority") < "3"), "effect")


def observations(spark, d):
    """Event values per type and day; all types but clicks drift with the day, and one type's days are constant."""
    day = F.substring("run_id", 9, 2).cast("int")
    v = F.when(F.col("stage") == "cpu", F.col("dur_ms")).when(F.col("stage") == "scheduler", day * 1.0).otherwise(F.col("dur_ms") + day * F.lit(0.75))
    return spans(spark, d).select(F.col("stage").alias("metric"), F.col("run_id").alias("ctx"), v.alias("value"))


OBS = f"""{SPANS}, obs AS (SELECT stage AS metric, run_id AS ctx, CASE stage WHEN 'cpu' THEN dur_ms WHEN 'scheduler' THEN right(run_id, 2)::INT ELSE dur_ms + right(run_id, 2)::INT * .75 END AS value FROM spans),
cells AS (SELECT metric, ctx, count(*) AS n, avg(value) AS y, coalesce(var_samp(value) / count(*), 0) AS v, coalesce(var_samp(value) * (count(*) - 1), 0) AS m2 FROM obs GROUP BY ALL)"""
DL = """a AS (SELECT metric, count(*) AS j, min(v) AS v_min, avg(v) AS v_mean, min(y) AS y_min, max(y) AS y_max, avg(y) AS grand, sum(1 / v) FILTER (v > 0) AS sw, sum(1 / (v * v)) FILTER (v > 0) AS sw2, sum(y / v) FILTER (v > 0) AS swy FROM cells GROUP BY ALL),
q AS (SELECT metric, sum(power(y - swy / sw, 2) / v) FILTER (v > 0) AS q FROM cells JOIN a USING (metric) GROUP BY ALL),
dl AS (SELECT *, CASE WHEN j < 2 THEN 'single cell' WHEN v_min <= 1e-20 THEN 'zero sampling variance' WHEN y_max - y_min <= 0 THEN 'identical values' WHEN sw - sw2 / sw <= 0 THEN 'degenerate weights' ELSE 'applied' END AS method,
 greatest(0, (q - (j - 1)) / (sw - sw2 / sw)) AS t2 FROM a JOIN q USING (metric)),
pp AS (SELECT *, CASE WHEN method = 'applied' THEN t2 ELSE 0 END AS tau2 FROM dl),
re AS (SELECT metric, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu_re, power(sum(1 / (v + tau2)), 2) / sum(1 / power(v + tau2, 2)) AS ess_re FROM cells JOIN pp USING (metric) WHERE method = 'applied' GROUP BY ALL),
s AS (SELECT pp.*, CASE WHEN method = 'applied' THEN mu_re ELSE grand END AS mu, CASE WHEN method = 'applied' THEN ess_re WHEN method = 'identical values' THEN j ELSE 1 END AS ess FROM pp LEFT JOIN re USING (metric))"""


def cells(spark, d):
    return materialize(G.cells_of(observations(spark, d), ["metric", "ctx"]), "cells")


@query("C9", "partial_pool", f"WITH {OBS}, {DL} SELECT metric, j, round(tau2, 6) AS tau2, round(mu, 6) AS mu, round(ess, 4) AS ess, method FROM s")
def _(spark, d):
    _, s = G.partial_pool(cells(spark, d), ["metric"])
    return r6(r6(s.select("metric", "j", "tau2", "mu", "ess", "method"), "tau2", "mu"), "ess", digits=4)


@query("C9", "partial_pool_cells", f"""WITH {OBS}, {DL} SELECT metric, ctx, round(CASE WHEN method = 'applied' THEN v / (v + tau2) WHEN method = 'identical values' THEN 1 ELSE 0 END, 6)::DOUBLE AS lambda,
 round(CASE WHEN method = 'applied' THEN v / (v + tau2) * mu + (1 - v / (v + tau2)) * y ELSE y END, 6) AS shrunk FROM cells JOIN s USING (metric)""")
def _(spark, d):
    c, _s = G.partial_pool(cells(spark, d), ["metric"])
    return r6(c.select("metric", "ctx", "lambda", "shrunk"), "lambda", "shrunk")


@query("C10", "tau2_curves", f"""WITH {OBS}, g AS (SELECT metric, i * 2.0 AS tau2 FROM (SELECT DISTINCT metric FROM cells) CROSS JOIN (SELECT unnest(range(1, 41)) AS i)),
m AS (SELECT metric, tau2, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sum(1 / (v + tau2)) AS sw, sum(ln(v + tau2)) AS sl FROM cells JOIN g USING (metric) GROUP BY ALL),
q AS (SELECT metric, tau2, sum(power(y - mu, 2) / (v + tau2)) AS q FROM cells JOIN m USING (metric) GROUP BY ALL)
SELECT metric, tau2::DOUBLE AS tau2, round(q, 5) AS q, round(mu, 6) AS mu, round(-.5 * (sl + q + ln(sw)), 5) AS reml, round(-.5 * (sl + q), 5) AS ml FROM m JOIN q USING (metric, tau2)""")
def _(spark, d):
    c = cells(spark, d)
    g = c.select("metric").distinct().select("metric", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).select("metric", (F.col("i") * 2.0).alias("tau2"))
    m = c.groupBy("metric").agg(F.avg("y").alias("y0"))
    out = G.grid_curves(c.join(m, "metric"), g, ["metric"])
    return r6(r6(out.drop("sw"), "mu"), "q", "reml", "ml", digits=5)


def _tau(method):
    def run(spark, d):
        return r6(G.tau2_grid(cells(spark, d), ["metric"], method).drop("sw"), "tau2", "mu", digits=5)
    return run


query("C10", "tau2_reml")(_tau("reml"))
query("C10", "tau2_paule_mandel")(_tau("pm"))
query("C10", "tau2_pc_map")(_tau("pc"))


@query("C11", "q_profile")
def _(spark, d):
    return r6(G.q_profile(cells(spark, d), ["metric"]), "lo", "hi")


@query("C12", "prediction_interval")
def _(spark, d):
    return r6(G.prediction_interval(cells(spark, d), ["metric"]), "mu", "tau2", "lo", "hi", digits=5)


@query("C13", "map_prior", f"""WITH {OBS}, {DL} SELECT metric, round(CASE WHEN v_min <= 1e-20 THEN grand ELSE swy / sw END, 6) AS mean, round(CASE WHEN v_min <= 1e-20 THEN 'inf'::DOUBLE ELSE 1 / sw END, 6) AS var, 1.0::DOUBLE AS vague_var,
 round(CASE WHEN v_min <= 1e-20 THEN 0 ELSE .5 * (1 - t2 / (t2 + v_mean)) END, 6) AS weight, round(CASE WHEN v_min <= 1e-20 THEN 0 ELSE t2 END, 6) AS tau2, round(CASE WHEN v_min <= 1e-20 THEN 1 ELSE t2 / (t2 + v_mean) END, 6) AS conflict FROM s""")
def _(spark, d):
    return r6(G.map_prior(cells(spark, d), ["metric"]), "mean", "var", "weight", "tau2", "conflict")


@query("C14", "loo_mse", f"""WITH {REQUESTS}, obs AS (SELECT priority AS metric, left(block, 4) AS ctx, total + left(block, 4)::INT % 3 AS value FROM requests), cl AS (SELECT metric, ctx, count(*) AS n, avg(value) AS y, var_samp(value) * (count(*) - 1) AS m2 FROM obs GROUP BY ALL),
h AS (SELECT metric, ctx AS hc, value AS x, count(*) AS c FROM obs GROUP BY ALL), t AS (SELECT metric, count(*) AS na, sum(value) AS sa FROM obs GROUP BY ALL),
j AS (SELECT h.metric, hc, x, c, ctx = hc AS mine, CASE WHEN ctx = hc THEN y - (x - y) / (n - 1) ELSE y END AS y, CASE WHEN ctx = hc THEN n - 1 ELSE n END AS n, CASE WHEN ctx = hc THEN m2 - (x - y) * (x - (y - (x - y) / (n - 1))) ELSE m2 END AS m2 FROM h JOIN cl USING (metric)),
k AS (SELECT *, m2 / (n - 1) / n AS v FROM j), a AS (SELECT metric, hc, x, count(*) AS j, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2, sum(y / v) AS swy FROM k GROUP BY ALL),
q AS (SELECT metric, hc, x, sum(power(y - swy / sw, 2) / v) AS q FROM k JOIN a USING (metric, hc, x) GROUP BY ALL),
d AS (SELECT *, greatest(0, (q - (j - 1)) / (sw - sw2 / sw)) AS t2 FROM a JOIN q USING (metric, hc, x)),
r AS (SELECT metric, hc, x, sum(y / (v + t2)) / sum(1 / (v + t2)) AS mu, any_value(t2) AS t2, max(CASE WHEN mine THEN y END) AS oy, max(CASE WHEN mine THEN v END) AS ov, any_value(c) AS c FROM k JOIN d USING (metric, hc, x) GROUP BY ALL)
SELECT metric, sum(c)::BIGINT AS n, round(sum(c * power((sa - x) / (na - 1) - x, 2)) / sum(c), 5) AS pooled, round(sum(c * power(oy - x, 2)) / sum(c), 5) AS unpooled,
 round(sum(c * power(ov / (ov + t2) * mu + (1 - ov / (ov + t2)) * oy - x, 2)) / sum(c), 5) AS partial FROM r JOIN t USING (metric) GROUP BY metric""")
def _(spark, d):
    o = requests(spark, d).select(F.col("priority").alias("metric"), F.substring("block", 1, 4).alias("ctx"), (F.col("total") + F.substring("block", 1, 4).cast("int") % 3).alias("value"))
    return r6(G.loo_mse(o, ["metric"], "ctx"), "pooled", "unpooled", "partial", digits=5)


@query("C14", "loo_context_mse", f"""WITH {OBS}, h AS (SELECT h.metric, h.ctx AS hc, h.n AS hn, h.y AS hy, h.m2 AS hm, o.n, o.y, o.v FROM cells h JOIN cells o ON o.metric = h.metric AND o.ctx <> h.ctx),
a AS (SELECT metric, hc, count(*) AS j, min(v) AS vm, avg(y) AS grand, sum(1 / v) FILTER (v > 0) AS sw, sum(1 / (v * v)) FILTER (v > 0) AS sw2, sum(y / v) FILTER (v > 0) AS swy, sum(n * y) / sum(n) AS pooled FROM h GROUP BY ALL), q AS (SELECT metric, hc, sum(power(y - swy / sw, 2) / v) FILTER (v > 0) AS q FROM h JOIN a USING (metric, hc) GROUP BY ALL),
d AS (SELECT *, greatest(0, (q - (j - 1)) / (sw - sw2 / sw)) AS t2 FROM a JOIN q USING (metric, hc)), r AS (SELECT metric, hc, any_value(hn) AS hn, any_value(hy) AS hy, any_value(hm) AS hm, any_value(pooled) AS pooled, CASE WHEN any_value(vm) <= 1e-20 THEN any_value(grand) ELSE sum(y / (v + t2)) / sum(1 / (v + t2)) END AS mu FROM h JOIN d USING (metric, hc) GROUP BY ALL)
SELECT metric, sum(hn)::BIGINT AS n, round(sum(hm + hn * power(pooled - hy, 2)) / sum(hn), 5) AS pooled, round(sum(hm + hn * power(mu - hy, 2)) / sum(hn), 5) AS partial, NULL::DOUBLE AS unpooled FROM r GROUP BY metric""")
def _(spark, d):
    o = observations(spark, d)
    return r6(G.loo_context_mse(o, ["metric"], "ctx"), "pooled", "partial", digits=5)


@query("C15", "borrow_gate")
def _(spark, d):
    c = cells(spark, d).withColumn("measured", (F.col("metric") != "gpu") | (F.col("ctx") < "2024-01-03"))
    return r6(G.borrow_gate(c, ["metric"], threshold=10.0), "tau2", "ess", "mu", "p", "zmax")


@query("C16", "james_stein", f"""WITH {OBS}, s AS (SELECT metric, count(*) AS p, avg(y) AS g, var_pop(y) * count(*) AS sp, avg(v) AS s2 FROM cells GROUP BY ALL),
f AS (SELECT *, CASE WHEN p < 3 OR sp <= 0 OR s2 <= 1e-20 THEN 1 ELSE least(1, greatest(0, 1 - (p - 2) * s2 / sp)) END AS factor FROM s)
SELECT metric, ctx, round(factor, 6)::DOUBLE AS factor, round(g + factor * (y - g), 6) AS shrunk FROM cells JOIN f USING (metric)""")
def _(spark, d):
    return r6(G.james_stein(cells(spark, d), ["metric"]).select("metric", "ctx", "factor", "shrunk"), "factor", "shrunk")


@query("C17", "directional_effects", f"""WITH {SPANS}, s AS (SELECT run_id, avg(dur_ns) FILTER (kind = 'cpu_launch') AS cpu_dur, avg(dur_ns) FILTER (kind = 'gpu_kernel') AS kernel_dur, avg(dur_ns) FILTER (kind = 'sync_edge') AS blocked FROM spans GROUP BY ALL),
u AS (UNPIVOT s ON cpu_dur, kernel_dur, blocked INTO NAME metric VALUE value)
SELECT a.run_id, a.metric, CASE WHEN a.metric = 'blocked' THEN b.value > a.value ELSE b.value < a.value END AS hold FROM u a JOIN u b ON a.metric = b.metric AND CAST(b.run_id AS DATE) = CAST(a.run_id AS DATE) + 1""")
def _(spark, d):
    def mean(k):
        return F.avg(F.when(F.col("kind") == k, F.col("dur_ns")))
    s = spans(spark, d).groupBy("run_id").agg(mean("cpu_launch").alias("cpu_dur"), mean("gpu_kernel").alias("kernel_dur"), mean("sync_edge").alias("blocked"))
    u = S.unpivot_metrics(s, ["run_id"], ("cpu_dur", "kernel_dur", "blocked"))
    e = spark.createDataFrame([("cpu_dur", "down"), ("kernel_dur", "down"), ("blocked", "up")], "metric string, direction string")
    after = u.withColumn("run_id", F.date_sub(F.col("run_id").cast("date"), 1).cast("string"))
    return N.directional_effects(u, after, e, "run_id").select("run_id", "metric", "hold")


EXP = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE o_totalprice / 1000 - 100 END AS predicted, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_custkey % 500) - 50.0 END AS measured, o_orderpriority <> '5-LOW' AS effects_hold FROM orders"


@query("C18", "experiment_status", f"""WITH e AS ({EXP}), r AS (SELECT *, CASE WHEN measured IS NOT NULL AND abs(predicted) > 1e-9 THEN measured / predicted ELSE 0 END AS recovery FROM e)
SELECT id, round(recovery, 6)::DOUBLE AS recovery, CASE WHEN measured > 0 AND recovery >= .5 AND effects_hold THEN 'VERIFIED' ELSE 'TESTED' END AS status FROM r""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey id", "case when o_custkey % 9 = 0 then 0 else o_totalprice / 1000 - 100 end predicted",
                                             "case when o_orderstatus = 'P' then null else (o_custkey % 500) - 50.0d end measured", "o_orderpriority <> '5-LOW' effects_hold")
    return r6(N.experiment_status(o).select("id", "recovery", "status"), "recovery")


@query("C25", "restoration_check", """WITH a AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS seq, max(l_returnflag) AS arm, max(l_quantity) AS setting, bool_and(l_tax < 0.08 OR l_suppkey % 3 > 0) AS restored, max(l_discount) AS disc FROM lineitem GROUP BY ALL)
SELECT k, bool_and(k % 2 = 0 OR disc < .1) AS readback_ok, bool_and(k % 5 > 0 OR seq % 64 > 0) AS order_ok, bool_and(restored) AS restored, bool_and(k % 2 = 0 OR disc < .1) AND bool_and(k % 5 > 0 OR seq % 64 > 0) AND bool_and(restored) AS usable FROM a GROUP BY k""")
def _(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(
        F.max("l_returnflag").alias("arm"), F.max("l_quantity").alias("setting"), F.bool_and((F.col("l_tax") < 0.08) | (F.col("l_suppkey") % 3 > 0)).alias("restored"), F.max("l_discount").alias("disc"))
    rb = a.select("k", "seq", F.when((F.col("k") % 2 == 0) | (F.col("disc") < 0.1), F.col("setting")).otherwise(-1.0).alias("observed"))
    sc = a.select("k", "seq", F.when((F.col("k") % 5 > 0) | (F.col("seq") % 64 > 0), F.col("arm")).otherwise("?").alias("arm"))
    return N.restoration_check(a.drop("disc"), rb, sc, "k")


PROF = f"""{SPANS}, p AS (SELECT run_id, stage, avg(dur_ms) AS z FROM spans GROUP BY ALL), j AS (SELECT b.run_id, stage, round(a.z, 2) AS z, round(b.z, 1) AS z2 FROM p a JOIN p b USING (stage) WHERE CAST(b.run_id AS DATE) = CAST(a.run_id AS DATE) + 1),
r AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY z) + (count(*) OVER (PARTITION BY run_id, z) - 1) / 2 AS r1, rank() OVER (PARTITION BY run_id ORDER BY z2) + (count(*) OVER (PARTITION BY run_id, z2) - 1) / 2 AS r2 FROM j)"""


@query("C20", "profile_agreement", f"WITH {PROF} SELECT run_id, round(coalesce(corr(r1, r2), 0), 6) AS spearman, round(sum(z * z2) / sqrt(sum(z * z)) / sqrt(sum(z2 * z2)), 6) AS cosine FROM r GROUP BY run_id")
def _(spark, d):
    p = spans(spark, d).groupBy("run_id", "stage").agg(F.avg("dur_ms").alias("z"))
    a = p.select(F.date_add(F.col("run_id").cast("date"), 1).cast("string").alias("run_id"), "stage", F.round("z", 2).alias("z"))
    return r6(N.profile_agreement(a, p.withColumn("z", F.round("z", 1)), "run_id"), "spearman", "cosine")


@query("C20", "dose_response", f"""WITH {SPANS}, p AS (SELECT stage, right(run_id, 2)::DOUBLE AS dose, median(dur_ms) AS response, arm FROM spans GROUP BY ALL), g AS (SELECT stage, regr_slope(response, dose) AS slope, min(response) AS lo, max(response) AS hi FROM p WHERE arm = 'reference' GROUP BY ALL),
o AS (SELECT stage, min(response) AS a, max(response) AS b, avg(response) AS m FROM p WHERE arm = 'current' GROUP BY ALL) SELECT stage, round(slope, 6) AS slope, (slope > 0) = (m > 1) AS sign_match, lo <= b AND a <= hi AS overlap FROM g JOIN o USING (stage)""")
def _(spark, d):
    from ..operators.quantiles import quantiles
    p = quantiles(spans(spark, d), ["stage", "arm", "run_id"], "dur_ms", {"response": (0.5, "linear")}).withColumn("dose", F.substring("run_id", 9, 2).cast("double"))
    return r6(N.dose_response(p.where("arm = 'reference'"), p.where("arm = 'current'"), "stage"), "slope")


REG = "k AS (SELECT l_orderkey AS inc, l_linenumber AS region, min(l_quantity) AS dur, max(l_discount) AS dd, min(l_tax) AS tt, count(*) AS samples, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"


@query("C23", "stall_attribution", f"""WITH {REG}, r AS (SELECT inc, region, s % 7 = 0 AS nosample, (CASE WHEN s % 23 = 0 THEN NULL ELSE dur - 20 END) AS ex, CASE WHEN s % 7 = 0 THEN 0 ELSE (dd * 100)::INT - 5 + (tt * 100)::INT - 4 END AS sd, (dd * 100)::INT - 5 AS a, (tt * 100)::INT - 4 AS b,
 s % 19 = 0 AS reseed, samples FROM k), sc AS (SELECT *, ex + 10 * sd AS score FROM r),
g AS (SELECT inc, count(*) AS n, count(*) FILTER (ex IS NULL) AS unp, count(*) FILTER (reseed) AS rs, max(greatest(ex, sd)) AS mx, max(score) AS best, arg_max(region, (score, region)) FILTER (score IS NOT NULL) AS top, arg_max(nosample, (score, region)) FILTER (score IS NOT NULL) AS topn,
 count(*) FILTER (NOT nosample) AS ns, sum(CASE WHEN NOT nosample THEN a END) AS sa, sum(CASE WHEN NOT nosample THEN b END) AS sb FROM sc GROUP BY inc),
t AS (SELECT inc, count(*) AS ties FROM sc JOIN g USING (inc) WHERE score = best GROUP BY inc),
v AS (SELECT *, CASE WHEN n > 3 THEN 'suspect set size' WHEN rs > 0 THEN 'seeds differ' WHEN unp > 0 THEN 'no matched pair' WHEN mx <= 0 THEN 'no excess' WHEN ns = 0 THEN 'no samples' END AS refusal FROM g JOIN t USING (inc))
SELECT inc, refusal, CASE WHEN refusal IS NULL THEN top END AS winner, CASE WHEN refusal IS NULL THEN CASE WHEN sb >= sa THEN 'wait' ELSE 'long' END END AS stall_class, refusal IS NULL AND best > 0 AND ties = 1 AND NOT topn AS sufficient FROM v""")
def _(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("inc"), F.col("l_linenumber").alias("region")).agg(
        F.min("l_quantity").alias("dur"), F.max("l_discount").alias("dd"), F.min("l_tax").alias("tt"), F.count(F.lit(1)).alias("samples"), F.min("l_suppkey").alias("s"))
    r = k.selectExpr("inc", "region", "dur", "case when s % 23 = 0 then null else 20d end base_dur", "1 seed", "if(s % 19 = 0, 2, 1) base_seed", "samples",
                     "case when s % 7 > 0 then map('long', cast(round(dd * 100) as bigint), 'wait', cast(round(tt * 100) as bigint)) end stalls", "map('long', 5L, 'wait', 4L) base_stalls")
    return N.stall_attribution(r, "inc", 10)[1]


@query("C24", "lineage_diff", """WITH c AS (SELECT conv_id, turn, role, length(text) // 300 AS shape FROM conversations), b AS (SELECT conv_id + 1 AS conv_id, turn, role, shape FROM c),
j AS (SELECT c.conv_id, c.turn, c.role, c.shape FROM c JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn WHERE c.role <> b.role OR c.shape <> b.shape)
SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role, arg_min(shape, turn) AS shape FROM j GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("ord"), "role", F.floor(F.length("text") / 300).alias("shape"))
    b = c.withColumn("conv_id", F.col("conv_id") + 1).drop("ord")
    return N.lineage_diff(c, b, ["conv_id"], "turn", "ord", ["role", "shape"]).drop("ord")


@query("J6", "lineage_join", """WITH i AS (SELECT DISTINCT l_partkey AS cid FROM lineitem WHERE l_quantity > 30 AND l_discount > .05), l AS (SELECT p_partkey AS cid, p_type AS op, p_brand AS module FROM part WHERE p_size > 10)
SELECT cid, op, module, CASE WHEN op IS NULL THEN 0 WHEN op = 'PROMO' THEN .9 ELSE .5 END::DOUBLE AS confidence FROM i FULL JOIN l USING (cid)""")
def _(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 30 and l_discount > 0.05").select(F.col("l_partkey").alias("cid")).distinct()
    lin = table(spark, d, "part").where("p_size > 10").selectExpr("p_partkey cid", "p_type op", "array(p_brand, p_name) modules")
    return N.lineage_join(ids, lin, ["cid"], {"PROMO": 0.9})


@query("J7", "first_divergence", """WITH c AS (SELECT conv_id, role AS stage, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos, length(text) // 300 AS len, left(text, 0) || md5(text) AS h FROM conversations),
a AS (SELECT * FROM c), b AS (SELECT conv_id + 1 AS conv_id, stage, pos, len, h FROM c),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.stage, b.stage) AS stage, coalesce(a.pos, b.pos) AS pos, a.pos AS ap, b.pos AS bp, concat_ws(',', CASE WHEN a.h <> b.h THEN 'h' END, CASE WHEN a.len <> b.len THEN 'len' END) AS fields
 FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.stage = b.stage AND a.pos = b.pos),
l AS (SELECT conv_id, stage, least(count(ap), count(bp)) AS pos, -1 AS kind, 'length' AS fields FROM j GROUP BY conv_id, stage HAVING count(ap) <> count(bp)),
d AS (SELECT conv_id, stage, pos, kind, fields FROM l UNION ALL SELECT conv_id, stage, pos, pos, fields FROM j WHERE ap IS NOT NULL AND bp IS NOT NULL AND fields <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE stage WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, kind) AS rn FROM d)
SELECT conv_id, stage, pos::BIGINT AS pos, fields FROM f WHERE rn = 1""")
def _(spark, d):
    from ..operators.ordered import scan
    c = scan(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"], n=("sum", F.lit(1))).select(
        "conv_id", F.col("role").alias("stage"), (F.col("n") - 1).alias("pos"), F.col("turn").alias("ident"), F.floor(F.length("text") / 300).alias("len"), F.md5("text").alias("h"))
    c = materialize(c, "conv")
    b = c.withColumn("conv_id", F.col("conv_id") + 1)
    return N.first_divergence(c, b, "conv_id", ["system", "user", "assistant"], ["len", "h"]).drop("ident")

