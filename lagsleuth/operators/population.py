"""Request populations: censoring-aware counts, miss runs, droughts, mergeable block summaries.

Requests: request_id, delivery_id, status, finish_ns, deadline_ns, clock_domain and an accounting order.
An unknown deadline or finish stays unknown; it is never read as on time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import join_on, scan
from .quantiles import latency_stats
from .storage import materialize

# Outcomes that count as missed once their finish reaches the deadline.
LATE_STATUSES = ("timeout", "censored", "not_submitted")


def missed(status="status", finish="finish_ns", deadline="deadline_ns") -> Column:
    """True / False / null: completed late, completed in time, or not known."""
    s, f, d = F.col(status), F.col(finish), F.col(deadline)
    known = f.isNotNull() & d.isNotNull()
    return F.when(known & (s == "ok"), f > d).when(known & s.isin(*LATE_STATUSES) & (f >= d), F.lit(True))


def dedup_identity(df: DataFrame, keys: list[str], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per identity with equal content, identities seen with different content)."""
    h = F.sha2(F.to_json(F.struct(*content)), 256)
    g = (df.withColumn("__h", h).groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("copies"), F.min("__h").alias("__a"), F.max("__h").alias("__b"),
              F.max_by(F.struct(*content), "__h").alias("__row")))
    same = F.col("__a") == F.col("__b")
    return (g.where(same).select(*keys, "copies", "__row.*"),
            g.where(~same).select(*keys, "copies"))


def population(requests: DataFrame, block: list[str], reservoir: int = 16) -> DataFrame:
    """One row per block. Copies of a request count once: pass the first part of :func:`dedup_identity`."""
    m = missed()
    st = F.col("status")
    n = F.count(F.lit(1))
    return requests.groupBy(*block).agg(
        n.alias("eligible"), F.count_if(st == "ok").alias("ok"), F.count_if(st == "timeout").alias("timeout"),
        F.count_if(st == "error").alias("error"), F.count_if(m).alias("missed"), F.count_if(~m).alias("on_time"),
        F.count_if(m.isNull()).alias("unknown_deadline"), F.count_distinct("delivery_id").alias("logical_deliveries"),
        F.least(F.lit(1.0), F.lit(float(reservoir)) / n).alias("inclusion_probability"))


def threshold_exceedance(requests: DataFrame, keys: list[str], value: Column, thresholds=(1, 10, 100, 1000)) -> DataFrame:
    """Completed requests strictly above each threshold; the others are censored, not zero."""
    ok = F.col("status") == "ok"
    return requests.groupBy(*keys).agg(F.count_if(~ok).alias("censored"),
                                       *[F.count_if(ok & (value > t)).alias(f"over_{t}") for t in thresholds])


def miss_runs(requests: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """Longest run of consecutive misses and the runs at both ends; an unknown outcome breaks a run."""
    hit = F.coalesce(missed(), F.lit(False))
    s = scan(requests.withColumn("__hit", hit), block, order,
             grp=("sum", F.when(F.col("__hit"), 0).otherwise(1)), breaks=("total_sum", F.when(F.col("__hit"), 0).otherwise(1)))
    runs = s.groupBy(*block, "grp").agg(F.count_if("__hit").alias("len"), F.max("breaks").alias("breaks"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*block).agg(
        F.max("len").alias("max_run"), F.coalesce(F.max(F.when(F.col("grp") == 0, F.col("len"))), F.lit(0)).alias("prefix"),
        F.coalesce(F.max(F.when(F.col("grp") == F.col("breaks"), F.col("len"))), F.lit(0)).alias("suffix"),
        F.sum("n").alias("eligible"), (F.max("breaks") == 0).alias("all_missed"))


def drought(requests: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """Longest gap between consecutive completions in accounting order; ``ordered`` is false when finishes go back
    or the clock changes or is unknown."""
    done = F.col("status") == "ok"
    at = F.struct(*order)
    first = F.when(done & F.col("finish_ns").isNotNull(), F.struct(at.alias("at"), F.col("clock_domain").alias("clock"), F.col("finish_ns").alias("f")))
    s = scan(requests, block, order,
             last_any=("last_before", F.col("finish_ns")), first_done=("total_min", first))
    s = materialize(s, "drought")
    d = scan(s.where(done), block, order, last_done=("lag", F.col("finish_ns")))
    back = F.col("finish_ns") < F.col("last_any")
    wrong_clock = F.col("clock_domain").isNull() | ~F.col("clock_domain").eqNullSafe(F.col("first_done.clock"))
    gaps = d.groupBy(*block).agg(F.greatest(F.lit(0), F.max(F.col("finish_ns") - F.col("last_done"))).cast("long").alias("max_gap"),
                                 F.max_by("finish_ns", at).alias("last_finish"),
                                 F.max(F.col("first_done.f")).alias("first_finish"), F.max(F.col("first_done.clock")).alias("clock"))
    flags = s.groupBy(*block).agg((F.count_if(back) + F.count_if(done & wrong_clock) == 0).alias("ordered"))
    return join_on(flags, gaps, block, "left").select(*block, F.coalesce("max_gap", F.lit(0)).alias("max_gap"), "ordered", "first_finish", "last_finish", "clock")


def merge_blocks(summaries: DataFrame, keys: list[str], order: str, thresholds: list[str] = ()) -> DataFrame:
    """Merge adjacent block summaries (eligible, max_run, prefix, suffix, all_missed, first_finish, last_finish, max_gap,
    clock, ordered) in block order: runs and gaps across the seams come from scans over the small summary rows."""
    n = F.col("eligible")
    not_all = ~F.col("all_missed")
    has = F.col("first_finish").isNotNull()
    a = scan(materialize(summaries, "blocks"), keys, [order], before=("sum_before", n), total=("total_sum", n),
             last_seen=("last_before", F.col("last_finish")),
             first=("total_min", F.when(has, F.struct(F.col(order).alias("o"), F.col("clock").alias("clock")))))
    b = scan(materialize(a, "seams"), keys, [order], open_from=("last_before", F.when(not_all, F.col("before") + n - F.col("suffix"))))
    seam = F.col("before") + F.col("prefix") - F.coalesce("open_from", F.lit(0))
    fits = F.col("first.clock").isNotNull() & (F.col("clock") == F.col("first.clock")) & (F.col("first_finish") >= F.col("last_seen"))
    joined = has & F.col("last_seen").isNotNull()
    return b.groupBy(*keys).agg(
        F.greatest(F.max("max_run"), F.max(seam)).alias("max_run"),
        F.coalesce(F.min(F.when(not_all, F.col("before") + F.col("prefix"))), F.max("total")).alias("prefix"),
        (F.max("total") - F.coalesce(F.max(F.when(not_all, F.col("before") + n - F.col("suffix"))), F.lit(0))).alias("suffix"),
        F.bool_and("all_missed").alias("all_missed"),
        F.greatest(F.max("max_gap"), F.coalesce(F.max(F.when(joined & fits, F.col("first_finish") - F.col("last_seen"))), F.lit(0))).alias("max_gap"),
        F.coalesce(F.bool_and(F.when(has, F.col("ordered") & (~joined | F.coalesce(fits, F.lit(False))))), F.lit(True)).alias("ordered"),
        *[F.sum(t).alias(t) for t in thresholds])


def rate_bounds(pop: DataFrame, keys: list[str]) -> DataFrame:
    """Deadline-miss rate of summed counts: lower takes unknown as met, upper as missed."""
    g = pop.groupBy(*keys).agg(F.sum("eligible").alias("eligible"), F.sum("missed").alias("missed"),
                               F.sum("unknown_deadline").alias("unknown_deadline"))
    ok = F.col("eligible") > 0
    return g.withColumn("rate_lo", F.when(ok, F.col("missed") / F.col("eligible"))).withColumn(
        "rate_hi", F.when(ok, (F.col("missed") + F.col("unknown_deadline")) / F.col("eligible")))


def rate_change(pop: DataFrame, keys: list[str], context: list[str]) -> DataFrame:
    """Change bounds current − reference per key, null unless every block has the same known comparable context."""
    r = rate_bounds(pop, [*keys, "arm"])
    ctx = F.struct(*context)
    whole = None
    for c in context:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    sup = pop.groupBy(*keys).agg((F.min(ctx).eqNullSafe(F.max(ctx)) & F.bool_and(whole)
                                  & (F.min("arm") == "current") & (F.max("arm") == "reference")).alias("supported"))
    def arm(name, c):
        return F.max(F.when(F.col("arm") == name, F.col(c)))
    p = r.groupBy(*keys).agg(arm("reference", "rate_lo").alias("ref_lo"), arm("reference", "rate_hi").alias("ref_hi"),
                             arm("current", "rate_lo").alias("cur_lo"), arm("current", "rate_hi").alias("cur_hi"))
    s = F.col("supported")
    return join_on(p, sup, keys).select(*keys, "supported", F.when(s, F.col("cur_lo") - F.col("ref_hi")).alias("change_lo"),
                                        F.when(s, F.col("cur_hi") - F.col("ref_lo")).alias("change_hi"))


def phase_summary(requests: DataFrame, keys: list[str], fields: list[str], attempt: str) -> tuple[DataFrame, DataFrame]:
    """(counts per key, stats per key and field); fields use completed rows only, the attempt field all rows."""
    ok = F.col("status") == "ok"
    counts = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("completed"),
                                         F.count_if(~ok).alias("errors"))
    wide = requests.select(*keys, F.col(attempt).cast("double").alias("attempt_total"),
                           *[F.when(ok, F.col(f).cast("double")).alias(f"f_{f}") for f in fields])
    wide = wide.toDF(*keys, "attempt_total", *fields)
    long = wide.unpivot(keys, ["attempt_total", *fields], "field", "value")
    return counts, latency_stats(long, [*keys, "field"], "value")


STATS = ("p50", "mad", "p95", "p99", "tail95", "tail99")


def phase_delta(incident: DataFrame, healthy: DataFrame, keys: list[str]) -> DataFrame:
    """Metric-wise incident − healthy per field; null when either side has no value."""
    a = incident.unpivot([*keys, "field"], list(STATS), "metric", "value").withColumnRenamed("value", "inc")
    b = healthy.unpivot([*keys, "field"], list(STATS), "metric", "value")
    return join_on(a, b, [*keys, "field", "metric"], "full").withColumn("delta", F.col("inc") - F.col("value")).drop("inc", "value")


def check_run_config(a: DataFrame, b: DataFrame, on: list[str], settings: list[str]) -> DataFrame:
    """Pairs of runs with the list of settings that differ; an empty list means comparable."""
    r = b.select(*on, *[F.col(s).alias(f"__b_{s}") for s in settings])
    diff = F.array_compact(F.array(*[F.when(~F.col(s).eqNullSafe(F.col(f"__b_{s}")), F.lit(s)) for s in settings]))
    return a.join(r, on).withColumn("mismatch", F.concat_ws(",", diff)).drop(*[f"__b_{s}" for s in settings])


def case_headlines(requests: DataFrame) -> DataFrame:
    """Per case and arm: counts and p50/p95 of total, server and device time, with the tail-shift flag per case.
    The flag: incident p95 − healthy p95 above both 20 units and 20 %."""
    keys = ["case", "arm"]
    m = missed()
    ok = F.col("status") == "ok"
    counts = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"),
                                         F.count_if(m).alias("misses"), F.count_if(m.isNull()).alias("unknown"))
    long = requests.where(ok).unpivot(keys, ["total", "server", "cuda"], "field", "value")
    st = latency_stats(long, [*keys, "field"], "value")
    wide = st.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col(q))).alias(f"{f}_{q}")
                                   for f in ("total", "server", "cuda") for q in ("p50", "p95")])
    both = wide.groupBy("case").agg(F.max(F.when(F.col("arm") == "reference", F.col("total_p95"))).alias("__h"),
                                    F.max(F.when(F.col("arm") == "current", F.col("total_p95"))).alias("__i"))
    shift = (F.col("__i") - F.col("__h") > F.greatest(F.lit(20.0), 0.2 * F.col("__h"))) & (F.col("__h") != 0)
    return join_on(join_on(counts, wide, keys, "left"), both.select("case", F.coalesce(shift, F.lit(False)).alias("tail_shift")), ["case"], "left")


def regression_blocks(pop: DataFrame, margin: float = 0.05) -> DataFrame:
    """Per case: incident blocks, those whose lower miss rate clears the case's healthy upper rate, and controls."""
    h = rate_bounds(pop.where("arm = 'reference'"), ["case"]).select("case", F.col("rate_hi").alias("healthy_hi"))
    b = join_on(pop, h, ["case"], "left")
    inc = F.col("arm") == "current"
    lo = F.col("missed") / F.col("eligible")
    return b.groupBy("case").agg(F.count_if(inc).alias("incidents"), F.count_if(~inc).alias("controls"),
                                 F.count_if(inc & (lo - F.col("healthy_hi") > margin)).alias("clear"))


def timing_verdict(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pass when the median is within 5 % and p95 within 10 %; p99 is informational."""
    a = latency_stats(base, keys, value).select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("p50", "p95", "p99")])
    b = latency_stats(other, keys, value).select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("p50", "p95", "p99")])
    def rel(c):
        return F.try_divide(F.col(f"b_{c}"), F.col(f"a_{c}")) - 1
    j = join_on(a, b, keys)
    return j.select(*keys, rel("p50").alias("median_change"), rel("p95").alias("p95_change"), rel("p99").alias("p99_change"),
                    ((F.abs(rel("p50")) <= 0.05) & (F.abs(rel("p95")) <= 0.10)).alias("pass"))


def compare_outputs(a: DataFrame, b: DataFrame, key: str, digest: str, mean: str) -> DataFrame:
    """Identical and diverged outputs of the frames both runs have, and the largest mean difference."""
    r = b.select(F.col(key), F.col(digest).alias("__d"), F.col(mean).alias("__m"))
    j = a.join(r, key)
    same = F.col(digest).eqNullSafe(F.col("__d"))
    return j.agg(F.count(F.lit(1)).alias("frames"), F.count_if(same).alias("identical"), F.count_if(~same).alias("diverged"),
                 F.max(F.abs(F.col(mean) - F.col("__m"))).alias("max_mean_diff"))


def overhead_summary(samples: DataFrame, ticks: int = 20, min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """(mean and jitter deltas per name and rate, least-perturbing useful rate per name)."""
    on = F.col("collector_on")
    def m(flag, fn):
        return fn(F.when(on if flag else ~on, F.col("value")))
    d = samples.groupBy("name", "rate").agg((m(True, F.avg) - m(False, F.avg)).alias("d_mean"),
                                            (m(True, F.stddev_pop) - m(False, F.stddev_pop)).alias("d_jitter"))
    useful = d.where(F.col("rate") * ticks >= min_samples).where("d_mean is not null")
    best = useful.groupBy("name").agg(F.min_by("rate", F.struct("d_mean", "rate")).alias("best_rate"))
    return d, best


def operations_summary(log: DataFrame) -> DataFrame:
    """Per id: attempts, outcomes, elapsed time and the latest failure with its reason."""
    fail = F.col("outcome") == "failure"
    at = F.when(fail, F.struct("ended_at", "seq"))
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "success").alias("successes"),
                                 F.count_if(fail).alias("failures"), F.sum("elapsed").alias("elapsed"),
                                 F.max(F.when(fail, F.col("ended_at"))).alias("last_failure"), F.max_by("reason", at).alias("last_reason"))


def sample_blocks(requests: DataFrame, block: list[str], k: int, seed: str) -> DataFrame:
    """Uniform k rows per block with their inclusion probability: the k smallest seeded hashes.

    Each task keeps k candidates per block before the final cut, so a huge block is never gathered."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("request_id").cast("string")))
    d = requests.withColumn("__h", h)
    size = d.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("__salt", F.substring("__h", -2, 2))
    local = d.withColumn("__r", F.row_number().over(Window.partitionBy(*block, "__salt").orderBy("__h"))).where(F.col("__r") <= k)
    top = local.withColumn("__r", F.row_number().over(Window.partitionBy(*block).orderBy("__h"))).where(F.col("__r") <= k)
    return join_on(top, size, block).withColumn("inclusion_probability", F.least(F.lit(1.0), F.lit(float(k)) / F.col("n"))).drop("__h", "__r", "__salt", "n")
