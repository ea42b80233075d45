"""Per-run trace operators: launch gaps, concurrency, stage values, signatures.

Spans: run_id, kind, cid (correlation id), name, stream_id, start_ns, end_ns, dur_ns, and ``event_id`` as the record order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import STAGES, kernel_short_name
from .ordered import scan
from .storage import materialize


def host(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("kind") == "cpu_launch")


def kernels(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("kind") == "gpu_kernel")


def fill_derived(spans: DataFrame) -> DataFrame:
    """Fill kernel_name, blocked_ns and timing_version only where they are missing.
    Needs columns kernel_name, blocked_ns, timing_version, hardware, collector (nullable)."""
    dur = F.coalesce("blocked_ns", "dur_ns", F.col("end_ns") - F.col("start_ns"), F.lit(0))
    unknown = F.coalesce(F.nullif(F.col("timing_version"), F.lit("")), F.lit("unknown"))
    made = F.concat_ws("-", F.lit("kineto"), F.coalesce("hardware", F.lit("unknown")),
                       F.coalesce("collector", F.lit("unknown")))
    return (spans
            .withColumn("kernel_name", F.when(F.col("kind") == "gpu_kernel",
                        F.coalesce(F.nullif(F.col("kernel_name"), F.lit("")), kernel_short_name(F.col("name")), F.lit("UNKNOWN"))))
            .withColumn("blocked_ns", F.when(F.col("kind") == "sync_edge", dur))
            .withColumn("timing_version", F.when(unknown == "unknown", made).otherwise(unknown)))


def launch_gaps(spans: DataFrame, launch_name: str = "cudaLaunchKernel") -> DataFrame:
    """Each kernel with ``launch_gap_ns``: its start minus the latest end, not after that start, of a host row of the
    same id. Launch rows are preferred when the id has any; no such row gives 0. Rows without an id match nothing."""
    is_launch = F.col("name") == launch_name
    h = host(spans).where(F.coalesce("cid", F.lit("")) != "").select(
        "run_id", "cid", F.col("end_ns").alias("at"), F.lit(0).alias("k"), F.col("event_id").alias("eid"),
        is_launch.alias("launch"))
    g = kernels(spans).select("run_id", "cid", F.col("start_ns").alias("at"), F.lit(1).alias("k"),
                              F.col("event_id").alias("eid"), F.lit(False).alias("launch"),
                              F.struct(*[c for c in spans.columns if c not in ("run_id", "cid")]).alias("row"))
    s = scan(h.unionByName(g, allowMissingColumns=True), ["run_id", "cid"], ["at", "k", "eid"],
             any_end=("last_before", F.when(F.col("k") == 0, F.col("at"))),
             launch_end=("last_before", F.when(F.col("launch"), F.col("at"))),
             has_launch=("total_max", F.when(F.col("launch"), 1)))
    end = F.when(F.col("has_launch") == 1, F.col("launch_end")).otherwise(F.col("any_end"))
    gap = F.coalesce(F.greatest(F.lit(0), F.col("at") - end), F.lit(0))
    out = s.where("k = 1").select("run_id", "cid", "row.*", gap.cast("long").alias("__gap"))
    if "launch_gap_ns" in spans.columns:
        return out.withColumn("launch_gap_ns", F.coalesce("launch_gap_ns", "__gap")).drop("__gap")
    return out.withColumnRenamed("__gap", "launch_gap_ns")


def concurrency(spans: DataFrame) -> DataFrame:
    """Per kernel: kernels and distinct streams live at its start, and the run's stream count (queue depth).
    A kernel is live in [start, end); zero-length kernels never count."""
    g = kernels(spans).select("run_id", "event_id", "stream_id", "start_ns", "end_ns")
    real = g.where("end_ns > start_ns")
    edges = real.select("run_id", "stream_id", "event_id", F.explode(F.array(
        F.struct(F.col("start_ns").alias("at"), F.lit(1).alias("d")),
        F.struct(F.col("end_ns").alias("at"), F.lit(-1).alias("d")))).alias("e")
        ).select("run_id", "stream_id", "event_id", "e.at", "e.d")
    per = scan(edges.where("stream_id is not null"), ["run_id", "stream_id"], ["at", "d", "event_id"], now=("sum", F.col("d")))
    flips = materialize(per.select("run_id", "at", F.when((F.col("now") == 1) & (F.col("d") == 1), 1)
                                   .when(F.col("now") == 0, -1).alias("sd")).where("sd is not null"), "stream-flips")
    streams = (g.where("stream_id is not null").groupBy("run_id", "stream_id").agg(F.min("start_ns").alias("at"))
               .select("run_id", "at", F.lit(1).alias("q")))
    asks = g.select("run_id", F.col("start_ns").alias("at"), "event_id", "start_ns", "end_ns", F.lit(1).alias("ask"))
    rows = (edges.select("run_id", "at", "d").unionByName(flips, True).unionByName(streams, True).unionByName(asks, True)
            .withColumn("ask", F.coalesce("ask", F.lit(0))).withColumn("event_id", F.coalesce("event_id", F.lit(-1))))
    s = scan(rows, ["run_id"], ["at", "ask", "event_id"], live=("sum", F.coalesce("d", F.lit(0))),
             live_streams=("sum", F.coalesce("sd", F.lit(0))), depth=("total_sum", F.coalesce("q", F.lit(0))))
    one = F.lit(1).cast("long")
    return s.where("ask = 1").select(
        "run_id", "event_id", F.col("end_ns").alias("ts_ns"), F.greatest(one, "depth").alias("queue_depth"),
        F.col("live").alias("active_kernels"), F.greatest(one, "live_streams").alias("active_streams"))


def host_gaps(spans: DataFrame, clamp: bool = True) -> DataFrame:
    """Gap in ms from each host row's end to the next start of the run."""
    s = scan(host(spans), ["run_id"], ["start_ns", "end_ns", "event_id"], next_start=("lead", F.col("start_ns")))
    gap = (F.col("next_start") - F.col("end_ns")) / 1e6
    return (s.where("next_start is not null")
            .select("run_id", "event_id", "name", (F.greatest(F.lit(0.0), gap) if clamp else gap).alias("gap_ms")))


def stage_values(spans: DataFrame, launch_name: str = "cudaLaunchKernel") -> DataFrame:
    """Long (run_id, stage, name, value): every measurement of a run filed under its stage."""
    def pick(df, stage, value, name=F.lit("pooled")):
        return df.select("run_id", F.lit(stage).alias("stage"), name.alias("name"), value.cast("double").alias("value"))
    h = host(spans)
    ms = lambda c: F.col(c) / 1e6
    sync = spans.where(F.col("kind") == "sync_edge")
    parts = [
        pick(spans.where(F.col("kind") == "transfer"), "transport", ms("dur_ns")),
        pick(h, "preprocess", (F.col("end_ns") - F.col("start_ns")) / 1e6),
        pick(concurrency(spans), "queue", F.col("queue_depth")),
        pick(host_gaps(spans), "cpu", F.col("gap_ms")),
        pick(launch_gaps(spans, launch_name), "scheduler", ms("launch_gap_ns")),
        pick(sync, "scheduler", ms("dur_ns")),
        pick(kernels(spans), "gpu", ms("dur_ns"), F.col("name")),
        h.select("run_id", F.explode(F.array(F.lit("postprocess"), F.lit("action"))).alias("stage"),
                 F.lit("pooled").alias("name"), F.lit(0.0).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tail_fraction(values: DataFrame, keys: list[str], threshold: float = 1.0) -> DataFrame:
    return values.groupBy(*keys).agg(F.count("value").alias("n"),
                                     F.avg(F.when(F.col("value") > threshold, 1.0).otherwise(0.0)).alias("tail"))


def backlog_slope(spans: DataFrame) -> DataFrame:
    """Per run: slope of launch-to-start delay (ms) over op index, and how many kernels start before their host row.
    One row per (run, id, kind): the last record wins."""
    def last(df, col):
        return df.groupBy("run_id", "cid").agg(F.max_by(col, "event_id").alias(col))
    pair = last(host(spans), "start_ns").withColumnRenamed("start_ns", "host_start").join(
        last(kernels(spans), "start_ns"), ["run_id", "cid"])
    s = scan(pair, ["run_id"], ["host_start", "cid"], rank=("sum", F.lit(1)))
    delay = (F.col("start_ns") - F.col("host_start")) / 1e6
    return s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(delay, (F.col("rank") - 1).cast("double")).alias("slope"),
                                   F.count_if(delay < 0).alias("violations"))


def signature(spans: DataFrame) -> DataFrame:
    """One row of means and counts per run; host gap is start to start."""
    h = scan(host(spans), ["run_id"], ["start_ns", "event_id"], next_start=("lead", F.col("start_ns")))
    gaps = h.groupBy("run_id").agg(F.avg(F.col("next_start") - F.col("start_ns")).alias("host_gap"))
    lg = launch_gaps(spans).groupBy("run_id").agg(F.avg("launch_gap_ns").alias("launch_gap"))
    depth = kernels(spans).groupBy("run_id", "stream_id").agg(F.lit(1)).groupBy("run_id").agg(
        F.count("stream_id").alias("streams"))
    def mean(kind, c):
        return F.avg(F.when(F.col("kind") == kind, c))
    base = spans.groupBy("run_id").agg(
        mean("cpu_launch", F.col("dur_ns")).alias("cpu_dur"), mean("gpu_kernel", F.col("dur_ns")).alias("kernel_dur"),
        mean("sync_edge", F.col("dur_ns")).alias("blocked"), mean("transfer", F.col("k") * 1024).alias("bytes"),
        F.count_if(F.col("kind") == "gpu_kernel").alias("kernels"),
        F.max(F.when((F.col("kind") == "sync_edge") & (F.col("k") % 2 == 0), 1).otherwise(0)).alias("serialized"))
    return base.join(gaps, "run_id", "left").join(lg, "run_id", "left").join(depth, "run_id", "left")


SIGNATURE_METRICS = ("host_gap", "cpu_dur", "launch_gap", "kernel_dur", "blocked", "bytes", "streams", "kernels", "serialized")


def unpivot_metrics(sig: DataFrame, keys: list[str], metrics=SIGNATURE_METRICS) -> DataFrame:
    return sig.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def signature_diff(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Metrics that differ between ``run_id`` and ``healthy_id`` of each pair."""
    long = unpivot_metrics(sig, ["run_id"])
    a = pairs.join(long, "run_id").withColumnRenamed("value", "run_value")
    b = long.select(F.col("run_id").alias("healthy_id"), "metric", F.col("value").alias("healthy_value"))
    return a.join(b, ["healthy_id", "metric"]).where(~F.col("run_value").eqNullSafe(F.col("healthy_value")))


def perturb(values: DataFrame, stage: str, factor) -> DataFrame:
    """Scale one stage's values; queue depths stay whole and at least 1."""
    f = factor if not isinstance(factor, (int, float)) else F.lit(float(factor))
    scaled = F.when(F.col("stage") == "queue", F.greatest(F.lit(1.0), F.bround(F.col("value") * f))).otherwise(F.col("value") * f)
    return values.withColumn("value", F.when(F.col("stage") == stage, scaled).otherwise(F.col("value")))


def all_stages(runs: DataFrame) -> DataFrame:
    return runs.select("*", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
