"""Robust incident-versus-healthy comparison."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import Z_CANDIDATE, robust_z
from .ordered import join_on, scan
from .quantiles import counted_median_mad, counted_quantiles, median_mad, quantiles, recount, value_counts
from .spans import all_stages, kernels
from .storage import materialize


def matched_z(inc: DataFrame, base: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per key (must include ``stage``): medians on both sides, delta and z against the baseline's spread."""
    return matched_z_of(quantiles(inc, keys, value, {"inc_med": (0.5, "linear")}), median_mad(base, keys, value), keys)


def matched_z_of(inc: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """The same from medians: ``inc`` with inc_med and n, ``base`` with med, mad and n."""
    m = base.select(*keys, F.col("n").alias("n_base"), F.col("med").alias("base_med"), F.col("mad").alias("base_mad"))
    return (inc.withColumnRenamed("n", "n_inc").join(m, keys)
            .withColumn("delta", F.col("inc_med") - F.col("base_med"))
            .withColumn("z", robust_z(F.col("stage"), F.col("inc_med"), F.col("base_med"), F.col("base_mad"))))


def stage_winner(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per stage the group with the highest (z, delta); ties go to the first name."""
    best = F.min_by(F.struct("name", "z", "delta"), F.struct(-F.col("z"), -F.col("delta"), "name"))
    return groups.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def rank_stages(surfaces: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rank stages by z, then delta, then name. A group holds one row per stage, so it is small."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc("z"), F.desc("delta"), "stage")
    return surfaces.withColumn("rank", F.row_number().over(w))


def distributional_z(inc: DataFrame, base: DataFrame, min_n: int = 5) -> DataFrame:
    """(run_id, stage, z, delta, …) of each incident run against the pooled baseline values.

    Stages are pooled, except gpu: matched per kernel name with ``min_n`` samples on both sides, pooled again
    when no name qualifies. An empty side counts as 0. Names seen only in the incident are counted, not scored."""
    ci = materialize(value_counts(inc, ["run_id", "stage", "name"], "value"), "inc-counts")
    cb = materialize(value_counts(base, ["stage", "name"], "value"), "base-counts")
    med = {"inc_med": (0.5, "linear")}
    runs = ci.select("run_id").distinct()
    pb = counted_median_mad(recount(cb, ["stage"]), ["stage"]).withColumnRenamed("n", "n_base")
    pi = counted_quantiles(recount(ci, ["run_id", "stage"]), ["run_id", "stage"], med).withColumnRenamed("n", "n_inc")
    zero = F.lit(0.0)
    pooled = (all_stages(runs).join(pi, ["run_id", "stage"], "left").join(pb, "stage", "left")
              .select("run_id", "stage", F.coalesce("n_inc", F.lit(0)).alias("n_inc"), F.coalesce("n_base", F.lit(0)).alias("n_base"),
                      F.coalesce("inc_med", zero).alias("inc_med"), F.coalesce("med", zero).alias("base_med"),
                      F.coalesce("mad", zero).alias("base_mad"))
              .withColumn("delta", F.col("inc_med") - F.col("base_med"))
              .withColumn("z", robust_z(F.col("stage"), F.col("inc_med"), F.col("base_med"), F.col("base_mad"))))
    nb = counted_median_mad(cb.where("stage = 'gpu'"), ["stage", "name"]).withColumnRenamed("n", "n_base")
    ni = counted_quantiles(ci.where("stage = 'gpu'"), ["run_id", "stage", "name"], med).withColumnRenamed("n", "n_inc")
    named = ni.join(nb, ["stage", "name"], "left")
    ok = (F.col("n_base") >= min_n) & (F.col("n_inc") >= min_n)
    delta = F.col("inc_med") - F.col("med")
    z = robust_z(F.col("stage"), F.col("inc_med"), F.col("med"), F.col("mad"))
    gpu = named.groupBy("run_id", "stage").agg(
        F.max(F.when(ok, F.struct(z.alias("z"), delta.alias("delta")))).alias("best"),
        F.count_if(ok).alias("matched_names"),
        F.count_if(F.col("n_base").isNull()).alias("incident_only_names"),
        F.sum(F.when(F.col("n_base").isNull(), F.col("n_inc")).otherwise(0)).alias("incident_only_records"))
    use = F.col("best").isNotNull()
    return pooled.join(gpu, ["run_id", "stage"], "left").select(
        "run_id", "stage", F.when(use, F.col("best.z")).otherwise(F.col("z")).alias("z"),
        F.when(use, F.col("best.delta")).otherwise(F.col("delta")).alias("delta"), "n_inc", "n_base",
        F.when(use, F.col("matched_names")).alias("matched_names"),
        F.when(use, F.col("incident_only_names")).alias("incident_only_names"),
        F.when(use, F.col("incident_only_records")).alias("incident_only_records"))


def unknown_mass(surfaces: DataFrame, keys: list[str]) -> DataFrame:
    z = F.col("z")
    return surfaces.groupBy(*keys).agg(
        (1.0 / (1.0 + F.sum(F.greatest(F.lit(0.0), z - Z_CANDIDATE)))).alias("unknown_mass"),
        F.count_if(z > Z_CANDIDATE).alias("candidates"), F.count_if(F.abs(z) <= Z_CANDIDATE).alias("contradicting"))


def run_span(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: wall span in ms and nearest-rank kernel p99 in ms (0 without kernels)."""
    span = spans.groupBy(*keys).agg(((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("span_ms"))
    p99 = quantiles(kernels(spans).withColumn("ms", F.col("dur_ns") / 1e6), keys, "ms", {"p99_ms": (0.99, "nearest")})
    return join_on(span, p99.drop("n"), keys, "left").withColumn("p99_ms", F.coalesce("p99_ms", F.lit(0.0)))


def span_regression(inc_spans: DataFrame, base_spans: DataFrame) -> DataFrame:
    """Each incident run's span and kernel p99 minus the medians over the baseline runs."""
    base = run_span(base_spans, ["run_id"]).withColumn("g", F.lit(1))
    med = {c: quantiles(base, [], c, {"m": (0.5, "linear")}).select("m").scalar() for c in ("span_ms", "p99_ms")}
    return run_span(inc_spans, ["run_id"]).select(
        "run_id", "span_ms", "p99_ms", (F.col("span_ms") - med["span_ms"]).alias("span_delta_ms"),
        (F.col("p99_ms") - med["p99_ms"]).alias("p99_delta_ms"))


def novel_ops(inc: DataFrame, base: DataFrame, watched: list[str]) -> DataFrame:
    """Per incident run: rows whose exact name is watched; flagged only when no baseline row has such a name."""
    hit = F.col("name").isin(watched)
    seen = base.agg(F.count_if(hit).alias("c")).scalar()
    n = inc.groupBy("run_id").agg(F.count_if(hit).alias("n_ops"))
    return n.withColumn("stage", F.when((F.col("n_ops") > 0) & (seen == 0), F.lit("gpu")))


# Exact op names whose new appearance means a changed memory layout.
LAYOUT_OPS = ["aten::transpose", "aten::permute", "aten::t"]


def sequence_context(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, n_ops, c1, c2): two independent 64-bit fingerprints of each run's ordered names; no list is collected."""
    s = scan(rows, [key], [order], pos=("sum", F.lit(1)))
    return s.groupBy(key).agg(F.count(F.lit(1)).alias("n_ops"),
                              F.bit_xor(F.xxhash64("pos", name)).alias("c1"),
                              F.sum(F.xxhash64(F.lit("second"), name, "pos").cast("decimal(20,0)")).alias("c2"))


def check_comparable(inc: DataFrame, base: DataFrame, ctx: list[str]) -> tuple[DataFrame, DataFrame]:
    """(comparable, refused) incident rows: a row is comparable only if a baseline has the same context columns."""
    have = base.select(*ctx).distinct()
    return join_on(inc, have, ctx, "left_semi"), join_on(inc, have, ctx, "left_anti")


def sensitivity(base: DataFrame, steps: int = 63) -> DataFrame:
    """Smallest factor 1 + 7i/64 whose scaled copy of a stage scores z > 2 against the stage itself.

    Scaling a stage by f scales its median by f, so the grid is applied to one median per stage; the whole-number
    rule of queue depths is monotone and is applied to the two middle values."""
    counts = materialize(value_counts(base, ["stage"], "value"), "stage-counts")
    mm = counted_median_mad(counts, ["stage"])
    mids = counted_quantiles(counts, ["stage"], {"lo": (0.5, "lower"), "hi": (0.5, "upper")}).drop("n")
    grid = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i")
    g = mm.join(mids, "stage").select("*", grid).withColumn("f", 1.0 + 7.0 * F.col("i") / 64.0)
    def scaled(c):
        return F.when(F.col("stage") == "queue", F.greatest(F.lit(1.0), F.bround(F.col(c) * F.col("f")))).otherwise(F.col(c) * F.col("f"))
    z = robust_z(F.col("stage"), (scaled("lo") + scaled("hi")) / 2.0, F.col("med"), F.col("mad"))
    return g.groupBy("stage").agg(F.min(F.when(z > Z_CANDIDATE, F.col("f"))).alias("trip_factor"))

