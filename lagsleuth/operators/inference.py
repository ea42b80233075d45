"""Block comparisons, randomisation tests, stratified and paired contrasts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ordered import join_on
from .storage import materialize


def block_compare(blocks: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """Weighted means of bounded block outcomes with Hoeffding radii, per key.

    Blocks: key, arm ('reference' | 'current'), unit, lo, hi (outcome bounds in [0, 1]), weight, start, regime.
    Contracts: key, alpha, threshold, selection, frozen_at, dependence, basis, regime, look.
    A regression needs the lower bound above the threshold; the first failing condition is the reason."""
    def arm(name, agg, c):
        return agg(F.when(F.col("arm") == name, c))
    w = F.col("weight")
    g = join_on(blocks, contracts.select(key, "frozen_at", F.col("regime").alias("c_regime")), [key]).groupBy(key).agg(
        *[arm(a, F.sum, w * F.col(b)).alias(f"{a[:3]}_{b}") for a in ("reference", "current") for b in ("lo", "hi")],
        *[arm(a, F.sum, w * w).alias(f"{a[:3]}_w2") for a in ("reference", "current")],
        *[arm(a, F.count, F.lit(1)).alias(f"{a[:3]}_n") for a in ("reference", "current")],
        *[arm(a, F.sum, w).alias(f"{a[:3]}_w") for a in ("reference", "current")],
        F.count_if(w.isNull()).alias("no_weight"), arm("current", F.count_if, F.col("start") <= F.col("frozen_at")).alias("reused"),
        F.count_if(~F.col("regime").eqNullSafe(F.col("c_regime"))).alias("other_regime"),
        (F.count(F.lit(1)) - F.count_distinct("unit")).alias("overlap"))
    j = join_on(contracts, g, [key], "left")
    alpha = F.col("alpha") / (F.col("look") * (F.col("look") + 1))
    def radius(a):
        return F.least(F.lit(1.0), F.sqrt(F.ln(F.lit(4.0) / alpha) * F.col(f"{a}_w2") / 2.0))
    lo = F.greatest(F.lit(0.0), F.col("cur_lo") - radius("cur")) - F.least(F.lit(1.0), F.col("ref_hi") + radius("ref"))
    hi = F.least(F.lit(1.0), F.col("cur_hi") + radius("cur")) - F.greatest(F.lit(0.0), F.col("ref_lo") - radius("ref"))
    weak = "insufficient statistical resolution"
    unusable = (F.col("no_weight") > 0) | (F.abs(F.col("ref_w") - 1) > 1e-9) | (F.abs(F.col("cur_w") - 1) > 1e-9)
    empty = F.coalesce(F.least("ref_n", "cur_n"), F.lit(0)) == 0
    refusal = (F.when(empty, weak)
               .when(unusable, "frozen sample sizes/weights unavailable")
               .when(F.col("selection") != "confirmatory", "exploratory selection cannot confirm itself")
               .when(F.col("reused") > 0, "confirmation reused selection data")
               .when((F.col("dependence") != "independent_blocks") | (F.coalesce("basis", F.lit("")) == ""), weak)
               .when(F.col("other_regime") > 0, "regime changed")
               .when(F.col("overlap") > 0, "replication units overlap"))
    done = refusal.isNull()
    seen = ~empty & ~unusable
    return j.select(
        key, alpha.alias("spent_alpha"),
        F.when(seen, F.col("cur_lo") - F.col("ref_hi")).alias("observed_lo"), F.when(seen, F.col("cur_hi") - F.col("ref_lo")).alias("observed_hi"),
        F.when(done, lo).alias("lo"), F.when(done, hi).alias("hi"), (done & (lo > F.col("threshold"))).alias("regression"),
        F.coalesce(refusal, F.when(lo > F.col("threshold"), "material regression").otherwise("material change not established")).alias("reason"))


EXACT_PAIRS = 16


# Multipliers that spread a pair's and a draw's number over 61 bits, and the bit that is a sign.
SPREAD_DRAW, SPREAD, SIGN_BIT = 1442695040888963407, 2862933555777941757, 40


def draw_sums(rows: DataFrame, key: str, draws: int) -> DataFrame:
    """(key, n, effect, extreme): in how many draws the mean with random signs reaches the effect. rows: key, d, base, n, effect."""
    key_type = to_arrow_type(rows.schema[key].dataType)
    step = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(SPREAD_DRAW)

    def signed(base, d):
        bit = ((np.uint64(base) ^ step) * np.uint64(SPREAD)) >> np.uint64(SIGN_BIT) & np.uint64(1)
        return np.where(bit == 0, d, -d)

    def summed(batches, vector):
        sums: dict = {}
        for b in batches:
            for k, n, effect, *x in zip(*(c.to_pylist() for c in b.columns)):
                sums.setdefault(k, (n, effect, np.zeros(draws)))[2][:] += vector(*x)
        return sums

    def batch(found, last, last_type):
        cols = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, pa.int64(), pa.float64(), last_type))], names=[key, "n", "effect", last])

    def partial(batches):
        yield batch([(k, n, e, v.tobytes()) for k, (n, e, v) in summed(batches, signed).items()], "sums", pa.binary())

    def total(batches):
        found = summed(batches, lambda v: np.frombuffer(v)).items()
        yield batch([(k, n, e, int((v / n >= e - 1e-12).sum())) for k, (n, e, v) in found], "extreme", pa.int64())

    head = f"`{key}` {rows.schema[key].dataType.simpleString()}, n bigint, effect double"
    sent = rows.select(key, "n", "effect", "base", "d").mapInArrow(partial, f"{head}, sums binary")
    return sent.repartition(key).mapInArrow(total, f"{head}, extreme bigint")


def paired_randomization(pairs: DataFrame, key: str, draws: int = 10000, seed: str = "0", exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """Sign-flip test of the mean of control − treatment. Pairs: key, pair, control, treatment.

    Keys with at most ``exact_pairs`` pairs enumerate all 2^n sign vectors; larger ones use ``draws`` seeded draws with a Hoeffding
    error bound: each task keeps one vector of all draws for a key, and one row for a key and task is shuffled. The sign of a pair in a draw
    is a bit of a product of two numbers, from md5 of seed and pair and from the draw. Only the exact keys gather their pairs, at most ``exact_pairs`` values."""
    d = materialize(pairs.select(key, "pair", (F.col("control") - F.col("treatment")).alias("d")), "pairs")
    stat = d.groupBy(key).agg(F.count("d").alias("n"), F.avg("d").alias("effect"))
    small = d.join(stat.where(F.col("n") <= exact_pairs), key).groupBy(key).agg(
        F.sort_array(F.collect_list("d")).alias("ds"), F.max("n").alias("n"), F.max("effect").alias("effect"))
    mask = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("n")).cast("long") - 1)).alias("mask")
    bit = F.expr("aggregate(transform(ds, (x, i) -> if(shiftright(mask, i) % 2 = 1, x, -x)), 0d, (a, x) -> a + x)")
    exact = (small.select(key, "ds", "n", "effect", mask).groupBy(key, "n", "effect")
             .agg(F.count(F.lit(1)).alias("assignments"), F.count_if(bit / F.col("n") >= F.col("effect") - 1e-12).alias("extreme"))
             .select(key, "n", "effect", (F.col("extreme") / F.col("assignments")).alias("p_value"), "assignments", F.lit(0.0).alias("error_bound"), F.lit("exact").alias("method")))
    big = d.join(stat.where(F.col("n") > exact_pairs), key)
    base = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("pair").cast("string"))), 1, 15), 16, 10).cast("long")
    sums = draw_sums(big.where("d is not null").select(key, "d", base.alias("base"), "n", "effect"), key, draws)
    bound = F.sqrt(F.ln(F.lit(40.0)) / (2.0 * draws))
    mc = sums.select(key, "n", "effect", ((F.col("extreme") + 1) / F.lit(draws + 1)).alias("p_value"), F.lit(draws).cast("long").alias("assignments"), bound.alias("error_bound"), F.lit("monte carlo").alias("method"))
    return exact.unionByName(mc)


def paired_schedule(pairs: DataFrame, seed: str) -> DataFrame:
    """(pair, position, arm): both arms of every pair once, in hashed order."""
    first = F.md5(F.concat_ws("|", F.lit(seed), F.col("pair").cast("string"), F.lit("control"))) < F.md5(
        F.concat_ws("|", F.lit(seed), F.col("pair").cast("string"), F.lit("treatment")))
    order = F.when(first, F.array(F.lit("control"), F.lit("treatment"))).otherwise(F.array(F.lit("treatment"), F.lit("control")))
    return pairs.select("pair", F.posexplode(order).alias("position", "arm"))


def stratified_change(rows: DataFrame, key: str, strata: list[str]) -> DataFrame:
    """Per key and stratum: means per arm, change, and whether the stratum is supported (known, present in both arms)."""
    known = F.lit(True)
    for s in strata:
        known = known & F.col(s).isNotNull()
    def arm(a, f):
        return f(F.when(F.col("arm") == a, F.col("value")))
    g = rows.groupBy(key, *strata).agg(arm("reference", F.avg).alias("ref"), arm("current", F.avg).alias("cur"),
                                       F.count_if(F.col("arm") == "reference").alias("n_ref"), F.count_if(F.col("arm") == "current").alias("n_cur"))
    ok = known & (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    return g.withColumn("supported", ok).withColumn("change", F.when(ok, F.col("cur") - F.col("ref")))


def stratified_summary(strata_rows: DataFrame, key: str, strata: list[str], weights: DataFrame, rows: DataFrame) -> DataFrame:
    """Excluded fraction of current rows, total change, and the change standardised to target weights
    (key, strata, weight): null unless the weights sum to 1 and every weighted stratum is supported."""
    g = strata_rows.groupBy(key).agg(F.sum("n_cur").alias("n_cur"), F.sum(F.when(F.col("supported"), F.col("n_cur")).otherwise(0)).alias("kept"),
                                     F.count_if(~F.col("supported")).alias("unsupported"))
    tot = rows.groupBy(key).agg((F.avg(F.when(F.col("arm") == "current", F.col("value"))) - F.avg(F.when(F.col("arm") == "reference", F.col("value")))).alias("total_change"))
    w = join_on(weights, strata_rows.select(key, *strata, "supported", "change"), [key, *strata], "left").groupBy(key).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("change")).alias("std"), F.bool_and(F.coalesce("supported", F.lit(False))).alias("all"))
    std = F.when((F.abs(F.col("w") - 1) <= 1e-9) & F.col("all"), F.col("std"))
    return join_on(join_on(g, tot, [key]), w, [key], "left").select(
        key, "unsupported", F.when(F.col("n_cur") > 0, 1 - F.col("kept") / F.col("n_cur")).alias("excluded_fraction"), "total_change", std.alias("standardized_change"))


def joint_outcomes(pairs: DataFrame, keys: list[str], x: str, y: str, threshold: float) -> DataFrame:
    both = (F.col(x) > threshold) & (F.col(y) > threshold)
    return pairs.groupBy(*keys).agg(F.avg(F.when(both, 1.0).otherwise(0.0)).alias("simultaneous_exceedance"), F.avg(F.greatest(x, y)).alias("completion_mean"))


def diff_in_diff(rows: DataFrame, keys: list[str], assumptions: Column) -> DataFrame:
    """(treated after − before) − (control after − before); null if one of the four populations is empty.
    Without evidence for every assumption it is an observational association."""
    def m(t, a):
        return F.avg(F.when((F.col("treated") == t) & (F.col("after") == a), F.col("value")))
    g = rows.groupBy(*keys).agg(((m(True, True) - m(True, False)) - (m(False, True) - m(False, False))).alias("effect"), F.bool_and(assumptions).alias("__ok"))
    return g.select(*keys, "effect", F.when(F.col("__ok"), "qualified natural contrast").otherwise("observational association").alias("interpretation"))


def directional_effects(before: DataFrame, after: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Means before and after a fix (key, metric, value); ``expected``: metric, direction. Each must move strictly that way."""
    a = after.select(key, "metric", F.col("value").alias("after"))
    j = before.withColumnRenamed("value", "before").join(a, [key, "metric"]).join(expected, "metric")
    hold = F.when(F.col("direction") == "down", F.col("after") < F.col("before")).otherwise(F.col("after") > F.col("before"))
    return j.withColumn("hold", F.coalesce(hold, F.lit(False)))


def experiment_status(experiments: DataFrame) -> DataFrame:
    """VERIFIED when the measured gain is positive, at least half the prediction, and all expected effects hold; else TESTED.
    A prediction of zero gives recovery 0."""
    m, p = F.col("measured"), F.col("predicted")
    rec = F.when(m.isNotNull() & (F.abs(p) > 1e-9), m / p).otherwise(0.0)
    ok = (m > 0) & (rec >= 0.5) & F.coalesce("effects_hold", F.lit(True))
    return experiments.withColumn("recovery", rec).withColumn("status", F.when(ok, "VERIFIED").otherwise("TESTED"))


def restoration_check(assignments: DataFrame, readbacks: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """Per key: every manipulation read back as set, performed in the scheduled order, and restored afterwards.
    assignments: key, seq, arm, setting, restored; readbacks: key, seq, observed; schedule: key, seq, arm."""
    s = schedule.select(key, "seq", F.col("arm").alias("planned"))
    j = join_on(join_on(assignments, readbacks, [key, "seq"], "left"), s, [key, "seq"], "full")
    false = F.lit(False)
    return j.groupBy(key).agg(
        F.bool_and(F.coalesce(F.col("setting") == F.col("observed"), false)).alias("readback_ok"),
        F.bool_and(F.coalesce(F.col("arm") == F.col("planned"), false)).alias("order_ok"),
        F.bool_and(F.coalesce("restored", false)).alias("restored")).withColumn(
        "usable", F.col("readback_ok") & F.col("order_ok") & F.col("restored"))


def tied_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average ranks. Meant for short vectors (one row per stage and group)."""
    w = Window.partitionBy(*keys).orderBy(value)
    tie = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0)


def profile_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Spearman (averaged ties) and cosine of two mean-z profiles (key, stage, z)."""
    j = a.join(b.select(key, "stage", F.col("z").alias("z2")), [key, "stage"])
    r = tied_ranks(tied_ranks(j, [key], "z", "r1"), [key], "z2", "r2")
    rho = F.corr("r1", "r2")
    return r.groupBy(key).agg(F.when(rho.isNull() | F.isnan(rho), 0.0).otherwise(rho).alias("spearman"),
                              F.try_divide(F.sum(F.col("z") * F.col("z2")), F.sqrt(F.sum(F.col("z") * F.col("z"))) * F.sqrt(F.sum(F.col("z2") * F.col("z2")))).alias("cosine"))


def dose_response(points: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """Slope of the response over the dose, and overlap of its range with the observed range; (key, dose, response)."""
    g = points.groupBy(key).agg(F.regr_slope(F.col("response"), F.col("dose")).alias("slope"), F.min("response").alias("lo"), F.max("response").alias("hi"))
    o = real.groupBy(key).agg(F.min("response").alias("r_lo"), F.max("response").alias("r_hi"), F.avg("response").alias("r_mean"))
    return g.join(o, key).select(key, "slope", ((F.col("slope") > 0) == (F.col("r_mean") > 1)).alias("sign_match"),
                                 ((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi"))).alias("overlap"))


def stall_attribution(regions: DataFrame, key: str, ns_per_sample: int = 1000, max_samples: int = 1 << 31) -> tuple[DataFrame, DataFrame]:
    """Rank suspect regions of each incident by duration excess plus 1000 ns per extra stall sample.

    Regions: key, region, dur, base_dur, seed, base_seed, samples, stalls map<string,bigint>, base_stalls (null = not sampled).
    Returns (scored regions, verdict per key). Gates: 1–3 suspects, same seed, matched pair, sample budget, some excess."""
    sampled = F.col("stalls").isNotNull() & F.col("base_stalls").isNotNull()
    diff = F.map_zip_with("stalls", "base_stalls", lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    total = F.aggregate(F.map_values(F.col("delta")), F.lit(0).cast("long"), lambda s, v: s + v)
    r = (regions.withColumn("sampled", sampled).withColumn("delta", F.when(sampled, diff)).withColumn("stall_delta", F.coalesce(total, F.lit(0)))
         .withColumn("dur_excess", F.col("dur") - F.col("base_dur")).withColumn("score", F.col("dur_excess") + ns_per_sample * F.col("stall_delta")))
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("suspects"), F.count_if(F.col("base_dur").isNull()).alias("unpaired"),
                           F.count_if(F.col("seed").isNotNull() & ~F.col("seed").eqNullSafe(F.col("base_seed"))).alias("reseeded"),
                           F.sum(F.coalesce("samples", F.lit(0))).alias("cost"), F.max(F.greatest("dur_excess", "stall_delta")).alias("excess"),
                           F.max_by(F.struct("region", "sampled", "score"), F.struct("score", "region")).alias("top"), F.max("score").alias("best"),
                           F.count_if(F.col("sampled")).alias("n_sampled"))
    ties = r.join(g.select(key, "best"), key).where("score = best").groupBy(key).agg(F.count(F.lit(1)).alias("ties"))
    cls = (r.where("sampled").select(key, F.explode("delta").alias("cls", "n")).groupBy(key, "cls").agg(F.sum("n").alias("n"))
           .groupBy(key).agg(F.max_by("cls", F.struct("n", "cls")).alias("stall_class")))
    refusal = (F.when((F.col("suspects") < 1) | (F.col("suspects") > 3), "suspect set size").when(F.col("reseeded") > 0, "seeds differ")
               .when(F.col("unpaired") > 0, "no matched pair").when(F.col("cost") > max_samples, "sample budget").when(F.col("excess") <= 0, "no excess")
               .when(F.col("n_sampled") == 0, "no samples"))
    v = g.join(ties, key).join(cls, key, "left").withColumn("refusal", refusal)
    ok = F.col("refusal").isNull()
    return r, v.select(key, "refusal", F.when(ok, F.col("top.region")).alias("winner"), F.when(ok, F.col("stall_class")).alias("stall_class"),
                       (ok & (F.col("best") > 0) & (F.col("ties") == 1) & F.col("top.sampled")).alias("sufficient"))


def lineage_diff(a: DataFrame, b: DataFrame, keys: list[str], ident: str, order: str, fields: list[str]) -> DataFrame:
    """Per run the earliest op (record order of ``a``) present in both whose listed fields differ."""
    r = b.select(*keys, ident, *[F.col(f).alias(f"__{f}") for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"__{f}"))
    j = join_on(a, r, [*keys, ident]).where(differs)
    return j.groupBy(*keys).agg(F.min_by(F.struct(ident, order, *fields), order).alias("s")).select(*keys, "s.*")


def lineage_join(ids: DataFrame, lineage: DataFrame, keys: list[str], known: dict[str, float]) -> DataFrame:
    """Op and first module per id, with confidence .9 for a known op, .5 for another, 0 without lineage."""
    conf = F.when(F.col("op").isNull() & F.col("modules").isNull(), 0.0)
    for op, c in known.items():
        conf = conf.when(F.col("op") == op, c)
    j = ids.join(lineage, keys, "full")
    return j.select(*keys, "op", F.try_element_at("modules", F.lit(1)).alias("module"), conf.otherwise(0.5).alias("confidence"))


def first_divergence(a: DataFrame, b: DataFrame, key: str, stages: list[str], fields: list[str]) -> DataFrame:
    """Per key the earliest (stage order, position) where two runs differ; absolute clocks must not be in ``fields``.
    Rows: key, stage, pos (0-based), ident, fields. A stage of unequal length reports ``length`` at the shorter length first."""
    def tag(df, t):
        return df.select(key, "stage", "pos", F.col("ident").alias(f"{t}_ident"), F.lit(1).alias(f"{t}_here"), *[F.col(f).alias(f"{t}_{f}") for f in fields])
    j = tag(a, "a").join(tag(b, "b"), [key, "stage", "pos"], "full")
    idx = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    lens = j.groupBy(key, "stage").agg(F.count("a_here").alias("na"), F.count("b_here").alias("nb"))
    short = lens.where("na <> nb").select(key, "stage", F.least("na", "nb").alias("pos"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("ident"), F.lit("length").alias("fields"))
    names = F.concat_ws(",", F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in sorted(fields)])))
    diff = (j.where("a_here = 1 and b_here = 1").select(key, "stage", "pos", F.col("pos").alias("kind"), F.coalesce("a_ident", "b_ident").cast("string").alias("ident"), names.alias("fields"))
            .where("fields <> ''"))
    both = short.unionByName(diff).withColumn("__o", F.struct(idx, F.col("kind")))
    return both.groupBy(key).agg(F.min_by(F.struct("stage", "pos", "ident", "fields"), "__o").alias("s")).select(key, "s.*")
