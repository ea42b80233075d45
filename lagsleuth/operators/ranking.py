"""Calibrated scores, incident memory, measurement choice. Small models travel as literal columns, never as shared state."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import STAGES
from . import nearest
from .ordered import join_on
from .quantiles import counted_quantiles, value_counts
from .storage import materialize

C = F.col
# Weight of each voice in the fused ranking.
VOICE_WEIGHTS = {"matched": 3.0, "structural": 3.0, "xcorr": 1.0, "gls": 1.0, "enet": 1.0, "perm": 1.0, "ebm": 1.0, "lgbm": 1.0}
# Voices in order, their cost, and the decision thresholds.
VOICE_COST = {"matched": 1.0, "structural": 1.0, "gls": 2.0, "enet": 2.0, "perm": 2.0, "xcorr": 1.0}
ERROR_COST, COMMIT_P, COMMIT_MARGIN, SET_MARGIN, VETO_Z, VETO_SHARE = 10.0, 0.99, 0.05, 0.15, 5.0, 0.15
T_BOUNDS = (0.05, 20.0)


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalise_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positive part of each stage score divided by its sum; uniform over the stages when nothing is positive."""
    pos = F.greatest(F.lit(0.0), C("score"))
    t = F.sum(pos).over(Window.partitionBy(*keys))
    return scores.withColumn("score", F.when(t > 0, pos / t).otherwise(F.lit(1.0 / len(STAGES))))


def fuse_voices(scores: DataFrame, multipliers: DataFrame, key: str) -> DataFrame:
    """Weighted mean of the voices present × stage multiplier, ranked by (−score, stage)."""
    w = _map(VOICE_WEIGHTS)[C("voice")]
    g = scores.withColumn("w", w).where("w is not null").groupBy(key, "stage").agg((F.sum(C("w") * C("score")) / F.sum("w")).alias("s"))
    m = g.join(multipliers, [key, "stage"], "left").withColumn("score", C("s") * F.coalesce("multiplier", F.lit(1.0)))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "stage"))).select(key, "stage", "score", "rank")


def score_stages(incidents: DataFrame, key: str, weights: list[list[float]], bias: list[float], temperature: float, shift: list[float]) -> DataFrame:
    """(key, stage, p, rank): softmax((W·asinh(z) + b [+ tail on cpu]) / T + shift). Incidents: key, z array in stage order, tail."""
    n = range(len(STAGES))
    def logit(i):
        dot = F.lit(bias[i])
        for j, x in enumerate(weights[i]):
            if x:
                dot = dot + F.lit(x) * C(f"a{j}")
        return (dot + (F.coalesce("tail", F.lit(0.0)) if STAGES[i] == "cpu" else 0)) / temperature + shift[i]
    a = incidents.select(key, "tail", *[F.asinh(C("z")[j]).alias(f"a{j}") for j in n])
    l = a.select(key, *[logit(i).alias(f"l{i}") for i in n]).withColumn("m", F.greatest(*[f"l{i}" for i in n]))
    e = l.select(key, *[F.exp(C(f"l{i}") - C("m")).alias(f"e{i}") for i in n])
    total = sum((C(f"e{i}") for i in n), F.lit(0.0))
    rows = e.withColumn("t", total).select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), (C(f"e{i}") / C("t")).alias("p")) for i, s in enumerate(STAGES)])).alias("r"))
    long = rows.select(key, "r.stage", "r.p")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "stage")))


def temperature_curve(logits: DataFrame, grid: list[float]) -> DataFrame:
    """(t, nll): mean negative log likelihood of the true class at each temperature. Logits: l array, y (0-based class)."""
    d = logits.select("l", "y", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
    top = F.array_max("l")
    s = F.aggregate("l", F.lit(0.0), lambda a, v: a + F.exp((v - top) / C("t")))
    p = F.exp((F.element_at("l", C("y") + 1) - top) / C("t")) / s
    return d.groupBy("t").agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("nll"), F.count(F.lit(1)).alias("n"))


def fit_temperature(logits: DataFrame, points: int = 17, rounds: int = 5) -> DataFrame:
    """One T in [.05, 20] with the least nll: grid in log T, narrowed around the best point each round.
    Each round collects only its few grid rows."""
    lo, hi = (math.log(x) for x in T_BOUNDS)
    cached = materialize(logits.select("l", "y"), "logits")
    for _ in range(rounds):
        grid = [math.exp(lo + (hi - lo) * i / (points - 1)) for i in range(points)]
        best = temperature_curve(cached, grid).orderBy("nll", "t").first()
        step = (hi - lo) / (points - 1)
        at = math.log(best["t"])
        lo, hi = max(math.log(T_BOUNDS[0]), at - step), min(math.log(T_BOUNDS[1]), at + step)
    edge = best["t"] <= T_BOUNDS[0] * 1.05 or best["t"] >= T_BOUNDS[1] * 0.95
    return logits.sparkSession.createDataFrame([(best["t"], best["nll"], best["n"], edge)], "temperature double, nll double, n bigint, at_bound boolean")


def reliability(probs: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """(per-bin n, accuracy, confidence; overall ECE and multiclass Brier). Probs: p array, y (0-based). Bin 0 includes 0."""
    top = F.array_max("p")
    hit = (F.array_position("p", top) - 1 == C("y")).cast("double")
    b = F.greatest(F.lit(0), F.ceil(top * bins).cast("int") - 1)
    brier = F.aggregate(F.transform("p", lambda v, i: F.pow(v - F.when(i == C("y"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, v: a + v)
    d = probs.select(b.alias("bin"), hit.alias("hit"), top.alias("top"), brier.alias("brier"))
    g = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("acc"), F.avg("top").alias("conf"), F.sum("brier").alias("brier"))
    n = F.sum("n")
    return g.drop("brier"), g.agg((F.sum(C("n") * F.abs(C("acc") - C("conf"))) / n).alias("ece"), (F.sum("brier") / n).alias("brier"))


def conformal_threshold(calibration: DataFrame, level: float) -> Column:
    """Scalar q: the ceil((n+1)·level)-th smallest score 1 − p(true); null when there are too few rows (every class stays)."""
    s = calibration.select((1 - F.element_at("p", C("y") + 1)).alias("s"))
    q = counted_quantiles(value_counts(s, [], "s"), [], {"q": (level, "conformal")})
    return q.select("q").scalar()


def conformal_sets(rows: DataFrame, key: str, calibration: DataFrame, level: float) -> DataFrame:
    """(key, stage index) members with p ≥ 1 − q."""
    q = conformal_threshold(calibration, level)
    return rows.select(key, F.posexplode("p").alias("member", "p")).where(q.isNull() | (F.round("p", 12) >= F.round(1 - q, 12)))


def plausible(scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(members and vetoed stages, decision per key). Scores: key, stage, score, z, rank, p, trusted.

    Members lie within .15 of the top; a stage without support beside a large z is vetoed, never the top one.
    A composite is named when the two best are close and both supported; commit needs p ≥ .99 and margin ≥ .05."""
    w = Window.partitionBy(key)
    s = scores.withColumn("top", F.max(F.when(C("rank") == 1, C("score"))).over(w)).withColumn("mz", F.max("z").over(w))
    veto = (C("mz") >= VETO_Z) & (C("z") <= VETO_SHARE * C("mz"))
    s = s.withColumn("veto", veto)
    m = s.where(C("top") - C("score") <= SET_MARGIN).select(key, "stage", F.when((C("rank") > 1) & C("veto"), "vetoed").otherwise("member").alias("status"))
    def at(r, c):
        return F.max(F.when(C("rank") == r, C(c)))
    d = s.groupBy(key).agg(at(1, "stage").alias("top1"), at(2, "stage").alias("top2"), at(1, "score").alias("s1"), at(2, "score").alias("s2"), at(1, "veto").alias("v1"), at(2, "veto").alias("v2"), at(1, "p").alias("p"), F.bool_and("trusted").alias("trusted"))
    close = (C("s1") - C("s2") < SET_MARGIN) & ~C("v1") & ~C("v2")
    commit = C("trusted") & (C("p") >= COMMIT_P) & (C("s1") - C("s2") >= COMMIT_MARGIN)
    return m, d.select(key, "top1", (C("s1") - C("s2")).alias("margin"), F.when(close, F.concat_ws("+", "top1", "top2")).alias("composite"), commit.alias("commit"))


def measurement_value(accuracy: DataFrame, belief: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Net value of each unrevealed voice: accuracy·(1−q)·10 − cost, ranked by (−value, cost, name). accuracy: voice, acc (six rows);
    belief: key, q; taken: key, voice."""
    acc = accuracy.agg(F.map_from_entries(F.collect_list(F.struct("voice", "acc"))).alias("m")).scalar()
    v = belief.select(key, "q", F.explode(_map(VOICE_COST)).alias("voice", "cost"))
    v = join_on(v, taken, [key, "voice"], "left_anti")
    v = v.withColumn("value", acc[C("voice")] * (1 - C("q")) * ERROR_COST - C("cost"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "cost", "voice")))


# ---- measurement choice -------------------------------------------------------------------------------------------

# Group, prerequisites and read signals of each measurement.
ACTION_GROUP = {"timeline": "host", "scheduler_trace": "host", "kernel_timeline": "device", "counters": "device", "tensor_analysis": "deep", "deep_profile": "deep"}
ACTION_NEEDS = {"timeline": (), "scheduler_trace": (), "kernel_timeline": (), "counters": (), "tensor_analysis": ("counters",), "deep_profile": ("kernel_timeline",)}
ACTION_SIGNALS = {"timeline": ("cpu_gap",), "scheduler_trace": ("blocked_ns", "serialized"), "kernel_timeline": ("dur_ns",), "counters": ("sm_util_pct", "mem_bw_util_pct", "tensor_active_pct"),
                  "tensor_analysis": ("tensor_active_pct",), "deep_profile": ("stall_hist",)}


def likelihoods(counts: DataFrame) -> DataFrame:
    """(action, cause, outcome, like): Laplace-smoothed outcome frequencies."""
    w = Window.partitionBy("action", "cause")
    return counts.withColumn("like", (C("n") + 1.0) / (F.sum("n").over(w) + F.count(F.lit(1)).over(w)))


def fold_unknown(beliefs: DataFrame, key: str, causes: DataFrame) -> DataFrame:
    """(key, cause, prior, unknown): UNKNOWN mass spread evenly, then renormalised. causes: cause (the modelled ones)."""
    unk = beliefs.groupBy(key).agg(F.coalesce(F.sum(F.when(C("cause") == "UNKNOWN", C("mass"))), F.lit(0.0)).alias("unknown"))
    names = causes.agg(F.sort_array(F.collect_set("cause")).alias("a")).scalar()
    g = unk.select(key, "unknown", F.explode(names).alias("cause"), F.size(names).alias("n_causes")).join(beliefs, [key, "cause"], "left")
    m = F.coalesce("mass", F.lit(0.0)) + C("unknown") / C("n_causes")
    t = F.sum(m).over(Window.partitionBy(key))
    return g.select(key, "cause", "unknown", F.when(t > 0, m / t).otherwise(0.0).alias("prior"))


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def information_gain(beliefs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, action, eig, reliability). Work per incident is causes × outcomes, both small fixed vocabularies."""
    like = likelihoods(counts)
    pr = fold_unknown(beliefs, key, counts.select("cause"))
    j = pr.join(like, "cause").withColumn("joint", C("prior") * C("like"))
    o = j.groupBy(key, "action", "outcome").agg(F.sum("joint").alias("po"), F.sum(_plogp(C("joint"))).alias("hj"))
    # H(post) summed over outcomes with weight p(o) equals H(joint) - H(outcome)
    a = o.groupBy(key, "action").agg(F.sum("hj").alias("hj"), F.sum(_plogp(C("po"))).alias("ho"))
    h = pr.groupBy(key).agg(F.sum(_plogp(C("prior"))).alias("h0"))
    rel = like.groupBy("action", "cause").agg(F.max("like").alias("m")).groupBy("action").agg(F.avg("m").alias("reliability"))
    return a.join(h, key).join(rel, "action").select(key, "action", F.greatest(F.lit(0.0), C("h0") - (C("hj") - C("ho"))).alias("eig"), "reliability")


def rank_measurements(gains: DataFrame, taken: DataFrame, costs: dict[str, float], setup: dict[str, float], key: str) -> DataFrame:
    """Score = eig·reliability·redundancy / cost for every measurement, ranked by (−score, cost, name).

    Redundancy halves per taken measurement that reads a shared signal and is 0 for a repeat; a group's set-up cost is paid once;
    a measurement without its prerequisite scores 0. taken: key, actions array."""
    t = gains.join(taken, key, "left").withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))
    overlap = {a: [b for b in ACTION_SIGNALS if b != a and set(ACTION_SIGNALS[a]) & set(ACTION_SIGNALS[b])] for a in ACTION_SIGNALS}
    mates = {a: [b for b in ACTION_GROUP if ACTION_GROUP[b] == ACTION_GROUP[a]] for a in ACTION_GROUP}
    def has(names):
        return [F.when(F.array_contains("actions", n), 1).otherwise(0) for n in names]
    red, cost, ok = None, None, None
    for a in ACTION_GROUP:
        is_a = C("action") == a
        k = F.lit(0)
        for x in has(overlap[a]):
            k = k + x
        r = F.when(F.array_contains("actions", a), 0.0).otherwise(F.pow(F.lit(0.5), k))
        paid = F.arrays_overlap("actions", F.array(*[F.lit(m) for m in mates[a]]))
        c = F.greatest(F.lit(costs[a]) + F.when(paid, 0.0).otherwise(F.lit(setup[ACTION_GROUP[a]])), F.lit(1e-6))
        g = F.lit(True)
        for n in ACTION_NEEDS[a]:
            g = g & F.array_contains("actions", n)
        red, cost, ok = (F.when(is_a, x) if y is None else y.when(is_a, x) for x, y in ((r, red), (c, cost), (g, ok)))
    s = t.withColumns({"redundancy": red, "cost": cost, "admissible": ok})
    s = s.withColumn("score", F.when(C("admissible"), C("eig") * C("reliability") * C("redundancy") / C("cost")).otherwise(0.0))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 12)), "cost", "action"))).drop("actions")


def update_beliefs(beliefs: DataFrame, counts: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, cause, mass) after each incident's observed outcome (key, action, outcome); unknown mass is carried, not spent."""
    known = beliefs.where("cause <> 'UNKNOWN'")
    unk = beliefs.groupBy(key).agg(F.coalesce(F.sum(F.when(C("cause") == "UNKNOWN", C("mass"))), F.lit(0.0)).alias("unk"))
    pr = fold_unknown(known, key, counts.select("cause")).join(seen, key).join(likelihoods(counts).drop("n"), ["action", "outcome", "cause"])
    p = C("prior") * C("like")
    t = F.sum(p).over(Window.partitionBy(key, "action"))
    post = pr.withColumn("post", F.when(t > 0, p / t).otherwise(0.0)).join(unk, key)
    out = post.select(key, "action", "cause", (C("post") * (1 - C("unk"))).alias("mass"))
    return out.unionByName(post.select(key, "action", F.lit("UNKNOWN").alias("cause"), C("unk").alias("mass")).distinct())


def eig_backtest(beliefs: DataFrame, counts: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(predicted and realised gain per key and action, Spearman per key with ties by position). seen: key, action, outcome."""
    pred = information_gain(beliefs, counts, key).select(key, "action", C("eig").alias("predicted"))
    causes = counts.select("cause")
    h0 = fold_unknown(beliefs, key, causes).groupBy(key).agg(F.sum(_plogp(C("prior"))).alias("h0"))
    post = update_beliefs(beliefs, counts, seen, key).withColumn("grp", F.concat_ws("\u0001", C(key).cast("string"), "action"))
    p = fold_unknown(post.select("grp", "cause", "mass"), "grp", causes).groupBy("grp").agg(F.sum(_plogp(C("prior"))).alias("h1"))
    real = post.select(key, "action", "grp").distinct().join(p, "grp").join(h0, key).select(key, "action", F.greatest(F.lit(0.0), C("h0") - C("h1")).alias("realised"))
    r = pred.join(real, [key, "action"])
    rx = F.row_number().over(Window.partitionBy(key).orderBy(F.round("predicted", 12), "pos"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("predicted", 12)), "action"))
    ranked = r.withColumn("pos", pos).withColumn("rx", rx).withColumn("ry", F.row_number().over(Window.partitionBy(key).orderBy(F.round("realised", 12), "pos")))
    n = F.count(F.lit(1))
    rho = ranked.groupBy(key).agg(F.when(n > 1, F.corr(C("rx").cast("double"), C("ry").cast("double"))).otherwise(1.0).alias("spearman"),
                                  F.max_by("action", -C("pos")).alias("pred_best"), F.max_by("action", F.struct(F.round("realised", 12), "action")).alias("real_best"))
    return r, rho


# ---- incident memory ----------------------------------------------------------------------------------------------

# Weights of structure, text and graph, and inside structure.
W_STRUCT, W_TEXT, W_GRAPH, W_VERSION, W_KERNELS, W_SYMPTOMS = 0.5, 0.3, 0.2, 0.4, 0.3, 0.3
RECALL_THRESHOLD, SHRINK = 0.20, 2.0


def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two columns, alike for equal values; nulls are -1."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    got = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False)
    return got[: len(a)], got[len(a) :]


class Incident:
    """Version, kernel-set and symptom agreement, and the same regressed stage, of queries and stored incidents.

    Two missing versions are alike, missing stages are not; a missing or zero symptom vector and an empty kernel set agree with nothing."""

    schema = "structured double, graph double, tier string, cause string"

    def parts(self, queries: pa.Table, docs: pa.Table):
        (qv, dv), (qs, ds) = codes(queries["version"], docs["version"]), codes(queries["stage"], docs["stage"])
        qk, dk = ([set(x or ()) for x in t["kernels"].to_pylist()] for t in (queries, docs))
        name = {n: i for i, n in enumerate(set().union(*qk))}
        hot = []
        for sets in (qk, dk):
            m = np.zeros((len(sets), len(name)))
            for i, x in enumerate(sets):
                m[i, [name[n] for n in x if n in name]] = 1.0
            hot.append((m, np.array([len(x) for x in sets], float)))
        unit = []
        for t in (queries, docs):
            z = np.array([(list(x or ()) + [None] * len(STAGES))[: len(STAGES)] for x in t["z"].to_pylist()], float).reshape(-1, len(STAGES))
            n = np.sqrt(np.square(z).sum(axis=1))
            unit.append(np.where((n > 0)[:, None], z, 0.0) / np.where(n > 0, n, 1.0)[:, None])
        return (qv, dv), (qs, ds), hot, unit

    def agree(self, version, inter, union, cos):
        return W_VERSION * version + W_KERNELS * np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0) + W_SYMPTOMS * np.maximum(0.0, cos)

    def __call__(self, queries: pa.Table, docs: pa.Table):
        (qv, dv), (qs, ds), ((qm, qn), (dm, dn)), (qz, dz) = self.parts(queries, docs)

        def scores(first, number):
            d = slice(first, first + number)
            inter = dm[d] @ qm.T
            s = self.agree(dv[d, None] == qv, inter, dn[d, None] + qn - inter, dz[d] @ qz.T)
            return W_STRUCT * s + W_GRAPH * ((ds[d, None] == qs) & (qs >= 0))

        return scores

    def out(self, queries: pa.Table, docs: pa.Table, q: np.ndarray, d: np.ndarray):
        if not len(q):
            return {"structured": pa.nulls(0, pa.float64()), "graph": pa.nulls(0, pa.float64()), "tier": pa.nulls(0, pa.string()), "cause": pa.nulls(0, pa.string())}
        (qv, dv), (qs, ds), ((qm, qn), (dm, dn)), (qz, dz) = self.parts(queries, docs)
        inter = (dm[d] * qm[q]).sum(axis=1)
        s = self.agree(dv[d] == qv[q], inter, dn[d] + qn[q] - inter, (dz[d] * qz[q]).sum(axis=1))
        return {"structured": s, "graph": ((ds[d] == qs[q]) & (qs[q] >= 0)).astype(float), "tier": docs["tier"].take(d), "cause": docs["cause"].take(d)}


def retrieve(queries: DataFrame, store: DataFrame, k: int = 3, query_block: int = nearest.QUERY_BLOCK, store_block: int = nearest.STORE_BLOCK) -> DataFrame:
    """The k best stored incidents per query: (qid, id, score, structured, semantic, graph, cause, rank).

    queries: qid, text, version, kernels, z, stage; store: id, text, version, kernels, z, stage, tier, cause, retracted.
    Retracted rows are never ranked; only VERIFIED rows may lend their cause. See ``nearest`` for the tiles of queries and store."""
    live = store.where("not retracted").select("id", "text", "version", "kernels", "z", "stage", "tier", "cause")
    found = nearest.k_best(queries.select("qid", "text", "version", "kernels", "z", "stage"), live, k, W_TEXT, Incident(), False, query_block, store_block)
    return found.select("qid", "id", "score", "structured", "semantic", "graph", F.when(C("tier") == "VERIFIED", C("cause")).alias("cause"), "rank")


def difference_card(hits: DataFrame, queries: DataFrame, store: DataFrame) -> DataFrame:
    """Per hit: stages that match, differ or are unknown on both sides, and the transfer risk."""
    q = queries.select("qid", C("z").alias("qz"), C("kernels").alias("qk"), C("version").alias("qv"), C("stage").alias("qs"))
    s = store.select("id", C("z").alias("sz"), C("kernels").alias("sk"), C("version").alias("sv"), C("stage").alias("ss"), "tier")
    j = hits.join(q, "qid").join(s, "id")
    names = F.array(*[F.lit(x) for x in STAGES])
    row = F.zip_with(names, F.zip_with("qz", "sz", lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda n, v: F.struct(n.alias("s"), v["a"].alias("a"), v["b"].alias("b")))
    def close(v):
        return F.abs(v["a"] - v["b"]) <= F.greatest(F.lit(1.0), 0.25 * F.greatest(F.abs(v["a"]), F.abs(v["b"])))
    def pick(cond):
        return F.transform(F.filter("row", cond), lambda v: v["s"])
    j = j.withColumn("row", row).withColumns({
        "matches": pick(lambda v: close(v) & (F.abs(v["b"]) > 2)), "mismatches": pick(lambda v: ~close(v)), "unknowns": pick(lambda v: (F.abs(v["a"]) <= 2) & (F.abs(v["b"]) <= 2))})
    other = (F.size(F.array_except("qk", "sk")) > 0) | (F.size(F.array_except("sk", "qk")) > 0)
    mism = F.concat("mismatches", F.when(other, F.array(F.lit("kernels"))).otherwise(F.array().cast("array<string>")), F.when(~C("qv").eqNullSafe(C("sv")), F.array(F.lit("timing"))).otherwise(F.array().cast("array<string>")))
    low = (C("tier") == "VERIFIED") & (F.size("all_mismatches") == 0) & (C("qs") == C("ss"))
    return j.withColumn("all_mismatches", mism).select("qid", "id", "matches", C("all_mismatches").alias("mismatches"), "unknowns", F.when(low, "low").otherwise("high").alias("risk"))


def shrunk_priors(hits: DataFrame, interventions: DataFrame) -> DataFrame:
    """Measured effects of a stored incident's interventions (id, intervention, measured, support) shrunk toward 0."""
    f = C("support") / (C("support") + SHRINK) * (0.5 + 0.5 * C("structured"))
    return hits.join(interventions, "id").withColumn("factor", f).withColumn("shrunk", C("measured") * C("factor"))


def recall_rules(queries: DataFrame, hits: DataFrame, version: str, store: DataFrame) -> DataFrame:
    """(qid, path, cause, fix): two version-scoped rules first, then the best retrieved incident at or above .20, else UNKNOWN.
    queries also carry serialized (boolean) and d (delta array)."""
    sched, gpu = STAGES.index("scheduler"), STAGES.index("gpu")
    best = F.array_max(F.transform("z", lambda z, i: F.struct(z.alias("z"), C("d")[i].alias("d"), (-i).alias("i"))))
    mine = C("version") == version
    rule1 = mine & C("serialized") & (C("z")[sched] > 2)
    rule2 = mine & ~C("serialized") & (best["i"] == -gpu) & (C("z")[gpu] > 2)
    top = hits.where("rank = 1").join(store.select("id", "tier", "fix"), "id").select("qid", "score", C("cause").alias("h_cause"), F.when(C("tier") == "VERIFIED", C("fix")).alias("h_fix"))
    j = queries.withColumns({"r1": rule1, "r2": rule2}).join(top, "qid", "left")
    found = C("score") >= RECALL_THRESHOLD
    def pick(a, b, c, d):
        return F.when(C("r1"), a).when(C("r2"), b).when(found, c).otherwise(d)
    return j.select("qid", pick(F.lit("rule:serialized-sync-v1"), F.lit("rule:kernel-regression-v1"), F.lit("retrieval"), F.lit("fallthrough")).alias("path"),
                    pick(F.lit("sync_serialization"), F.lit("kernel_regression"), C("h_cause"), F.lit("UNKNOWN")).alias("cause"),
                    pick(F.lit("remove_competing"), F.lit("revert_kernel_config"), F.coalesce("h_fix", F.lit("")), F.lit("")).alias("fix"))


def incident_records(surfaces: DataFrame, hypotheses: DataFrame, experiments: DataFrame, retractions: DataFrame, key: str) -> DataFrame:
    """One memory row per incident: symptom map, strongest claim by tier (the latest of equals), best measured fix, retraction.

    surfaces: key, stage, z, delta; hypotheses: key, seq, cause, status; experiments: key, intervention, predicted, measured;
    retractions: key. Incidents without a hypothesis have no record."""
    sym = surfaces.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.struct("z", "delta").alias("v"))))).alias("symptoms"),
                                    F.min_by("stage", F.struct(-C("z"), -C("delta"), C("stage"))).alias("top_stage"))
    tier = F.when(C("status") == "VERIFIED", 2).when(C("status") == "TESTED", 1).otherwise(0)
    h = hypotheses.groupBy(key).agg(F.max_by(F.struct("cause", "status"), F.struct(tier, "seq")).alias("c"))
    done = experiments.where("measured is not null")
    e = done.groupBy(key).agg(F.max_by(F.struct("intervention", "measured", "predicted"), F.struct(C("measured"), C("intervention"))).alias("b"), F.count(F.lit(1)).alias("n_interventions"))
    r = retractions.select(key).distinct().withColumn("retracted", F.lit(True))
    j = h.join(sym, key, "left").join(e, key, "left").join(r, key, "left")
    rec = F.when(F.abs("b.predicted") > 1e-9, C("b.measured") / C("b.predicted")).otherwise(F.when(C("b").isNotNull(), 0.0))
    return j.select(key, C("c.cause").alias("cause"), C("c.status").alias("tier"), "symptoms", "top_stage", F.when(C("b.measured") > 0, C("b.intervention")).otherwise("").alias("fix"),
                    rec.alias("recovery"), F.coalesce("n_interventions", F.lit(0)).alias("n_interventions"), F.coalesce("retracted", F.lit(False)).alias("retracted"))
