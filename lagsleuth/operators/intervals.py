"""Start/end pairing and other order-based operators over progress events.

Linked events: rid, relation, identity, clock, token (nullable), boundary, time, unit, uncertainty, complete,
limitations array<string>. One row per explicit link.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bounds
from .ordered import join_on, range_union, scan
from .storage import materialize

# Fixed values: (start boundary, end boundary, interval kind).
INTERVAL_KINDS = (("release", "submit", "dispatch_delay"), ("complete_readable", "consume", "consumption_delay"),
                  ("queue_enqueue", "queue_dequeue", "queue_sojourn"), ("switch_ingress", "switch_egress", "switch_residence"),
                  ("relay_ingress", "relay_release", "relay_residence"), ("eligible", "link_assign", "link_assignment_wait"),
                  ("link_assign", "access", "access_wait"), ("runnable", "running", "runnable_wait"))
PAIRED_RELATIONS = ("delivery", "connection", "resource", "thread")
# Boundaries that count as useful progress after a recovery.
USEFUL = ("delivery", "complete_readable", "consume")


def explode_links(events: DataFrame) -> DataFrame:
    """One row per explicit link that may pair; events carry ``links`` array<struct<relation,identity,certainty>>."""
    link = F.explode("links").alias("link")
    keep = (F.col("link.certainty") == "explicit") & F.col("link.relation").isin(*PAIRED_RELATIONS)
    rest = [c for c in events.columns if c != "links"]
    return events.select(*rest, link).where(keep).select(*rest, F.col("link.relation").alias("relation"), F.col("link.identity").alias("identity"))


def _roles(linked: DataFrame) -> DataFrame:
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(k).alias("kind")) for s, e, k in INTERVAL_KINDS])
    hit = F.filter(table, lambda t: (t["s"] == F.col("boundary")) | (t["e"] == F.col("boundary")))
    return (linked.select("*", F.explode(hit).alias("__t"))
            .select("*", F.col("__t.kind").alias("kind"), (F.col("__t.s") == F.col("boundary")).alias("is_start")).drop("__t"))


def pair_intervals(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, unmatched). An end pairs with the latest start since the previous end of its key
    (relation, identity, clock, token, kind); a replaced start is a duplicate and makes the pair ambiguous."""
    keys = ["relation", "identity", "clock", "token", "kind"]
    ev = F.struct("rid", "time", "unit", "uncertainty", "complete", "limitations")
    s = materialize(scan(_roles(linked), keys, ["time", "rid"], run=("sum_before", F.when(F.col("is_start"), 0).otherwise(1)),
                         prev=("lag", F.struct("is_start", "rid"))), "pairing")
    at, st = F.struct("time", "rid"), F.col("is_start")
    g = s.groupBy(*keys, "run").agg(F.count_if(st).alias("starts"), F.max_by(ev, F.when(st, at)).alias("a"),
                                    F.max_by(ev, F.when(~st, at)).alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = ~a["complete"] | ~b["complete"] | (F.col("starts") > 1)
    limits = F.array_union(F.array_sort(F.array_distinct(F.concat(a["limitations"], b["limitations"]))),
                           F.when(gap, F.array(F.lit("incomplete source coverage"))).otherwise(F.array().cast("array<string>")))
    d, u = b["time"] - a["time"], a["uncertainty"] + b["uncertainty"]
    pairs = g.where("starts > 0 and b is not null and a.unit = b.unit").select(
        *keys, a["unit"].alias("unit"), a["rid"].alias("start_rid"), b["rid"].alias("end_rid"), a["time"].alias("start"), b["time"].alias("end"),
        d.alias("duration"), F.when(d + u >= 0, bounds(d - u, d + u)).alias("duration_bounds"), limits.alias("limitations"))
    none = F.lit(None).cast(dict(s.dtypes)["rid"])
    orphan = g.where("starts = 0 and b is not null").select(*keys, none.alias("rid1"), b["rid"].alias("rid2"), F.lit("start outside retained view").alias("reason"))
    open_ = g.where("starts > 0 and b is null").select(*keys, a["rid"].alias("rid1"), none.alias("rid2"), F.lit("end outside retained view").alias("reason"))
    dup = s.where("is_start and prev.is_start").select(*keys, F.col("prev.rid").alias("rid1"), F.col("rid").alias("rid2"), F.lit("duplicate start identity").alias("reason"))
    return pairs, orphan.unionByName(open_).unionByName(dup)


def useful_after(linked: DataFrame) -> DataFrame:
    """Recovery rids with a later (or simultaneous) complete progress event of the same delivery, clock and unit."""
    d = linked.where("relation = 'delivery'")
    good = F.col("boundary").isin(*USEFUL) & F.col("complete")
    s = scan(d, ["identity", "clock", "unit"], ["time", "rid"], last_good=("total_max", F.when(good, F.col("time"))))
    return s.where((F.col("boundary") == "recovery") & (F.col("last_good") >= F.col("time"))).select("rid").distinct()


def covering_intervals(ranges: DataFrame, need: DataFrame, keys: list[str]) -> DataFrame:
    """``need`` (keys, need_id, lo, hi) with ``covered``: does one merged observed range contain it whole?
    Merged ranges are disjoint, so only the last one starting at or before the need can contain it."""
    isl = materialize(range_union(ranges, keys, "lo", "hi"), "islands").select(*keys, "lo", F.col("hi").alias("reach"), F.lit(0).alias("ask"))
    n = need.select(*keys, "need_id", "lo", "hi", F.lit(1).alias("ask"))
    rows = isl.unionByName(n, allowMissingColumns=True).withColumn("need_id", F.coalesce("need_id", F.lit(-1)))
    s = scan(rows, keys, ["lo", "ask", "need_id"], last=("last_before", F.col("reach")))
    return s.where("ask = 1").select(*keys, "need_id", "lo", "hi", F.coalesce(F.col("last") >= F.col("hi"), F.lit(False)).alias("covered"))


def readiness(ranges: DataFrame, need: DataFrame, key: str) -> DataFrame:
    """Earliest time at which ``need`` (key, lo, hi; one row per key) is readable without a hole, null when it never is.

    ``ranges`` (key, clock, unit, time, lo, hi) are complete, explicitly framed ranges. Mixed clocks or units give null.
    The needed span is cut at all endpoints; each range is split into two power-of-two blocks of pieces, and block
    minima are pushed down one level per round, so no range is joined with all its pieces."""
    r = ranges.join(need.select(key, F.col("lo").alias("n0"), F.col("hi").alias("n1")), key)
    mixed = r.groupBy(key).agg((F.min("clock") != F.max("clock")).alias("clocks"), (F.min("unit") != F.max("unit")).alias("units"))
    r = r.select(key, "time", "n0", "n1", F.greatest("lo", "n0").alias("lo"), F.least("hi", "n1").alias("hi")).where("hi > lo")
    cuts = (r.select(key, F.explode(F.array("lo", "hi", "n0", "n1")).alias("at")).distinct())
    idx = materialize(scan(cuts, [key], ["at"], i=("sum", F.lit(1))), "cuts")
    size = idx.groupBy(key).agg(F.max("i").alias("m"))
    top = size.agg(F.max("m")).first()[0] or 1
    lo, hi = (idx.select(key, F.col("at").alias(c), F.col("i").alias(f"i_{c}")) for c in ("lo", "hi"))
    b = r.join(lo, [key, "lo"]).join(hi, [key, "hi"]).select(key, "time", "i_lo", "i_hi")
    level = F.floor(F.log2((F.col("i_hi") - F.col("i_lo")).cast("double") + 0.5)).cast("int")
    span = F.pow(F.lit(2.0), level).cast("long")
    blocks = materialize(b.select(key, "time", level.alias("__level"), F.explode(F.array_distinct(F.array(F.col("i_lo"), F.col("i_hi") - span))).alias("i"))
                         .groupBy(key, "__level", "i").agg(F.min("time").alias("time")), "blocks")
    cur = None
    for k in range(max(0, math.ceil(math.log2(top + 1))), -1, -1):
        here = blocks.where(F.col("__level") == k).select(key, "i", "time")
        if cur is not None:
            half = 1 << k
            down = cur.select(key, "time", F.explode(F.array(F.col("i"), F.col("i") + half)).alias("i")).select(key, "i", "time")
            here = here.unionByName(down)
        cur = here.groupBy(key, "i").agg(F.min("time").alias("time"))
    got = cur.groupBy(key).agg(F.count(F.lit(1)).alias("pieces"), F.max("time").alias("ready"))
    out = need.join(mixed, key, "left").join(size, key, "left").join(got, key, "left")
    reason = (F.when(F.col("clocks"), "readability clocks unrelated").when(F.col("units"), "readability timestamp units differ")
              .when(F.col("pieces") == F.col("m") - 1, "required contiguous range readable").otherwise("required range not established"))
    return out.withColumn("reason", reason).select(
        key, "lo", "hi", F.when(F.col("reason") == "required contiguous range readable", F.col("ready")).alias("ready"), "reason")


def counter_delta(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """after − before per counter; null on the first sample, a reset or a unit change."""
    s = scan(samples, keys, order, before=("lag", F.struct("value", "unit")))
    ok = (F.col("before.unit") == F.col("unit")) & (F.col("value") >= F.col("before.value"))
    return s.withColumn("delta", F.when(ok, F.col("value") - F.col("before.value"))).drop("before")


def ack_spacing(emitted: DataFrame, arrived: DataFrame, keys: list[str], rate_lo: float, rate_hi: float) -> DataFrame:
    """Distortion bounds of the spacing of consecutive ACKs at the receiver against the sender's spacing.
    Both sides: keys, ack_id, clock, time, uncertainty. Without the same id on both sides there is no row to compare."""
    a = arrived.select(*keys, "ack_id", *[F.col(c).alias(f"a_{c}") for c in ("clock", "time", "uncertainty")])
    j = join_on(emitted, a, [*keys, "ack_id"])
    now = F.struct("clock", "time", "uncertainty", "a_clock", "a_time", "a_uncertainty", "ack_id")
    s = scan(j, keys, ["time", "ack_id"], p=("lag", now))
    e, eu = F.col("time") - F.col("p.time"), F.col("uncertainty") + F.col("p.uncertainty")
    v, vu = F.col("a_time") - F.col("p.a_time"), F.col("a_uncertainty") + F.col("p.a_uncertainty")
    ok = ((F.col("clock") == F.col("p.clock")) & (F.col("a_clock") == F.col("p.a_clock")) & (e + eu >= 0) & (v + vu >= 0))
    return s.where("p is not null").select(*keys, F.col("p.ack_id").alias("first_ack"), F.col("ack_id").alias("second_ack"),
                                           F.when(ok, (v - vu) - (e + eu) * rate_hi).alias("lo"), F.when(ok, (v + vu) - (e - eu) * rate_lo).alias("hi"))


def sequence_gaps(events: DataFrame, keys: list[str]) -> DataFrame:
    """Missing sequence numbers per source: how many, in how many holes."""
    s = scan(events.select(*keys, "sequence").distinct(), keys, ["sequence"], nxt=("lead", F.col("sequence")))
    hole = F.col("nxt") - F.col("sequence") - 1
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.count_if(hole > 0).alias("holes"),
                                F.coalesce(F.sum(hole), F.lit(0)).alias("missing"))


def trigger_window(events: DataFrame, key: str, order: list[str], pre: int, post: int, max_bytes: int, max_age) -> DataFrame:
    """(trigger, event, offset) rows: per trigger the last ``pre`` events (itself included) inside the byte and age budget,
    and the next ``post``. Each trigger reaches for pre + post positions, so the join is bounded by that."""
    at = order[0]
    s = materialize(scan(events, [key], order, pos=("sum", F.lit(1)), used=("sum", F.col("bytes"))), "trigger")
    t = s.where("is_trigger").select(key, F.col("rid").alias("trigger_rid"), F.col("pos").alias("t_pos"), F.col("used").alias("t_used"),
                                     F.col(at).alias("t_at"), F.explode(F.sequence(F.lit(1 - pre), F.lit(post))).alias("offset"))
    t = t.withColumn("pos", F.col("t_pos") + F.col("offset"))
    j = t.join(s.select(key, "pos", "rid", "used", "bytes", F.col(at).alias("e_at")), [key, "pos"])
    fits = (F.col("t_used") - F.col("used") + F.col("bytes") <= max_bytes) & (F.col("t_at") - F.col("e_at") <= max_age)
    return j.where((F.col("offset") > 0) | fits).select(key, "trigger_rid", "rid", "offset")


def ingest_cap(events: DataFrame, key: str, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n records per key, coverage facts with retained and omitted counts)."""
    s = scan(events, [key], order, pos=("sum", F.lit(1)))
    facts = events.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("retained"), F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("omitted"))
    return s.where(F.col("pos") <= n), facts


def pin_events(events: DataFrame, request: dict) -> tuple[DataFrame, DataFrame]:
    """(kept events, coverage per source) for a history request: source_instance, sequence range, clock with time window,
    identities, max_bytes. Rows are taken in sequence order while they fit; a row that does not fit is lost, later ones may still fit.

    In each round the prefix that fits is kept, rows larger than what is left go, and the others are tried again."""
    c = F.col("source") == request["source_instance"] if request.get("source_instance") else F.lit(True)
    if request.get("sequence"):
        c = c & F.col("sequence").between(*request["sequence"])
    if request.get("time"):
        c = c & (F.col("clock") == request["clock"]) & F.col("time").between(*request["time"])
    if request.get("identities"):
        c = c & F.col("identity").isin(*request["identities"])
    found = materialize(events.where(c), "matched")
    left = found.withColumn("room", F.lit(request["max_bytes"]).cast("long")).where(F.col("bytes") <= F.col("room"))
    kept = []
    while True:
        s = materialize(scan(left, ["source"], ["sequence"], used=("sum", F.col("bytes"))), "pinned")
        fits = F.col("used") <= F.col("room")
        if s.isEmpty():
            break
        kept.append(s.where(fits).select(*events.columns))
        room = s.groupBy("source").agg((F.min("room") - F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0))).alias("room"))
        left = s.where(~fits).drop("used", "room").join(room, "source").where(F.col("bytes") <= F.col("room"))
    out = reduce(DataFrame.unionByName, kept) if kept else found.limit(0)
    cov = found.groupBy("source").agg(F.count(F.lit(1)).alias("matched"))
    taken = out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    return out, cov.join(taken, "source", "left").select("source", "matched", (F.col("matched") - F.coalesce("n", F.lit(0))).alias("lost"), "first_sequence", "last_sequence")


def look_schedule(looks: DataFrame) -> DataFrame:
    """Sequential error budget. Looks: incident, contract, seq, look, alpha (spent), contract_alpha.
    The k-th look may spend alpha/(k(k+1)); out-of-order looks and wrong amounts are flagged."""
    s = scan(looks, ["incident", "contract"], ["seq"], expected=("sum", F.lit(1)))
    k = F.col("look")
    return s.withColumn("skipped", k != F.col("expected")).withColumn(
        "wrong_alpha", (k < 1) | (F.col("alpha") != F.col("contract_alpha") / (k * (k + 1))))


def overspent(contracts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Incidents whose contract allocations exceed the frozen error budget."""
    a = contracts.groupBy("incident").agg(F.sum("alpha").alias("allocated"))
    return a.join(budgets, "incident").withColumn("overspent", F.col("allocated") > F.col("error_budget") + 1e-12)


def xcorr(series: DataFrame, key: str, order: list[str], max_lag: int = 2) -> DataFrame:
    """Normalised cross-correlation of columns ``a`` and ``b`` per key at lags −k..k, best by size (first wins ties).
    A negative lag means ``a`` leads. Lag rows join on position, one partner each."""
    n = F.lit(1)
    s = scan(series, [key], order, __i=("sum", n), __n=("total_sum", n), sa=("total_sum", F.col("a")), sb=("total_sum", F.col("b")))
    s = materialize(s.select(key, F.col("__i").alias("i"), F.col("__n").alias("n"), (F.col("a") - F.col("sa") / F.col("__n")).alias("a"), (F.col("b") - F.col("sb") / F.col("__n")).alias("b")), "series")
    var = s.groupBy(key).agg(F.sum(F.col("a") * F.col("a")).alias("va"), F.sum(F.col("b") * F.col("b")).alias("vb"), F.max("n").alias("n"))
    left = s.select(key, F.col("a"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "i").withColumn("i", F.col("i") - F.col("lag"))
    prod = left.join(s.select(key, "i", "b"), [key, "i"]).groupBy(key, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    v = prod.join(var, key).where((F.col("va") > 0) & (F.col("vb") > 0) & (F.col("n") - F.abs("lag") >= 2)).select(
        key, "lag", (F.col("p") / F.sqrt(F.col("va") * F.col("vb"))).alias("value"))
    best = v.groupBy(key).agg(F.min_by(F.struct("lag", "value"), F.struct(-F.round(F.abs("value"), 12), "lag")).alias("s"))
    return var.select(key).join(best, key, "left").select(
        key, F.when(F.col("s.value") != 0, F.col("s.lag")).otherwise(F.lit(0)).alias("lag"), F.coalesce("s.value", F.lit(0.0)).alias("value"))


def xcorr_binned(spans: DataFrame, bins: int = 200) -> DataFrame:
    """Per run: the lag in ms (kernel starts after host starts) with the highest correlation of binned start counts.
    Work per run is bounded by the square of the bin count, whatever the number of spans."""
    s = spans.where("kind in ('cpu_launch', 'gpu_kernel')")
    r = s.groupBy("run_id").agg(F.min("start_ns").alias("t0"), ((F.max("end_ns") - F.min("start_ns")) / F.lit(bins)).alias("w"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("start_ns") - F.col("t0")) / F.col("w"))).cast("int")
    c = (s.join(r, "run_id").where("w > 0").groupBy("run_id", "w", b.alias("bin"))
         .agg(F.count_if(F.col("kind") == "cpu_launch").alias("c"), F.count_if(F.col("kind") == "gpu_kernel").alias("g")))
    tot = c.groupBy("run_id").agg((F.sum("c") / F.lit(float(bins))).alias("mc"), (F.sum("g") / F.lit(float(bins))).alias("mg"),
                                  F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum(F.col("g") * F.col("g")).alias("g2"))
    grid = r.select("run_id", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    f = materialize(grid.join(c.drop("w"), ["run_id", "bin"], "left").join(tot, "run_id").select(
        "run_id", "w", "bin", (F.coalesce("c", F.lit(0)) - F.col("mc")).alias("c"), (F.coalesce("g", F.lit(0)) - F.col("mg")).alias("g")), "bins")
    pair = f.select("run_id", "w", F.col("bin").alias("bc"), "c").join(f.select("run_id", F.col("bin").alias("bg"), "g"), "run_id")
    cc = pair.groupBy("run_id", "w", (F.col("bg") - F.col("bc")).alias("lag")).agg(F.round(F.sum(F.col("c") * F.col("g")), 9).alias("v"))
    flat = f.groupBy("run_id").agg((F.var_pop("c") * F.var_pop("g") <= 0).alias("flat"))
    best = cc.groupBy("run_id").agg(F.min_by(F.col("lag") * F.col("w") / 1e6, F.struct(-F.col("v"), "lag")).alias("lag_ms"))
    return best.join(flat, "run_id").select("run_id", F.when(F.col("flat"), 0.0).otherwise(F.col("lag_ms")).alias("lag_ms"))


# Mechanism name and the interval kind that speaks for it.
INTERVAL_MECHANISMS = (("endpoint_dispatch", "dispatch_delay"), ("late_consumption", "consumption_delay"), ("queue_wait", "queue_sojourn"),
                       ("relay_release", "relay_residence"), ("wireless_access_wait", "access_wait"), ("link_assignment_wait", "link_assignment_wait"))


def interval_mechanisms(pairs: DataFrame, unmatched: DataFrame, gaps: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """(key, mechanism, result, clean, supporting) from paired intervals.

    supports: some clean interval's lower bound exceeds the threshold (0 without one). contradicts: a threshold is set,
    nothing is missing or unmatched, and every clean upper bound is within it. Else unresolved.
    ``gaps``: keys with incomplete coverage; ``thresholds``: (kind, unit_limit, threshold)."""
    clean = pairs.where(F.size("limitations") == 0).join(thresholds, "kind", "left")
    same = F.col("unit") == F.col("unit_limit")
    limit = F.when(same, F.col("threshold")).otherwise(F.lit(0))
    g = clean.groupBy(key, "kind").agg(
        F.count(F.lit(1)).alias("clean"), F.count_if(F.col("duration_bounds.lo") > limit).alias("supporting"),
        F.bool_and(F.coalesce(same & (F.col("duration_bounds.hi") <= F.col("threshold")), F.lit(False))).alias("within"))
    kinds = F.array(*[F.struct(F.lit(m).alias("mechanism"), F.lit(k).alias("kind")) for m, k in INTERVAL_MECHANISMS])
    keys = pairs.select(key).union(unmatched.select(key)).union(gaps.select(key)).distinct()
    grid = keys.select(key, F.explode(kinds).alias("k")).select(key, "k.*")
    bad = unmatched.select(key, "kind").distinct().withColumn("un", F.lit(True))
    holes = gaps.select(key).distinct().withColumn("gap", F.lit(True))
    j = grid.join(g, [key, "kind"], "left").join(bad, [key, "kind"], "left").join(holes, key, "left")
    no = F.col("within") & F.col("un").isNull() & F.col("gap").isNull()
    return j.select(key, "mechanism", "kind", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("supporting", F.lit(0)).alias("supporting"),
                    F.when(F.col("supporting") > 0, "supports").when(no, "contradicts").otherwise("unresolved").alias("result"))


def event_mechanisms(events: DataFrame, key: str, recovered: DataFrame) -> DataFrame:
    """(key, mechanism, result, supporting) from single events with ``values`` map<string,string> and ``links``.
    ``recovered``: rids from :func:`useful_after`. Only complete events count."""
    v = lambda k: F.col("values")[k]
    num = lambda k: v(k).cast("double")
    linked = F.exists("links", lambda l: (l["relation"] == "resource") & (l["certainty"] == "explicit"))
    limiter = v("snd_cwnd").isNotNull() | v("rwnd").isNotNull() | v("pacing_rate").isNotNull()
    covered = ((num("repaired_lo") >= 0) & (num("repaired_lo") <= num("required_lo")) & (num("repaired_hi") >= num("required_hi")))
    rules = {
        "sender_restriction": (F.col("boundary") == "socket_state") & (num("pending_bytes") > 0) & (num("not_sent_bytes") > 0) & limiter,
        "queue_accumulation": (F.col("boundary") == "queue_enqueue") & (num("backlog_after") > num("backlog_before")) & linked,
        "recovery_gating": (F.col("boundary") == "recovery") & (v("pending") == "true") & covered & F.col("__rec"),
        "serialization": (F.col("boundary") == "egress") & v("service_interval").isNotNull() & (num("bytes") > 0) & linked,
        "historical_path_change": (F.col("boundary") == "route") & v("previous_epoch").isNotNull() & (v("flow_correspondence") == "explicit"),
        "reverse_feedback": (F.col("boundary") == "ack_arrive") & v("emission_spacing").isNotNull() & v("arrival_spacing").isNotNull()
        & (v("sender_gated") == "true") & (v("direction") == "feedback"),
    }
    e = events.join(recovered.select("rid", F.lit(True).alias("__rec")), "rid", "left").withColumn("__rec", F.coalesce("__rec", F.lit(False)))
    g = e.groupBy(key).agg(*[F.count_if(F.coalesce(F.col("complete") & r, F.lit(False))).alias(m) for m, r in rules.items()],
                           F.count_if(F.coalesce((v("shared_exposure") == "true") | (v("masked_dependency") == "true"), F.lit(False))).alias("shared"))
    long = g.unpivot([key, "shared"], list(rules), "mechanism", "supporting")
    return long.withColumn("result", F.when(F.col("supporting") > 0, "supports").otherwise("unresolved"))


def compound_mechanism(results: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Keys where two or more mechanisms are supported and some event shows shared exposure or masking."""
    n = results.where("result = 'supports'").groupBy(key).agg(F.count_distinct("mechanism").alias("mechanisms"))
    return n.join(shared.where("shared > 0").select(key).distinct(), key).where("mechanisms > 1")


def nominate(spans: DataFrame) -> DataFrame:
    """Per run: lag correlation of host gaps with waits, and the side with more variance. Only nominates; an observed edge stands."""
    h = scan(spans.where("kind = 'cpu_launch'"), ["run_id"], ["start_ns", "event_id"], nxt=("lead", F.col("start_ns")))
    vg = h.groupBy("run_id").agg(F.var_pop((F.col("nxt") - F.col("end_ns")) / 1e6).alias("vg"), F.count("nxt").alias("ng"))
    b = scan(spans.where("kind = 'sync_edge'"), ["run_id"], ["start_ns", "event_id"], pos=("sum", F.lit(1))).where("pos > 1")
    vb = b.groupBy("run_id").agg(F.var_pop(F.col("dur_ns") / 1e6).alias("vb"), F.count(F.lit(1)).alias("nb"))
    guess = F.when((F.col("vg") >= F.coalesce("vb", F.lit(0.0))) & (F.col("ng") > 0), "host").when(F.col("nb") > 0, "sync")
    return vg.join(vb, "run_id", "left").select("run_id", guess.alias("nomination"), F.lit(False).alias("overrides_edge"))
