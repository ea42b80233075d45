"""Folds over the append-only evidence log. Log rows: offset (write order), type, id, and the columns each fold names."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import closure
from .ordered import join_on, pair_join, scan
from .storage import materialize

C = F.col


def replay(log: DataFrame) -> DataFrame:
    """Latest data per (type, id) in write order."""
    return log.groupBy("type", "id").agg(F.max_by("data", "offset").alias("data"), F.max("offset").alias("offset"))


def illegal_transitions(transitions: DataFrame, experiments: DataFrame) -> DataFrame:
    """Transitions that could not have been written, with the first reason.

    transitions: id (hypothesis), offset, from_status, to_status, experiment; experiments: experiment, hypothesis, measured.
    Legal: INFERRED→TESTED with an experiment of this hypothesis, TESTED→VERIFIED with a measured one, TESTED→INFERRED."""
    s = scan(transitions, ["id"], ["offset"], before=("lag", C("to_status")))
    e = experiments.select("experiment", "hypothesis", "measured")
    j = s.join(e, "experiment", "left").withColumn("prior", F.coalesce("before", F.lit("INFERRED")))
    linked = F.coalesce(C("hypothesis") == C("id"), F.lit(False))
    step = F.concat_ws(">", "prior", "to_status")
    why = (F.when(C("from_status") != C("prior"), "base mismatch")
           .when((step == "INFERRED>TESTED") & ~linked, "no linked experiment")
           .when((step == "TESTED>VERIFIED") & ~(linked & C("measured").isNotNull()), "not measured")
           .when(~step.isin("INFERRED>TESTED", "TESTED>VERIFIED", "TESTED>INFERRED"), "illegal step"))
    return j.withColumn("reason", why).where("reason is not null").select("id", "offset", "prior", "to_status", "reason")


def claims_view(claims: DataFrame, superseded: DataFrame, support: DataFrame, inputs: DataFrame, events: DataFrame, mechanisms: DataFrame, gates: DataFrame) -> DataFrame:
    """Current claims: (id, incident, level, state) with state claim or candidate, superseded ones gone.

    An INFERRED claim stands only if its mechanism is supported by the events behind its support (support: id, ref; inputs:
    item, needs; mechanisms: incident, mechanism, result). A TESTED or VERIFIED claim needs every recomputed gate to pass
    (gates: id, gate, passed); otherwise it is refused and says so. References outside the incident are refused too."""
    live = claims.join(superseded.select("id").distinct(), "id", "left_anti")
    raw = closure(inputs, support.select(C("ref").alias("root"))).select(C("root").alias("ref"), "item")
    ev = raw.join(events.select(C("id").alias("item"), C("incident").alias("e_incident")), "item")
    s = support.join(ev, "ref", "left").join(live.select("id", "incident"), "id").groupBy("id").agg(
        F.count("item").alias("n_events"), F.count_if(C("e_incident") != C("incident")).alias("foreign"))
    m = mechanisms.where("result = 'supports'").select("incident", "mechanism").distinct().withColumn("sup", F.lit(True))
    g = gates.groupBy("id").agg(F.bool_and("passed").alias("gated"))
    j = join_on(join_on(live, m, ["incident", "mechanism"], "left").join(s, "id", "left"), g, ["id"], "left")
    inf = C("level") == "INFERRED"
    good = F.coalesce(C("sup"), F.lit(False)) & (F.coalesce("n_events", F.lit(0)) > 0)
    state = (F.when(F.coalesce("foreign", F.lit(0)) > 0, "refused: cross-incident reference").when(inf & ~good, "candidate")
             .when(~inf & ~F.coalesce("gated", F.lit(False)), "refused: gate").otherwise("claim"))
    return j.select("id", "incident", "level", state.alias("state"))


def prior_advice(summaries: DataFrame, context: DataFrame) -> DataFrame:
    """Summaries of closed incidents with an equal context and no capability the asker lacks. They nominate, never support.
    summaries: incident, context map, capabilities array, mechanisms array; context: ask, context map, capabilities array."""
    key = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    names = lambda c: F.transform(c, lambda x: F.coalesce(F.concat(F.lit("+"), x.cast("string")), F.lit("null")))
    a = context.select("ask", key("context").alias("a_k"), C("capabilities").alias("have")).where("a_k is not null and have is not null")
    a = materialize(a.withColumn("a_by", F.explode(F.array_distinct(F.concat(F.array(F.lit("none")), names("have"))))), "askers")
    # A summary is looked for by one of its capabilities, the one that the fewest askers of its context have; one without any by its context alone.
    s = summaries.select(key("context").alias("k"), "incident", C("capabilities").alias("needs"), F.array_sort(F.array_distinct("mechanisms")).alias("mechanisms"))
    s = materialize(s.where("k is not null and needs is not null").withColumn("row", F.monotonically_increasing_id()), "summaries")
    want = s.select("row", "k", F.explode(F.when(F.size("needs") == 0, F.array(F.lit("none"))).otherwise(F.array_distinct(names("needs")))).alias("by"))
    offered = a.groupBy(C("a_k").alias("k"), C("a_by").alias("by")).agg(F.count(F.lit(1)).alias("askers"))
    rare = want.join(offered, ["k", "by"], "left").groupBy("row").agg(F.min(F.struct(F.coalesce("askers", F.lit(0)).alias("askers"), "by")).alias("least"))
    j = pair_join(s.join(rare.where("least.askers > 0").select("row", "least.by"), "row"), a, [("k", "a_k"), ("by", "a_by")])
    return j.where(F.size(F.array_except("needs", "have")) == 0).select("ask", "incident", "mechanisms")


def budget_left(budgets: DataFrame, plans: DataFrame, results: DataFrame) -> DataFrame:
    """Budget per incident minus what was spent; a plan without a result is charged at its bound.
    plans: incident, acquisition, bound; results: acquisition, actual."""
    r = results.groupBy("acquisition").agg(F.sum("actual").alias("actual"), F.lit(True).alias("done"))
    p = plans.join(r, "acquisition", "left").groupBy("incident").agg(F.sum(F.when(C("done"), F.coalesce("actual", F.lit(0.0))).otherwise(C("bound"))).alias("spent"), F.count_if(C("done").isNull()).alias("unfinished"))
    return budgets.join(p, "incident", "left").select("incident", (C("budget") - F.coalesce("spent", F.lit(0.0))).alias("left"), F.coalesce("unfinished", F.lit(0)).alias("unfinished"))


def registry_view(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state per hypothesis, rejected actions). actions: id, offset, action (propose, suppress, reopen), reason, evidence.

    Suppressing needs an open entry, reopening a suppressed one, both a reason; rejected actions change nothing. As only
    suppress and reopen with a reason count, an action is accepted when the last such action before it was the other kind."""
    real = F.trim(F.coalesce("reason", F.lit(""))) != ""
    turn = C("action").isin("suppress", "reopen")
    s = scan(actions.withColumn("counts", turn & real), ["id"], ["offset"], last=("last_before", F.when(C("counts"), C("action"))))
    was = F.coalesce(C("last"), F.lit("reopen"))
    why = F.when(turn & ~real, "no reason").when((C("action") == was) & turn, F.concat(F.lit("already "), F.when(was == "suppress", "suppressed").otherwise("open")))
    r = s.withColumn("rejected", why)
    ok = C("rejected").isNull() & turn
    view = r.groupBy("id").agg(F.coalesce(F.max_by("action", F.when(ok, C("offset"))) == "suppress", F.lit(False)).alias("suppressed"), F.max_by("reason", F.when(ok, C("offset"))).alias("reason"),
                               F.count_if(ok).alias("turns"), F.count_distinct(F.when(C("rejected").isNull() & (C("action") != "suppress"), C("evidence"))).alias("support"))
    return view, r.where("rejected is not null").select("id", "offset", "action", "rejected")
