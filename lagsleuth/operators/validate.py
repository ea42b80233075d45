"""Row rules: every row gets the list of reasons why it is not usable; rejects are kept beside the valid rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import join_on, pair_join

# Event boundaries that are understood.
BOUNDARIES = (
    "release", "ready", "submit", "socket_accept", "write_complete", "egress", "ingress", "readable", "complete_readable",
    "consume", "complete", "cancel", "outcome", "retransmit", "ack_emit", "ack_arrive", "recovery", "queue_enqueue",
    "queue_dequeue", "switch_ingress", "switch_egress", "relay_ingress", "relay_release", "relay_egress", "runnable", "running",
    "blocked", "preempt", "eligible", "link_assign", "access", "retry", "delivery", "route", "socket_state", "flow_control",
    "migration", "packet_capture",
)


def _no(c: Column) -> Column:
    return F.coalesce(~c, F.lit(True))


def EVENT_RULES() -> dict[str, Column]:
    t, drops = F.col("time"), F.col("coverage")["drops"]
    return {
        "source": F.coalesce(F.col("source_instance"), F.lit("")) == "",
        "sequence": _no(F.col("sequence") >= 0),
        "boundary": _no(F.col("boundary").isin(*BOUNDARIES)),
        "clock": F.coalesce(F.col("clock"), F.lit("")) == "",
        "time": t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")),
        "uncertainty": F.coalesce(F.col("uncertainty"), F.lit(0)) < 0,
        "link certainty": F.exists("links", lambda l: _no(l["certainty"].isin("explicit", "bounded", "inferred"))),
        "time unit": _no(F.col("units")["time"].isin("ns", "us", "ms", "s")),
        "drops": drops < 0,
        "coverage conflict": F.col("coverage")["complete"] & ~drops.eqNullSafe(F.lit(0)),
        "missing field": F.col("values").isNull() | F.col("links").isNull() | F.col("limitations").isNull() | F.col("coverage").isNull(),
    }


def CONTRACT_RULES() -> dict[str, Column]:
    return {
        "mediator matched": F.arrays_overlap("comparable", "mediators"),
        "exposure matched": F.array_contains("comparable", F.col("exposure")),
        "alpha": _no((F.col("alpha") > 0) & (F.col("alpha") < 1)),
        "threshold": _no(F.col("threshold") >= 0),
        "selection": _no(F.col("selection").isin("exploratory", "confirmatory")),
    }


def with_reasons(df: DataFrame, rules) -> DataFrame:
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules().items()])))


def split_valid(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    r = with_reasons(df, rules)
    return r.where(F.size("reasons") == 0).drop("reasons"), r.where(F.size("reasons") > 0)


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_valid(df, EVENT_RULES)


def validate_contracts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_valid(df, CONTRACT_RULES)


def required_fields(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.where(~bad), df.where(bad)


def downgrade_coverage(events: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """When an export lost events (key, export_complete, export_dropped), all its events become incomplete and say so."""
    e = join_on(events, manifests, [key], "left")
    lossy = ~F.coalesce("export_complete", F.lit(True)) | (F.coalesce("export_dropped", F.lit(0)) > 0)
    note = F.array_append(F.col("limitations"), F.lit("application event export coverage incomplete"))
    return (e.withColumn("limitations", F.when(lossy, note).otherwise(F.col("limitations")))
            .withColumn("complete", F.when(lossy, False).otherwise(F.col("complete")))
            .withColumn("drops", F.when(lossy, F.col("export_dropped")).otherwise(F.col("drops"))).drop("export_complete", "export_dropped"))


def compose_clocks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Chain clock mappings (id, source, target, rate, offset and validity bounds) whose target is the other's source.
    The whole image of the first must lie inside the second's validity; rates must be positive."""
    c = F.col
    image = [c(v) * c(r) + c(o) for v in ("valid_lo", "valid_hi") for r in ("rate_lo", "rate_hi") for o in ("off_lo", "off_hi")]
    rising = F.least("rate_lo", "rate_hi") > 0
    a = first.where(rising).withColumns({"image_lo": F.least(*image), "image_hi": F.greatest(*image)})
    b = second.where(F.coalesce(rising, F.lit(True))).select(*[c(x).alias(f"b_{x}") for x in second.columns])
    j = pair_join(a, b, [("target", "b_source")])
    rates = [c(x) * c(y) for x in ("rate_lo", "rate_hi") for y in ("b_rate_lo", "b_rate_hi")]
    offs = [c(x) * c(y) + c(z) for x in ("off_lo", "off_hi") for y in ("b_rate_lo", "b_rate_hi") for z in ("b_off_lo", "b_off_hi")]
    ok = (c("image_lo") >= c("b_valid_lo")) & (c("image_hi") <= c("b_valid_hi"))
    return j.where(ok).select(c("id").alias("first_id"), c("b_id").alias("second_id"), c("source"), c("b_target").alias("target"),
                              F.least(*rates).alias("rate_lo"), F.greatest(*rates).alias("rate_hi"), F.least(*offs).alias("off_lo"),
                              F.greatest(*offs).alias("off_hi"), "valid_lo", "valid_hi")
