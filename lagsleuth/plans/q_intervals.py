"""Pairing, range, window and correlation queries over the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import intervals as I, ordered as O, validate as V
from .registry import query
from .views import PROGRESS, SPANS, micros, progress, spans, table


def linked(spark, d):
    return progress(spark, d).withColumns({"relation": F.lit("delivery"), "unit": F.lit("us"), "limitations": F.array().cast("array<string>")})


W4 = f"""{PROGRESS}, kinds AS (SELECT unnest(['queue_enqueue', 'release']) AS s, unnest(['queue_dequeue', 'submit']) AS e, unnest(['queue_sojourn', 'dispatch_delay']) AS kind),
ro AS (SELECT p.*, kind, boundary = s AS is_start FROM progress p JOIN kinds ON boundary IN (s, e)),
w AS (SELECT *, lag(is_start) OVER o AS p1, lag(is_start, 2) OVER o AS p2, lag(rid) OVER o AS prid, lag(time) OVER o AS ptime, lag(uncertainty) OVER o AS pu,
 lag(complete) OVER o AS pc, lead(rid) OVER o AS nrid FROM ro WINDOW o AS (PARTITION BY identity, clock, token, kind ORDER BY time, rid)),
pairs AS (SELECT identity, clock, token, kind, prid AS start_rid, rid AS end_rid, time - ptime AS duration, time - ptime - uncertainty - pu AS lo, time - ptime + uncertainty + pu AS hi,
 NOT (pc AND complete AND coalesce(NOT p2, true)) AS limited FROM w WHERE NOT is_start AND p1),
unm AS (SELECT identity, clock, token, kind, NULL::BIGINT AS rid1, rid AS rid2, 'start outside retained view' AS reason FROM w WHERE NOT is_start AND NOT coalesce(p1, false)
 UNION ALL SELECT identity, clock, token, kind, prid, rid, 'duplicate start identity' FROM w WHERE is_start AND p1
 UNION ALL SELECT identity, clock, token, kind, rid, NULL, 'end outside retained view' FROM w WHERE is_start AND nrid IS NULL)"""


@query("W4", "pair_intervals", f"WITH {W4} SELECT * FROM pairs")
def _(spark, d):
    p, _u = I.pair_intervals(linked(spark, d))
    return p.select("identity", "clock", "token", "kind", "start_rid", "end_rid", "duration", F.col("duration_bounds.lo").alias("lo"),
                    F.col("duration_bounds.hi").alias("hi"), (F.size("limitations") > 0).alias("limited"))


@query("W4", "unmatched_intervals", f"WITH {W4} SELECT * FROM unm")
def _(spark, d):
    return I.pair_intervals(linked(spark, d))[1].drop("relation")


@query("C21", "interval_mechanisms", f"""WITH {W4}, mech AS (SELECT * FROM (VALUES ('endpoint_dispatch', 'dispatch_delay'), ('late_consumption', 'consumption_delay'), ('queue_wait', 'queue_sojourn'),
 ('relay_release', 'relay_residence'), ('wireless_access_wait', 'access_wait'), ('link_assignment_wait', 'link_assignment_wait')) t(mechanism, kind)),
g AS (SELECT identity, kind, count(*) AS clean, count(*) FILTER (lo > CASE WHEN kind = 'queue_sojourn' THEN 500000000000 ELSE 0 END) AS supporting,
 bool_and(kind = 'queue_sojourn' AND hi <= 500000000000) AS within FROM pairs WHERE NOT limited GROUP BY ALL),
ids AS (SELECT identity FROM pairs UNION SELECT identity FROM unm UNION SELECT identity FROM progress WHERE NOT complete)
SELECT ids.identity, mechanism, mech.kind, coalesce(clean, 0) AS clean, coalesce(supporting, 0) AS supporting, CASE WHEN supporting > 0 THEN 'supports'
 WHEN within AND NOT EXISTS (FROM unm u WHERE u.identity = ids.identity AND u.kind = mech.kind) AND NOT EXISTS (FROM progress p WHERE p.identity = ids.identity AND NOT complete)
 THEN 'contradicts' ELSE 'unresolved' END AS result FROM ids CROSS JOIN mech LEFT JOIN g ON g.identity = ids.identity AND g.kind = mech.kind""")
def _(spark, d):
    e = linked(spark, d)
    p, u = I.pair_intervals(e)
    th = spark.createDataFrame([("queue_sojourn", "us", 500_000_000_000)], "kind string, unit_limit string, threshold bigint")
    return I.interval_mechanisms(p, u, e.where("not complete"), th, "identity")


def rich_events(spark, d):
    """Events with values and links, for the single-event rules."""
    e = table(spark, d, "events").selectExpr("event_id rid", "cast(user_id as string) incident", f"{micros('ts')} time", "event_id % 17 <> 0 complete",
                                             "event_type", "cast(value as bigint) v", "cast(get_json_object(props, '$.k') as bigint) k")
    kv = "map_from_arrays(array({}), array({}))"
    def m(**x):
        return kv.format(",".join(f"'{a}'" for a in x), ",".join(f"cast({b} as string)" for b in x.values()))
    return e.selectExpr(
        "rid", "incident", "time", "complete", "'c0' clock", "'us' unit",
        "case event_type when 'click' then 'socket_state' when 'view' then 'queue_enqueue' when 'signup' then 'egress' when 'purchase' then 'consume' else 'recovery' end boundary",
        "case event_type when 'click' then " + m(pending_bytes="k - 5", not_sent_bytes="v - 3", snd_cwnd="case when k % 2 = 0 then k end", shared_exposure="k = 7") +
        " when 'view' then " + m(backlog_before="k", backlog_after="v * 4") + " when 'signup' then " + m(service_interval="case when v > 5 then v end", bytes="k - 10") +
        " when 'error' then " + m(pending="k % 3 > 0", required_lo="k", required_hi="k + 10", repaired_lo="k - v", repaired_hi="k + v") + " else " + m(x="1") + " end values",
        "array(named_struct('relation', case when event_type in ('view', 'signup') then 'resource' else 'delivery' end, 'identity', incident, 'certainty', case when k % 5 = 0 then 'inferred' else 'explicit' end)) links")


EVM = """re AS (SELECT event_id AS rid, CAST(user_id AS VARCHAR) AS incident, epoch_us(ts) AS time, event_id % 17 <> 0 AS complete, event_type, CAST(trunc(value) AS BIGINT) AS v,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
lg AS (SELECT incident, max(time) FILTER (event_type = 'purchase' AND complete AND k % 5 <> 0) AS last_good FROM re GROUP BY ALL),
ok AS (SELECT re.incident, CASE WHEN event_type = 'click' AND k - 5 > 0 AND v - 3 > 0 AND k % 2 = 0 THEN 'sender_restriction' WHEN event_type = 'view' AND v * 4 > k AND k % 5 <> 0 THEN 'queue_accumulation'
 WHEN event_type = 'signup' AND v > 5 AND k > 10 AND k % 5 <> 0 THEN 'serialization'
 WHEN event_type = 'error' AND k % 3 > 0 AND k - v >= 0 AND k + v >= k + 10 AND k % 5 <> 0 AND last_good >= time THEN 'recovery_gating' END AS mechanism FROM re JOIN lg USING (incident) WHERE complete)"""


@query("C21", "event_mechanisms", f"""WITH {EVM}, sh AS (SELECT incident, count(*) FILTER (event_type = 'click' AND k = 7) AS shared FROM re GROUP BY incident),
names AS (SELECT unnest(['sender_restriction', 'queue_accumulation', 'recovery_gating', 'serialization', 'historical_path_change', 'reverse_feedback']) AS mechanism)
SELECT sh.incident, shared, names.mechanism, count(ok.mechanism) AS supporting, CASE WHEN count(ok.mechanism) > 0 THEN 'supports' ELSE 'unresolved' END AS result
FROM sh CROSS JOIN names LEFT JOIN ok ON ok.incident = sh.incident AND ok.mechanism = names.mechanism GROUP BY ALL""")
def _(spark, d):
    e = rich_events(spark, d)
    return I.event_mechanisms(e, "incident", I.useful_after(I.explode_links(e)))


@query("C21", "compound_mechanism", f"""WITH {EVM}, n AS (SELECT incident, count(DISTINCT mechanism) AS mechanisms FROM ok GROUP BY ALL)
SELECT incident, mechanisms FROM n WHERE mechanisms > 1 AND incident IN (SELECT incident FROM re WHERE event_type = 'click' AND k = 7)""")
def _(spark, d):
    e = rich_events(spark, d)
    r = I.event_mechanisms(e, "incident", I.useful_after(I.explode_links(e)))
    return I.compound_mechanism(r, r, "incident")


@query("J12", "useful_after", f"""WITH {EVM}, c AS (SELECT *, k % 5 <> 0 AS ex FROM re)
SELECT DISTINCT a.rid FROM c a WHERE event_type = 'error' AND ex AND EXISTS (FROM c b WHERE b.incident = a.incident AND b.event_type = 'purchase' AND b.ex AND b.complete AND b.time >= a.time)""")
def _(spark, d):
    return I.useful_after(I.explode_links(rich_events(spark, d)))


def byte_ranges(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", f"{micros('ts')} time", "cast(get_json_object(props, '$.k') as bigint) lo",
                                                "cast(get_json_object(props, '$.k') as bigint) + cast(value as bigint) hi")


BR = """br AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS time, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS lo,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + CAST(trunc(value) AS BIGINT) AS hi FROM events)"""
ISL = f"""{BR}, g AS (SELECT *, max(hi) OVER (PARTITION BY user_id, event_type ORDER BY lo, hi, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM br),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY lo, hi, event_id) AS isl FROM g),
islands AS (SELECT user_id, event_type, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY user_id, event_type, isl)"""


@query("A10", "range_union", f"WITH {ISL} SELECT * FROM islands")
def _(spark, d):
    return O.range_union(byte_ranges(spark, d), ["user_id", "event_type"], "lo", "hi")


@query("J11", "covering_intervals", f"""WITH {ISL} SELECT n.user_id, n.event_id AS need_id, EXISTS (FROM islands i WHERE i.user_id = n.user_id AND i.event_type = 'view' AND i.lo <= n.lo + 2 AND i.hi >= n.hi + 2) AS covered
FROM br n WHERE event_type = 'click'""")
def _(spark, d):
    r = byte_ranges(spark, d)
    need = r.where("event_type = 'click'").selectExpr("user_id", "event_id need_id", "lo + 2 lo", "hi + 2 hi")
    return I.covering_intervals(r.where("event_type = 'view'"), need, ["user_id"]).select("user_id", "need_id", "covered")


@query("W9", "readiness", f"""WITH {BR}, n AS (SELECT DISTINCT user_id, 20 AS n0, 45 + user_id % 20 AS n1 FROM br),
r AS (SELECT br.user_id, time, greatest(lo, n0) AS lo, least(hi, n1) AS hi, n0, n1 FROM br JOIN n USING (user_id)),
c AS (SELECT DISTINCT user_id, unnest([lo, hi, n0, n1]) AS pt FROM r WHERE hi > lo UNION SELECT user_id, unnest([n0, n1]) FROM n),
p AS (SELECT user_id, pt AS a, lead(pt) OVER (PARTITION BY user_id ORDER BY pt) AS b FROM c),
t AS (SELECT p.user_id, p.a, min(r.time) AS t FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.lo <= p.a AND r.hi >= p.b WHERE p.b IS NOT NULL GROUP BY ALL),
x AS (SELECT user_id, CASE WHEN bool_and(t IS NOT NULL) THEN max(t) END AS ready FROM t GROUP BY ALL)
SELECT user_id, n0::BIGINT AS lo, n1::BIGINT AS hi, ready, CASE WHEN ready IS NULL THEN 'required range not established' ELSE 'required contiguous range readable' END AS reason FROM n JOIN x USING (user_id)""")
def _(spark, d):
    r = byte_ranges(spark, d).withColumn("clock", F.lit("c")).withColumn("unit", F.lit("us"))
    need = r.select("user_id").distinct().selectExpr("user_id", "20L lo", "45 + user_id % 20 hi")
    return I.readiness(r.select("user_id", "clock", "unit", "time", "lo", "hi"), need, "user_id")


@query("W7", "counter_delta", f"""WITH {BR}, s AS (SELECT *, hi - lo AS v, CASE WHEN lo % 10 = 0 THEN 'kB' ELSE 'B' END AS unit FROM br),
w AS (SELECT *, lag(lo) OVER o AS pv, lag(unit) OVER o AS pu FROM s WINDOW o AS (PARTITION BY user_id, event_type ORDER BY time, event_id))
SELECT event_id, CASE WHEN pu = unit AND lo >= pv THEN lo - pv END AS delta FROM w""")
def _(spark, d):
    s = byte_ranges(spark, d).selectExpr("event_id", "user_id", "event_type", "time", "lo value", "case when lo % 10 = 0 then 'kB' else 'B' end unit")
    return I.counter_delta(s, ["user_id", "event_type"], ["time", "event_id"]).select("event_id", "delta")


@query("W8", "ack_spacing", f"""WITH {BR}, e AS (SELECT user_id, lo AS ack_id, min(time) AS time FROM br WHERE event_type = 'click' GROUP BY ALL), a AS (SELECT user_id, lo AS ack_id, max(time) AS arr FROM br WHERE event_type <> 'click' GROUP BY ALL),
w AS (SELECT user_id, ack_id, time, arr, lag(ack_id) OVER o AS pa, lag(time) OVER o AS pt, lag(arr) OVER o AS pat FROM e JOIN a USING (user_id, ack_id) WINDOW o AS (PARTITION BY user_id ORDER BY time, ack_id))
SELECT user_id, pa AS first_ack, ack_id AS second_ack, CASE WHEN arr - pat + 2000 >= 0 THEN round((arr - pat - 2000) - (time - pt + 4000) * 1.5, 3)::DOUBLE END AS lo,
 CASE WHEN arr - pat + 2000 >= 0 THEN round((arr - pat + 2000) - (time - pt - 4000) * 0.5, 3)::DOUBLE END AS hi FROM w WHERE pa IS NOT NULL""")
def _(spark, d):
    r = byte_ranges(spark, d)
    def side(df, agg, u):
        return df.groupBy("user_id", F.col("lo").alias("ack_id")).agg(agg("time").alias("time")).withColumns({"clock": F.lit("c"), "uncertainty": F.lit(u)})
    a = I.ack_spacing(side(r.where("event_type = 'click'"), F.min, 2000), side(r.where("event_type <> 'click'"), F.max, 1000), ["user_id"], 0.5, 1.5)
    return a.select("user_id", "first_ack", "second_ack", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("W14", "sequence_gaps", f"""WITH {PROGRESS}, s AS (SELECT DISTINCT source, sequence FROM progress), w AS (SELECT source, lead(sequence) OVER (PARTITION BY source ORDER BY sequence) - sequence - 1 AS h FROM s)
SELECT source, count(*) AS seen, count(*) FILTER (h > 0) AS holes, coalesce(sum(h), 0)::BIGINT AS missing FROM w GROUP BY source""")
def _(spark, d):
    return I.sequence_gaps(progress(spark, d), ["source"])


@query("W15", "trigger_window", f"""WITH {PROGRESS}, s AS (SELECT source, rid, time, k + 50 AS bytes, boundary = 'recovery' AND k > 80 AS trig, row_number() OVER o AS pos, sum(k + 50) OVER o AS used
 FROM progress WINDOW o AS (PARTITION BY source ORDER BY time, rid))
SELECT t.source, t.rid AS trigger_rid, e.rid, e.pos - t.pos AS "offset" FROM s t JOIN s e ON t.trig AND e.source = t.source AND e.pos BETWEEN t.pos - 5 AND t.pos + 2
WHERE e.pos > t.pos OR (t.used - e.used + e.bytes <= 420 AND t.time - e.time <= 20000000000)""")
def _(spark, d):
    e = progress(spark, d).selectExpr("source", "rid", "time", "k + 50 bytes", "boundary = 'recovery' and k > 80 is_trigger")
    return I.trigger_window(e, "source", ["time", "rid"], 6, 2, 420, 20_000_000_000).withColumn("offset", F.col("offset").cast("long"))


@query("W16", "look_schedule", """WITH c AS (SELECT o_custkey AS incident, o_orderpriority AS contract, o_orderkey AS seq, 0.05::DOUBLE AS ca, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS expected FROM orders),
l AS (SELECT *, CASE WHEN seq % 11 = 0 THEN expected + 1 ELSE expected END AS look FROM c), a AS (SELECT *, CASE WHEN seq % 7 = 0 THEN ca ELSE ca / (look * (look + 1)) END AS alpha FROM l)
SELECT seq, look, expected, look <> expected AS skipped, alpha <> ca / (look * (look + 1)) AS wrong_alpha FROM a""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey incident", "o_orderpriority contract", "o_orderkey seq", "0.05d contract_alpha")
    o = O.scan(o, ["incident", "contract"], ["seq"], n=("sum", F.lit(1)))
    o = o.withColumn("look", F.when(F.col("seq") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    o = o.withColumn("alpha", F.when(F.col("seq") % 7 == 0, F.col("contract_alpha")).otherwise(F.col("contract_alpha") / (F.col("look") * (F.col("look") + 1))))
    return I.look_schedule(o).select("seq", "look", "expected", "skipped", "wrong_alpha")


@query("W16", "overspent", """WITH a AS (SELECT o_custkey AS incident, sum(o_totalprice / 1e7) AS allocated FROM orders GROUP BY ALL)
SELECT incident, round(allocated, 6) AS allocated, allocated > 0.25 + 1e-12 AS overspent FROM a""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey incident", "o_totalprice / 1e7 alpha")
    b = o.select("incident").distinct().withColumn("error_budget", F.lit(0.25))
    return I.overspent(o, b).select("incident", F.round("allocated", 6).alias("allocated"), "overspent")


@query("W10", "xcorr", f"""WITH {SPANS}, s AS (SELECT run_id, dur_ms AS a, k::DOUBLE AS b, row_number() OVER (PARTITION BY run_id ORDER BY start_ns, event_id) AS i FROM spans WHERE kind = 'gpu_kernel'),
m AS (SELECT run_id, avg(a) AS ma, avg(b) AS mb, count(*) AS n, sqrt(var_pop(a) * var_pop(b)) * count(*) AS den FROM s GROUP BY ALL),
v AS (SELECT run_id, lag, sum((x.a - ma) * (y.b - mb)) / any_value(den) AS value FROM s x JOIN m USING (run_id) CROSS JOIN (SELECT unnest(range(-2, 3)) AS lag) JOIN s y USING (run_id) WHERE y.i = x.i - lag GROUP BY ALL)
SELECT run_id, arg_min(lag, (-round(abs(value), 12), lag))::INT AS lag, round(arg_min(value, (-round(abs(value), 12), lag)), 6) AS value FROM v GROUP BY run_id""")
def _(spark, d):
    s = spans(spark, d).where("kind = 'gpu_kernel'").selectExpr("run_id", "start_ns", "event_id", "dur_ms a", "cast(k as double) b")
    return I.xcorr(s, "run_id", ["start_ns", "event_id"]).select("run_id", "lag", F.round("value", 6).alias("value"))


@query("W11", "xcorr_binned", f"""WITH {SPANS}, s AS (SELECT * FROM spans WHERE kind IN ('cpu_launch', 'gpu_kernel')), r AS (SELECT run_id, min(start_ns) AS t0, (max(end_ns) - min(start_ns)) / 200 AS w FROM s GROUP BY ALL),
b AS (SELECT run_id, w, least(199, floor((start_ns - t0) / w))::INT AS bin, kind FROM s JOIN r USING (run_id)),
f AS (SELECT r.run_id, r.w, g.bin, count(*) FILTER (kind = 'cpu_launch') AS c, count(*) FILTER (kind = 'gpu_kernel') AS g FROM r CROSS JOIN (SELECT unnest(range(200)) AS bin) g LEFT JOIN b ON b.run_id = r.run_id AND b.bin = g.bin GROUP BY ALL),
z AS (SELECT run_id, w, bin, c - avg(c) OVER (PARTITION BY run_id) AS c, g - avg(g) OVER (PARTITION BY run_id) AS g FROM f),
cc AS (SELECT x.run_id, x.w, y.bin - x.bin AS lag, round(sum(x.c * y.g), 9) AS v FROM z x JOIN z y ON x.run_id = y.run_id GROUP BY ALL)
SELECT run_id, round(arg_min(lag * w / 1e6, (-v, lag)), 3) AS lag_ms FROM cc GROUP BY run_id""")
def _(spark, d):
    return I.xcorr_binned(spans(spark, d)).select("run_id", F.round("lag_ms", 3).alias("lag_ms"))


@query("S15", "ingest_cap", f"""WITH {PROGRESS}, s AS (SELECT source, rid, row_number() OVER (PARTITION BY source ORDER BY sequence) AS pos, count(*) OVER (PARTITION BY source) AS n FROM progress)
SELECT source, min(CASE WHEN pos <= 1000 THEN rid END) AS first_rid, max(CASE WHEN pos <= 1000 THEN rid END) AS last_rid, least(max(n), 1000)::BIGINT AS retained, greatest(max(n) - 1000, 0)::BIGINT AS omitted FROM s GROUP BY source""")
def _(spark, d):
    kept, facts = I.ingest_cap(progress(spark, d), "source", ["sequence"], 1000)
    return kept.groupBy("source").agg(F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid")).join(facts, "source")


@query("P9", "pin_events", f"""WITH {PROGRESS}, m AS (SELECT source, list({{'b': (k + 10)::BIGINT, 'used': 0::BIGINT, 'n': 0::BIGINT, 'lo': sequence::BIGINT, 'hi': sequence::BIGINT}} ORDER BY sequence) AS rs FROM progress WHERE clock = 'c1' AND time BETWEEN 1704500000000000 AND 1706000000000000 GROUP BY source),
x AS (SELECT source, len(rs) AS matched, list_reduce(list_prepend({{'b': 0::BIGINT, 'used': 0::BIGINT, 'n': 0::BIGINT, 'lo': NULL::BIGINT, 'hi': NULL::BIGINT}}, rs),
 lambda a, r: CASE WHEN a.used + r.b <= 20000 THEN {{'b': 0::BIGINT, 'used': a.used + r.b, 'n': a.n + 1, 'lo': coalesce(a.lo, r.lo), 'hi': r.hi}} ELSE a END) AS s FROM m)
SELECT source, matched, matched - s.n AS lost, s.lo AS first_sequence, s.hi AS last_sequence FROM x""")
def _(spark, d):
    e = progress(spark, d).withColumn("bytes", F.col("k") + 10)
    return I.pin_events(e, {"clock": "c1", "time": (1704500000000000, 1706000000000000), "max_bytes": 20000})[1]


# Event 0 of each rule breaks it on purpose, so that every reason occurs.
BROKEN = f"""{PROGRESS}, ev AS (SELECT rid, CASE WHEN k = 1 THEN '' ELSE source END AS source, CASE WHEN k = 2 THEN -sequence - 1 ELSE sequence END AS sequence,
 CASE WHEN k = 3 THEN 'teleport' ELSE boundary END AS boundary, CASE WHEN k = 4 THEN '' ELSE clock END AS clock, CASE WHEN k = 5 THEN NULL ELSE time END AS time,
 CASE WHEN k = 6 THEN -1 ELSE uncertainty END AS uncertainty, CASE WHEN k = 7 THEN 'guessed' ELSE 'explicit' END AS certainty, CASE WHEN k = 8 THEN 'fortnight' ELSE 'us' END AS unit,
 CASE WHEN k = 9 THEN -3 WHEN k = 10 THEN NULL ELSE 0 END AS drops, complete FROM progress)"""


@query("P1", "validate_events", f"""WITH {BROKEN} SELECT rid, concat_ws(';', CASE WHEN source = '' THEN 'source' END, CASE WHEN sequence < 0 THEN 'sequence' END, CASE WHEN boundary = 'teleport' THEN 'boundary' END,
 CASE WHEN clock = '' THEN 'clock' END, CASE WHEN time IS NULL THEN 'time' END, CASE WHEN uncertainty < 0 THEN 'uncertainty' END, CASE WHEN certainty = 'guessed' THEN 'link certainty' END,
 CASE WHEN unit = 'fortnight' THEN 'time unit' END, CASE WHEN drops < 0 THEN 'drops' END, CASE WHEN complete AND drops IS DISTINCT FROM 0 THEN 'coverage conflict' END) AS reasons FROM ev""")
def _(spark, d):
    e = progress(spark, d).selectExpr(
        "rid", "case when k = 1 then '' else source end source_instance", "case when k = 2 then -sequence - 1 else sequence end sequence", "case when k = 3 then 'teleport' else boundary end boundary",
        "case when k = 4 then '' else clock end clock", "cast(case when k = 5 then null else time end as double) time", "case when k = 6 then -1 else uncertainty end uncertainty",
        "array(named_struct('relation', 'delivery', 'identity', identity, 'certainty', case when k = 7 then 'guessed' else 'explicit' end)) links", "map('time', case when k = 8 then 'fortnight' else 'us' end) units",
        "named_struct('complete', complete, 'drops', cast(case when k = 9 then -3 when k = 10 then null else 0 end as bigint)) coverage", "array('') limitations", "map('token', cast(token as string)) values")
    return V.with_reasons(e, V.EVENT_RULES).select("rid", F.concat_ws(";", "reasons").alias("reasons"))


@query("P2", "validate_contracts", """WITH c AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN p_type = p_brand OR p_size % 5 = 0 THEN 'mediator matched' END, CASE WHEN p_size % 7 = 0 THEN 'exposure matched' END, CASE WHEN p_size <= 1 OR p_size >= 49 THEN 'alpha' END,
 CASE WHEN p_retailprice < 901 THEN 'threshold' END, CASE WHEN p_size % 3 = 0 THEN 'selection' END) AS reasons FROM c""")
def _(spark, d):
    c = table(spark, d, "part").selectExpr(
        "p_partkey", "array(p_type, p_brand, case when p_size % 7 = 0 then 'exp' else 'x' end) comparable", "array(case when p_size % 5 = 0 then p_brand else 'rtt' end) mediators", "'exp' exposure",
        "case when p_size <= 1 then 0.0d when p_size >= 49 then 1.0d else 0.05d end alpha", "p_retailprice - 901 threshold", "case p_size % 3 when 0 then 'both' when 1 then 'exploratory' else 'confirmatory' end selection")
    return V.with_reasons(c, V.CONTRACT_RULES).select("p_partkey", F.concat_ws(";", "reasons").alias("reasons"))


@query("P3", "required_fields", "SELECT d.doc_id, quality IS NULL AS rejected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    ok, bad = V.required_fields(j, ["text", "quality", "toxic"])
    return ok.select("doc_id", F.lit(False).alias("rejected")).unionByName(bad.select("doc_id", F.lit(True).alias("rejected")))


@query("P7", "downgrade_coverage", f"""WITH {PROGRESS}, m AS (SELECT source, max(k) > 98 AS lossy, max(k) AS drops FROM progress GROUP BY ALL)
SELECT rid, complete AND NOT lossy AS complete, CASE WHEN lossy THEN drops ELSE 0 END AS drops, CASE WHEN lossy THEN 1 ELSE 0 END AS n_limits FROM progress JOIN m USING (source)""")
def _(spark, d):
    e = progress(spark, d)
    m = e.groupBy("source").agg((F.max("k") <= 98).alias("export_complete"), F.max("k").alias("export_dropped"))
    m = m.withColumn("export_dropped", F.when(F.col("export_complete"), F.lit(0)).otherwise(F.col("export_dropped")))
    r = V.downgrade_coverage(e.withColumns({"drops": F.lit(0).cast("long"), "limitations": F.array().cast("array<string>")}), m, "source")
    return r.select("rid", "complete", "drops", F.size("limitations").alias("n_limits"))


def pairs_of_events(spark, d):
    e = progress(spark, d)
    s = O.scan(e, ["identity"], ["time", "rid"], p=("lag", F.struct("rid", "time", "uncertainty", "clock", "k", "boundary")))
    return s.where("p is not null")


PE = f"""{PROGRESS}, w AS (SELECT *, lag(rid) OVER o AS prid, lag(time) OVER o AS pt, lag(uncertainty) OVER o AS pu, lag(k) OVER o AS pk, lag(boundary) OVER o AS pb FROM progress WINDOW o AS (PARTITION BY identity ORDER BY time, rid)),
pe AS (SELECT * FROM w WHERE prid IS NOT NULL)"""


@query("F3", "local_interval", f"""WITH {PE} SELECT rid, CASE WHEN pk % 4 = k % 4 AND time - pt - 1e9::BIGINT + uncertainty + pu >= 0 THEN time - pt - 1e9::BIGINT - uncertainty - pu END AS lo,
 CASE WHEN pk % 4 = k % 4 AND time - pt - 1e9::BIGINT + uncertainty + pu >= 0 THEN time - pt - 1e9::BIGINT + uncertainty + pu END AS hi FROM pe""")
def _(spark, d):
    p = pairs_of_events(spark, d)
    iv = X.local_interval(F.col("p.time") + 1_000_000_000, F.col("p.uncertainty"), F.col("time"), F.col("uncertainty"), F.col("p.k") % 4 == F.col("k") % 4)
    return p.select("rid", iv.alias("iv")).select("rid", "iv.lo", "iv.hi")


@query("F4", "mapped_interval", f"""WITH {PE},
q AS (SELECT rid, time, uncertainty, pt - pu AS a, pt + pu AS b, pk % 3 = 0 AS none FROM pe),
x AS (SELECT *, greatest(a * 1, a * 2, b * 1, b * 2) + pk2 AS mx, least(a * 1, a * 2, b * 1, b * 2) - pk2 AS mn FROM (SELECT *, 5000 AS pk2 FROM q))
SELECT rid, CASE WHEN NOT none AND a >= 1704400000000000 AND b <= 1706300000000000 AND time + uncertainty - mn >= 0 THEN time - uncertainty - mx END AS lo,
 CASE WHEN NOT none AND a >= 1704400000000000 AND b <= 1706300000000000 AND time + uncertainty - mn >= 0 THEN time + uncertainty - mn END AS hi FROM x""")
def _(spark, d):
    p = pairs_of_events(spark, d)
    m = F.when(F.col("p.k") % 3 != 0, F.struct(*[F.lit(v).alias(n) for n, v in (("valid_lo", 1704400000000000), ("valid_hi", 1706300000000000), ("rate_lo", 1), ("rate_hi", 2), ("off_lo", -5000), ("off_hi", 5000))]))
    iv = X.mapped_interval(F.col("p.time"), F.col("p.uncertainty"), F.col("time"), F.col("uncertainty"), m)
    return p.select("rid", iv.alias("iv")).select("rid", "iv.lo", "iv.hi")


@query("F5", "compose_clocks", """WITH m AS (SELECT s_suppkey AS id, s_nationkey AS source, (s_nationkey + 1 + s_suppkey % 2) % 25 AS target, 0.9 + s_suppkey % 3 * 0.1 AS r0, 1.1 + s_suppkey % 3 * 0.1 AS r1,
 -10.0 AS o0, s_acctbal / 100 AS o1, 0.0 AS v0, 1000.0 + s_suppkey % 7 * 100 AS v1 FROM supplier),
j AS (SELECT a.id AS first_id, b.id AS second_id, a.r0 AS ar0, a.r1 AS ar1, a.o0 AS ao0, a.o1 AS ao1, b.r0 AS br0, b.r1 AS br1, b.o0 AS bo0, b.o1 AS bo1, a.v0, a.v1, b.v0 AS w0, b.v1 AS w1 FROM m a JOIN m b ON a.target = b.source),
k AS (SELECT *, least(v0 * ar0 + ao0, v0 * ar0 + ao1, v0 * ar1 + ao0, v0 * ar1 + ao1, v1 * ar0 + ao0, v1 * ar0 + ao1, v1 * ar1 + ao0, v1 * ar1 + ao1) AS mn,
 greatest(v0 * ar0 + ao0, v0 * ar0 + ao1, v0 * ar1 + ao0, v0 * ar1 + ao1, v1 * ar0 + ao0, v1 * ar0 + ao1, v1 * ar1 + ao0, v1 * ar1 + ao1) AS mx FROM j)
SELECT first_id, second_id, round(least(ar0 * br0, ar0 * br1, ar1 * br0, ar1 * br1), 6)::DOUBLE AS rate_lo, round(greatest(ar0 * br0, ar0 * br1, ar1 * br0, ar1 * br1), 6)::DOUBLE AS rate_hi,
 round(least(ao0 * br0, ao0 * br1, ao1 * br0, ao1 * br1) + bo0, 6)::DOUBLE AS off_lo, round(greatest(ao0 * br0, ao0 * br1, ao1 * br0, ao1 * br1) + bo1, 6)::DOUBLE AS off_hi FROM k WHERE mn >= w0 - 20 AND mx <= w1 + 600""")
def _(spark, d):
    m = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_nationkey source", "(s_nationkey + 1 + s_suppkey % 2) % 25 target", "0.9d + s_suppkey % 3 * 0.1d rate_lo", "1.1d + s_suppkey % 3 * 0.1d rate_hi",
                                               "-10.0d off_lo", "s_acctbal / 100 off_hi", "0.0d valid_lo", "1000.0d + s_suppkey % 7 * 100 valid_hi")
    wide = m.withColumn("valid_lo", F.col("valid_lo") - 20).withColumn("valid_hi", F.col("valid_hi") + 600)
    c = V.compose_clocks(m, wide)
    return c.select("first_id", "second_id", *[F.round(x, 6).alias(x) for x in ("rate_lo", "rate_hi", "off_lo", "off_hi")])


@query("F6", "residual", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 1 AS c0, l_quantity + 1 AS c1, l_tax * 400 AS s0, l_tax * 400 + 5 AS s1, l_returnflag <> 'N' AS nested FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nested THEN round(c0 - s1 * 1.1, 4) END AS raw_lo, CASE WHEN nested THEN round(c1 - s0 * .9, 4) END AS raw_hi,
 CASE WHEN nested AND c0 - s1 * 1.1 >= 0 THEN round(c0 - s1 * 1.1, 4) END AS lo FROM x""")
def _(spark, d):
    l = table(spark, d, "lineitem")
    q, t = F.col("l_quantity"), F.col("l_tax") * 400
    r = X.residual(q - 1, q + 1, t, t + 5, F.lit(0.9), F.lit(1.1), F.col("l_returnflag") != "N")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("r.raw.lo", 4).alias("raw_lo"), F.round("r.raw.hi", 4).alias("raw_hi"), F.round("r.kept.lo", 4).alias("lo"))


@query("F7", "unwrap_seq", """WITH x AS (SELECT event_id, (epoch_us(ts) * 7) % 4294967296 AS v, epoch_us(ts) * 3 AS c FROM events), y AS (SELECT *, c // 4294967296 * 4294967296 AS b FROM x),
z AS (SELECT *, arg_min(n, abs(n - c)) AS best FROM (SELECT event_id, c, unnest([b + v - 4294967296, b + v, b + v + 4294967296]) AS n FROM y) GROUP BY event_id, c, n)
SELECT event_id, min(CASE WHEN abs(best - c) < 2147483648 THEN best END) AS unwrapped FROM z GROUP BY event_id""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{micros('ts')} us").selectExpr("event_id", "(us * 7) % 4294967296 v", "us * 3 c")
    return e.select("event_id", X.unwrap_seq(F.col("v"), F.col("c")).alias("unwrapped"))


@query("F8", "stratum", """SELECT c_custkey, c_mktsegment || '|' || ((c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 7500)::INT) AS stratum FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", X.numeric_bin(F.col("c_acctbal"), [0, 2500, 7500]).cast("string")).alias("stratum"))


@query("F9", "context_id", "SELECT c_custkey, left(sha256(c_name || '|' || c_mktsegment || '|' || c_nationkey), 16) AS context_id FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.context_id("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("context_id"))


@query("F10", "canonical_hash")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.canonical_hash("o_totalprice", "o_custkey", "o_orderstatus").alias("digest"))


@query("F11", "tail_llr", """SELECT arm, round(ln((k1 + 1) / (n1 + 2)) - ln((k0 + 1) / (n0 + 2)), 9) AS llr FROM (SELECT l_returnflag AS arm, count(*) FILTER (l_quantity > 30 AND l_linestatus = 'O') AS k1, count(*) FILTER (l_linestatus = 'O') AS n1,
 count(*) FILTER (l_quantity > 30 AND l_linestatus = 'F') AS k0, count(*) FILTER (l_linestatus = 'F') AS n0 FROM lineitem GROUP BY ALL)""")
def _(spark, d):
    on = F.col("l_linestatus") == "O"
    big = F.col("l_quantity") > 30
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(*[F.count_if(c).alias(n) for n, c in (("k1", big & on), ("n1", on), ("k0", big & ~on), ("n0", ~on))])
    return g.select("arm", F.round(X.tail_llr(*[F.col(c) for c in ("k1", "n1", "k0", "n0")]), 9).alias("llr"))
