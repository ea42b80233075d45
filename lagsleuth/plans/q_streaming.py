"""Streaming queries: the given tables as file streams, run until nothing is left."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ops as R
from .registry import query
from .views import POPULATION, PROGRESS, SPANS, micros, progress, spans

C = F.col
HOUR = 3600 * 10**6


def stream_progress(spark, d):
    """The progress view over the events stream, with its event time as ``at``."""
    return progress(spark, d, R.stream_table(spark, d, "events")).withColumn("at", F.timestamp_micros("time"))


@query("R1", "stream_events", f"WITH {PROGRESS} SELECT boundary, k % 10 = 0 AS rejected, count(*) AS n FROM progress GROUP BY ALL")
def _(spark, d):
    p = stream_progress(spark, d)
    e = p.select(C("source").alias("source_instance"), F.when(C("k") % 10 == 0, -1).otherwise(C("sequence")).alias("sequence"), "clock", C("time").cast("double").alias("time"), "uncertainty", "boundary", F.create_map(F.lit("token"), C("token").cast("string")).alias("values"),
                 F.create_map(F.lit("time"), F.lit("us")).alias("units"), F.array(F.struct(F.lit("delivery").alias("relation"), "identity", F.lit("explicit").alias("certainty"))).alias("links"), F.array().cast("array<string>").alias("limitations"),
                 F.struct("complete", F.lit(0).cast("long").alias("drops")).alias("coverage"))
    ok, bad = R.stream_events(e)
    return ok.select("boundary", F.lit(False).alias("rejected")).unionByName(bad.select("boundary", F.lit(True).alias("rejected"))).groupBy("boundary", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query("R2", "stream_dedup", f"WITH {POPULATION} SELECT id, count(DISTINCT id) AS n FROM population GROUP BY id")
def _(spark, d):
    docs = R.stream_table(spark, d, "documents").select(F.md5("text").alias("id"), F.timestamp_micros(C("doc_id") * 1000).alias("at"))
    out = R.run_available(R.stream_dedup(docs, "at", ["id"], "3650 days"), "dedup")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


RS = """rs AS (SELECT epoch_us(ts) AS time, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'timeout' ELSE 'error' END AS status, value, event_id FROM events)"""


@query("R3", "stream_population", f"""WITH {RS}, m AS (SELECT *, time // 86400000000 AS day, CASE WHEN event_id % 5 = 0 THEN NULL WHEN status = 'ok' THEN value > 10 WHEN status = 'timeout' AND value >= 10 THEN true END AS missed FROM rs)
SELECT day * 86400000000 AS block, count(*) AS eligible, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (missed) AS missed, count(*) FILTER (NOT missed) AS on_time, count(*) FILTER (missed IS NULL) AS unknown_deadline
FROM m WHERE (day + 1) * 86400000000 <= (SELECT max(time) // 1000 * 1000 FROM rs) - 3600000000 GROUP BY day""")
def _(spark, d):
    e = R.stream_table(spark, d, "events")
    r = e.select(F.timestamp_micros(F.expr(micros("ts"))).alias("at"), F.expr("case event_type when 'click' then 'ok' when 'view' then 'timeout' else 'error' end status"), (C("value") * 1000).cast("long").alias("finish_ns"), F.when(C("event_id") % 5 > 0, F.lit(10000)).alias("deadline_ns"))
    w = R.run_available(R.stream_population(r, "at"), "population")
    return w.select(F.unix_micros("w.start").alias("block"), "eligible", "ok", "missed", "on_time", "unknown_deadline")


@query("R4", "stream_sessions", f"""WITH {PROGRESS}, m AS (SELECT source, time, rid FROM progress WHERE boundary = 'recovery'), g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY source ORDER BY time, rid) < 3600000000 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY time, rid) AS ep FROM g) SELECT source, min(time) AS started, max(time) + 3600000000 AS ended, count(*) AS misses FROM s GROUP BY source, ep HAVING max(time) + 3600000000 <= (SELECT max(time) // 1000 * 1000 FROM m) - 3600000000""")
def _(spark, d):
    w = R.run_available(R.stream_sessions(stream_progress(spark, d).where("boundary = 'recovery'"), "at", ["source"]), "sessions")
    return w.select("source", F.unix_micros("w.start").alias("started"), F.unix_micros("w.end").alias("ended"), "misses")


@query("R5", "stream_join", f"""WITH {PROGRESS}, c AS (SELECT rid, identity, time FROM progress WHERE boundary = 'release'), s AS (SELECT rid, identity, time FROM progress WHERE boundary = 'submit'),
mx AS (SELECT least((SELECT max(time) FROM c), (SELECT max(time) FROM s)) // 1000 * 1000 - 7200000000 AS w)
SELECT c.rid, s.rid AS server_rid FROM c LEFT JOIN s ON s.identity = c.identity AND s.time >= c.time AND s.time <= c.time + 3600000000, mx WHERE s.rid IS NOT NULL OR c.time + 3600000000 < w - 1000000""")
def _(spark, d):
    p = stream_progress(spark, d)
    c = p.where("boundary = 'release'").select("rid", "identity", "at")
    s = stream_progress(spark, d).where("boundary = 'submit'").select(C("rid").alias("server_rid"), "identity", C("at").alias("s_at"))
    out = R.run_available(R.stream_join(c, s, "identity", "at", "s_at"), "join")
    edge = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('signup', 'purchase')").groupBy("event_type").agg(F.max(F.expr(micros("ts"))).alias("m")).agg(F.floor(F.min("m") / 1000) * 1000 - 2 * HOUR).scalar()
    return out.where(C("server_rid").isNotNull() | (F.unix_micros("at") + HOUR < edge - 1_000_000)).select("rid", "server_rid")


HOLD = 7 * 24 * HOUR
PAIRED = f"""{PROGRESS}, kinds AS (SELECT unnest(['queue_enqueue', 'release']) AS s, unnest(['queue_dequeue', 'submit']) AS e, unnest(['queue_sojourn', 'dispatch_delay']) AS kind),
ro AS (SELECT p.*, kind, boundary = s AS is_start FROM progress p JOIN kinds ON boundary IN (s, e)), mk AS (SELECT max(time) // 1000 * 1000 - {HOUR} AS m FROM ro),
w AS (SELECT *, coalesce(lag(is_start) OVER o AND time - lag(time) OVER o <= {HOLD}, false) AS waits, lag(rid) OVER o AS prid, lag(time) OVER o AS pt, lead(time) OVER o AS nt
FROM ro, mk WHERE time <= m WINDOW o AS (PARTITION BY identity, clock, token, kind ORDER BY time, rid)), v AS (SELECT *, lag(waits AND is_start) OVER (PARTITION BY identity, clock, token, kind ORDER BY time, rid) AS again FROM w)"""


def pairing(spark, d):
    k = F.expr("case when boundary in ('queue_enqueue', 'queue_dequeue') then 'queue_sojourn' when boundary in ('release', 'submit') then 'dispatch_delay' end")
    p = stream_progress(spark, d).withColumn("kind", k).where("kind is not null").select("identity", "clock", "token", "kind", C("boundary").isin("queue_enqueue", "release").alias("is_start"), "rid", "time", "at")
    return R.run_available(R.stream_pairing(p, "at", hold=HOLD), "pairing")


@query("R6", "stream_pairing", f"""WITH {PAIRED} SELECT identity, clock, token, kind, prid AS start_rid, rid AS end_rid, time - pt AS duration, coalesce(again, false) AS ambiguous FROM v WHERE NOT is_start AND waits""")
def _(spark, d):
    return pairing(spark, d).where("outcome = 'pair'").drop("outcome")


@query("R6", "stream_unmatched", f"""WITH {PAIRED} SELECT identity, clock, token, kind, 'no start' AS outcome, NULL AS start_rid, rid AS end_rid FROM v WHERE NOT is_start AND NOT waits
UNION ALL SELECT identity, clock, token, kind, 'replaced', prid, rid FROM v WHERE is_start AND waits
UNION ALL SELECT identity, clock, token, kind, 'timed out', rid, NULL FROM v WHERE is_start AND (nt - time > {HOLD} OR nt IS NULL AND time + {HOLD} < m)""")
def _(spark, d):
    return pairing(spark, d).where("outcome <> 'pair'").select("identity", "clock", "token", "kind", "outcome", "start_rid", "end_rid")


RING_BLOCK, RING_HOLD = 256, 3 * HOUR


@query("R7", "stream_hindsight", f"""WITH {PROGRESS}, p AS (SELECT CAST(make_timestamp(time) AS DATE)::VARCHAR AS source, sequence, rid, time, k + 50 AS bytes, boundary = 'recovery' AND k > 80 AS trig FROM progress WHERE complete), mk AS (SELECT max(time) // 1000 * 1000 - {HOUR} AS m FROM p),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY sequence) AS used FROM p, mk WHERE time <= m),
t AS (SELECT * FROM s WHERE trig AND (time + {RING_HOLD} < m OR EXISTS (SELECT 1 FROM s e WHERE e.source = s.source AND e.sequence >= s.sequence + 2 AND s.sequence // {RING_BLOCK} IN (e.sequence // {RING_BLOCK}, (e.sequence + 5) // {RING_BLOCK}, (e.sequence - 2) // {RING_BLOCK})))),
j AS (SELECT t.source, t.rid AS trigger_rid, e.rid, e.sequence - t.sequence AS "offset", CASE WHEN e.sequence > t.sequence THEN e.time <= t.time + {RING_HOLD} ELSE t.used - e.used + e.bytes <= 420 AND t.time - e.time <= 20000000000 END AS fits
FROM t JOIN s e ON e.source = t.source AND e.sequence BETWEEN t.sequence - 5 AND t.sequence + 2),
n AS (SELECT trigger_rid, count(*) FILTER (fits) AS kept, count(*) FILTER (NOT fits AND "offset" <= 0) AS evicted, 8 - count(*) FILTER (fits OR "offset" <= 0) AS missing FROM j GROUP BY 1)
SELECT source, j.trigger_rid, rid, "offset", kept, evicted, missing FROM j JOIN n USING (trigger_rid) WHERE fits""")
def _(spark, d):
    p = stream_progress(spark, d).where("complete").selectExpr("cast(date_add(date'1970-01-01', cast(time div 86400000000 as int)) as string) source", "sequence", "rid", "time", "k + 50 bytes", "boundary = 'recovery' and k > 80 is_trigger", "at")
    return R.run_available(R.stream_hindsight(p, "at", 6, 2, 420, 20_000_000_000, hold=RING_HOLD, block=RING_BLOCK), "hindsight")


@query("R8", "stream_lifecycle")
def _(spark, d):
    p = stream_progress(spark, d).select(C("identity").cast("long").alias("id"), "rid", "time", F.expr("case k % 3 when 0 then 'INFERRED' when 1 then 'TESTED' else 'VERIFIED' end to_status"), (C("k") % 4 > 0).alias("linked"), (C("k") % 5 > 0).alias("measured"), "at")
    return R.run_available(R.stream_lifecycle(p, "at"), "lifecycle")


@query("R9", "stream_baseline_z", f"""WITH {SPANS}, b AS (SELECT stage, name, median(dur_ms) AS med FROM spans WHERE arm = 'reference' GROUP BY ALL), bm AS (SELECT stage, name, med, median(abs(dur_ms - med)) AS mad FROM spans JOIN b USING (stage, name) WHERE arm = 'reference' GROUP BY ALL),
i AS (SELECT stage, name, run_id, count(*) AS n_inc, median(dur_ms) AS inc FROM spans WHERE arm = 'current' AND epoch_us(CAST(run_id AS TIMESTAMP)) + {24 * HOUR} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - {HOUR} FROM events) GROUP BY ALL)
SELECT stage, name, run_id AS block, n_inc, round((inc - med) / (1.4826 * mad + .001 + .05 * abs(med)), 6) AS z FROM i JOIN bm USING (stage, name)""")
def _(spark, d):
    v = spans(spark, d, R.stream_table(spark, d, "events")).where("arm = 'current'").select("stage", "name", C("dur_ms").alias("value"), F.timestamp_micros(F.expr("start_ns div 1000")).alias("at"))
    base = spans(spark, d).where("arm = 'reference'").select("stage", "name", C("dur_ms").alias("value"))
    z = R.stream_baseline_z(v, "at", base)
    return z.select("stage", "name", F.substring("block", 1, 10).alias("block"), "n_inc", F.round("z", 6).alias("z"))
