"""Span and comparison queries over the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import STAGES, kernel_short_name
from ..operators import compare as C, quantiles as Q, spans as S
from ..operators.storage import materialize
from .registry import query
from .views import SPANS, spans, table


def r6(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def traced(spark, d):
    """Spans whose host rows with an even k are launches."""
    s = spans(spark, d)
    return s.withColumn("name", F.when((F.col("kind") == "cpu_launch") & (F.col("k") % 2 == 0), "cudaLaunchKernel").otherwise(F.col("name")))


TRACED = SPANS + """, traced AS (SELECT * REPLACE (CASE WHEN kind = 'cpu_launch' AND k % 2 = 0 THEN 'cudaLaunchKernel' ELSE name END AS name) FROM spans)"""

Z = "({0} - {1}) / (1.4826 * {2} + CASE WHEN stage = 'queue' THEN 0.25 ELSE 0.001 + 0.05 * abs({1}) END)"

NAMED_Z = f"""WITH {SPANS},
b AS (SELECT stage, name, count(*) AS n_base, median(dur_ms) AS base_med FROM spans WHERE arm = 'reference' GROUP BY ALL),
bm AS (SELECT stage, name, n_base, base_med, median(abs(dur_ms - base_med)) AS base_mad FROM b
  JOIN (SELECT * FROM spans WHERE arm = 'reference') USING (stage, name) GROUP BY ALL),
i AS (SELECT stage, name, count(*) AS n_inc, median(dur_ms) AS inc_med FROM spans WHERE arm = 'current' GROUP BY ALL),
g AS (SELECT *, inc_med - base_med AS delta, {Z.format('inc_med', 'base_med', 'base_mad')} AS z FROM i JOIN bm USING (stage, name))"""


def named_z(spark, d):
    s = spans(spark, d).withColumn("value", F.col("dur_ms"))
    return C.matched_z(s.where("arm = 'current'"), s.where("arm = 'reference'"), ["stage", "name"])


@query("C1", "matched_z", NAMED_Z + """ SELECT stage, name, n_base, n_inc, round(base_med, 6) AS base_med,
  round(base_mad, 6) AS base_mad, round(inc_med, 6) AS inc_med, round(delta, 6) AS delta, round(z, 6) AS z FROM g""")
def _(spark, d):
    return r6(named_z(spark, d), "base_med", "base_mad", "inc_med", "delta", "z")


@query("T1", "rank_stages", NAMED_Z + """, w AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY z DESC, delta DESC, name) AS rn FROM g)
SELECT stage, name, round(z, 6) AS z, round(delta, 6) AS delta, row_number() OVER (ORDER BY z DESC, delta DESC, stage) AS rank FROM w WHERE rn = 1""")
def _(spark, d):
    return r6(C.rank_stages(C.stage_winner(named_z(spark, d), ["stage"])), "z", "delta")


@query("C3", "unknown_mass", NAMED_Z + """, w AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY z DESC, delta DESC, name) AS rn FROM g)
SELECT name, round(1 / (1 + sum(greatest(0, z - 2))), 6) AS unknown_mass, count(*) FILTER (z > 2) AS candidates,
  count(*) FILTER (abs(z) <= 2) AS contradicting FROM g GROUP BY name""")
def _(spark, d):
    return r6(C.unknown_mass(named_z(spark, d), ["name"]), "unknown_mass")


@query("A1", "median_mad", f"""WITH {SPANS}, m AS (SELECT run_id, name, count(*) AS n, median(dur_ms) AS med FROM spans GROUP BY ALL)
SELECT run_id, name, n, round(med, 6) AS med, round(median(abs(dur_ms - med)), 6) AS mad FROM spans JOIN m USING (run_id, name) GROUP BY ALL""")
def _(spark, d):
    return r6(Q.median_mad(spans(spark, d), ["run_id", "name"], "dur_ms"), "med", "mad")


@query("A2", "latency_stats", f"""WITH {SPANS}, m AS (SELECT stage, count(*) AS n, median(dur_ms) AS p50,
  quantile_cont(dur_ms, 0.95) AS p95, quantile_cont(dur_ms, 0.99) AS p99 FROM spans GROUP BY ALL)
SELECT stage, n, round(p50, 6) AS p50, round(median(abs(dur_ms - p50)), 6) AS mad, round(p95, 6) AS p95, round(p99, 6) AS p99,
  round(p95 - p50, 6) AS tail95, round(p99 - p50, 6) AS tail99 FROM spans JOIN m USING (stage) GROUP BY stage, n, p50, p95, p99""")
def _(spark, d):
    return r6(Q.latency_stats(spans(spark, d), ["stage"], "dur_ms"), "p50", "mad", "p95", "p99", "tail95", "tail99")


@query("A3", "p99_nearest", f"WITH {SPANS} SELECT run_id, stage, count(*) AS n, quantile_disc(dur_ms, 0.99) AS p99 FROM spans GROUP BY ALL")
def _(spark, d):
    return Q.p99_nearest(spans(spark, d), ["run_id", "stage"], "dur_ms")


@query("A4", "span_regression", f"""WITH {SPANS}, r AS (SELECT arm, run_id, (max(end_ns) - min(start_ns)) / 1e6 AS span_ms,
  coalesce(quantile_disc(dur_ns / 1e6, 0.99) FILTER (kind = 'gpu_kernel'), 0) AS p99_ms FROM spans GROUP BY ALL),
b AS (SELECT median(span_ms) AS s, median(p99_ms) AS p FROM r WHERE arm = 'reference')
SELECT run_id, round(span_ms, 3) AS span_ms, round(p99_ms, 3) AS p99_ms, round(span_ms - s, 3) AS span_delta_ms,
  round(p99_ms - p, 3) AS p99_delta_ms FROM r, b WHERE arm = 'current'""")
def _(spark, d):
    s = spans(spark, d)
    return r6(C.span_regression(s.where("arm = 'current'"), s.where("arm = 'reference'")),
              "span_ms", "p99_ms", "span_delta_ms", "p99_delta_ms", digits=3)


@query("W1", "host_gaps", f"""WITH {SPANS}, h AS (SELECT run_id, event_id, end_ns,
  lead(start_ns) OVER (PARTITION BY run_id ORDER BY start_ns, end_ns, event_id) AS nx FROM spans WHERE kind = 'cpu_launch')
SELECT run_id, event_id, round(greatest(0, (nx - end_ns) / 1e6), 6) AS gap_ms, round((nx - end_ns) / 1e6, 6) AS raw_ms FROM h WHERE nx IS NOT NULL""")
def _(spark, d):
    raw = S.host_gaps(spans(spark, d), clamp=False)
    return raw.select("run_id", "event_id", F.round(F.greatest(F.lit(0.0), "gap_ms"), 6).alias("gap_ms"),
                      F.round("gap_ms", 6).alias("raw_ms"))


GAPS = TRACED + """, hl AS (SELECT run_id, cid, max(CASE WHEN name = 'cudaLaunchKernel' THEN 1 ELSE 0 END) AS has FROM traced
  WHERE kind = 'cpu_launch' GROUP BY ALL),
lg AS (SELECT g.run_id, g.event_id, coalesce(greatest(0, g.start_ns - max(h.end_ns)), 0) AS launch_gap_ns
  FROM (SELECT * FROM traced WHERE kind = 'gpu_kernel') g LEFT JOIN hl ON hl.run_id = g.run_id AND hl.cid = g.cid
  LEFT JOIN traced h ON h.kind = 'cpu_launch' AND h.run_id = g.run_id AND h.cid = g.cid AND h.end_ns <= g.start_ns
    AND (hl.has = 0 OR h.name = 'cudaLaunchKernel') GROUP BY g.run_id, g.event_id, g.start_ns)"""


@query("J1", "launch_gaps", f"WITH {GAPS} SELECT run_id, event_id, launch_gap_ns FROM lg")
def _(spark, d):
    return S.launch_gaps(traced(spark, d)).select("run_id", "event_id", "launch_gap_ns")


L1 = """kk AS (SELECT * FROM spans WHERE kind = 'gpu_kernel'),
dq AS (SELECT run_id, count(DISTINCT stream_id) AS q FROM kk GROUP BY ALL),
l1 AS (SELECT g.run_id, g.event_id, g.end_ns AS ts_ns, greatest(1, any_value(q)) AS queue_depth, count(h.event_id) AS active_kernels,
  greatest(1, count(DISTINCT h.stream_id)) AS active_streams FROM kk g JOIN dq ON dq.run_id = g.run_id
  LEFT JOIN kk h ON h.run_id = g.run_id AND h.start_ns <= g.start_ns AND g.start_ns < h.end_ns GROUP BY g.run_id, g.event_id, g.end_ns)"""


@query("W2", "concurrency", f"WITH {SPANS}, {L1} SELECT * FROM l1")
def _(spark, d):
    return S.concurrency(spans(spark, d))


SV = f"""{GAPS}, {L1.replace('FROM spans', 'FROM traced')},
hg AS (SELECT run_id, (lead(start_ns) OVER (PARTITION BY run_id ORDER BY start_ns, end_ns, event_id) - end_ns) / 1e6 AS gap FROM traced WHERE kind = 'cpu_launch'),
sv AS (SELECT run_id, 'transport' AS stage, 'pooled' AS name, dur_ns / 1e6 AS value FROM traced WHERE kind = 'transfer'
 UNION ALL SELECT run_id, 'preprocess', 'pooled', (end_ns - start_ns) / 1e6 FROM traced WHERE kind = 'cpu_launch'
 UNION ALL SELECT run_id, 'queue', 'pooled', queue_depth FROM l1
 UNION ALL SELECT run_id, 'cpu', 'pooled', greatest(0, gap) FROM hg WHERE gap IS NOT NULL
 UNION ALL SELECT run_id, 'scheduler', 'pooled', launch_gap_ns / 1e6 FROM lg
 UNION ALL SELECT run_id, 'scheduler', 'pooled', dur_ns / 1e6 FROM traced WHERE kind = 'sync_edge'
 UNION ALL SELECT run_id, 'gpu', name, dur_ns / 1e6 FROM traced WHERE kind = 'gpu_kernel'
 UNION ALL SELECT run_id, unnest(['postprocess', 'action']), 'pooled', 0 FROM traced WHERE kind = 'cpu_launch')"""


@query("W3", "stage_values", f"WITH {SV} SELECT run_id, stage, name, count(*) AS n, round(sum(value), 3) AS total, round(max(value), 6) AS top FROM sv GROUP BY ALL")
def _(spark, d):
    v = S.stage_values(traced(spark, d))
    return v.groupBy("run_id", "stage", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"),
                                                    F.round(F.max("value"), 6).alias("top"))


DZ = f"""WITH {SV}, arms AS (SELECT *, run_id < '2024-01-16' AS ref FROM sv),
pb0 AS (SELECT stage, count(*) AS n_base, median(value) AS med FROM arms WHERE ref GROUP BY ALL),
pb AS (SELECT stage, n_base, med, median(abs(value - med)) AS mad FROM (SELECT * FROM arms WHERE ref) JOIN pb0 USING (stage) GROUP BY ALL),
pi AS (SELECT run_id, stage, count(*) AS n_inc, median(value) AS inc_med FROM arms WHERE NOT ref GROUP BY ALL),
gr AS (SELECT run_id, unnest([{', '.join(repr(s) for s in STAGES)}]) AS stage FROM (SELECT DISTINCT run_id FROM arms WHERE NOT ref)),
pooled AS (SELECT run_id, stage, coalesce(n_inc, 0) AS n_inc, coalesce(n_base, 0) AS n_base, coalesce(inc_med, 0) - coalesce(med, 0) AS delta,
  {Z.format('coalesce(inc_med, 0)', 'coalesce(med, 0)', 'coalesce(mad, 0)')} AS z FROM gr LEFT JOIN pi USING (run_id, stage) LEFT JOIN pb USING (stage)),
nb0 AS (SELECT name, count(*) AS nb, median(value) AS med FROM arms WHERE ref AND stage = 'gpu' GROUP BY ALL),
nb AS (SELECT name, nb, med, median(abs(value - med)) AS mad FROM (SELECT * FROM arms WHERE ref AND stage = 'gpu') JOIN nb0 USING (name) GROUP BY ALL),
ni AS (SELECT run_id, 'gpu' AS stage, name, count(*) AS ni, median(value) AS inc_med FROM arms WHERE NOT ref AND stage = 'gpu' GROUP BY ALL),
nz AS (SELECT *, coalesce(nb >= 5 AND ni >= 5, false) AS ok, inc_med - med AS nd, {Z.format('inc_med', 'med', 'mad')} AS nz FROM ni LEFT JOIN nb USING (name)),
gpu AS (SELECT run_id, 'gpu' AS stage, max(CASE WHEN ok THEN {{'z': nz, 'd': nd}} END) AS best, count(*) FILTER (ok) AS mn,
  count(*) FILTER (nb IS NULL) AS io, sum(CASE WHEN nb IS NULL THEN ni ELSE 0 END)::BIGINT AS ir FROM nz GROUP BY run_id)
SELECT run_id, stage, round(CASE WHEN best IS NOT NULL THEN best.z ELSE z END, 6) AS z, round(CASE WHEN best IS NOT NULL THEN best.d ELSE delta END, 6) AS delta,
  n_inc, n_base, CASE WHEN best IS NOT NULL THEN mn END AS matched_names, CASE WHEN best IS NOT NULL THEN io END AS incident_only_names,
  CASE WHEN best IS NOT NULL THEN ir END AS incident_only_records FROM pooled LEFT JOIN gpu USING (run_id, stage)"""


def dist_z(spark, d):
    v = materialize(S.stage_values(traced(spark, d)), "stage-values")
    return C.distributional_z(v.where("run_id >= '2024-01-16'"), v.where("run_id < '2024-01-16'"))


@query("C2", "distributional_z", DZ)
def _(spark, d):
    return r6(dist_z(spark, d), "z", "delta")


@query("W12", "tail_fraction", f"""WITH {SV} SELECT run_id, count(*) AS n, round(avg(CASE WHEN value > 3e7 THEN 1.0 ELSE 0 END), 6) AS tail
FROM sv WHERE stage = 'cpu' GROUP BY run_id""")
def _(spark, d):
    g = S.host_gaps(traced(spark, d)).withColumn("value", F.col("gap_ms"))
    return r6(S.tail_fraction(g, ["run_id"], 3e7), "tail")


@query("W13", "backlog_slope", f"""WITH {SPANS}, h AS (SELECT run_id, cid, max_by(start_ns, event_id) AS hs FROM spans WHERE kind = 'cpu_launch' GROUP BY ALL),
g AS (SELECT run_id, cid, max_by(start_ns, event_id) AS gs FROM spans WHERE kind = 'gpu_kernel' GROUP BY ALL),
p AS (SELECT run_id, (gs - hs) / 1e6 AS delay, row_number() OVER (PARTITION BY run_id ORDER BY hs, cid) - 1 AS idx FROM h JOIN g USING (run_id, cid))
SELECT run_id, count(*) AS n, round(regr_slope(delay, idx), 3) AS slope, count(*) FILTER (delay < 0) AS violations FROM p GROUP BY run_id""")
def _(spark, d):
    return r6(S.backlog_slope(spans(spark, d)), "slope", digits=3)


SIG = f"""{GAPS}, hs AS (SELECT run_id, lead(start_ns) OVER (PARTITION BY run_id ORDER BY start_ns, event_id) - start_ns AS g FROM traced WHERE kind = 'cpu_launch'),
sig AS (SELECT t.run_id, avg(CASE WHEN kind = 'cpu_launch' THEN dur_ns END) AS cpu_dur, avg(CASE WHEN kind = 'gpu_kernel' THEN dur_ns END) AS kernel_dur,
  avg(CASE WHEN kind = 'sync_edge' THEN dur_ns END) AS blocked, avg(CASE WHEN kind = 'transfer' THEN k * 1024 END) AS bytes,
  count(*) FILTER (kind = 'gpu_kernel') AS kernels, max(CASE WHEN kind = 'sync_edge' AND k % 2 = 0 THEN 1 ELSE 0 END) AS serialized,
  (SELECT avg(g) FROM hs WHERE hs.run_id = t.run_id) AS host_gap, (SELECT avg(launch_gap_ns) FROM lg WHERE lg.run_id = t.run_id) AS launch_gap,
  count(DISTINCT CASE WHEN kind = 'gpu_kernel' THEN stream_id END) AS streams FROM traced t GROUP BY t.run_id)"""


@query("A13", "signature", f"""WITH {SIG} SELECT run_id, round(cpu_dur / 1e6, 3) AS cpu_dur, round(kernel_dur / 1e6, 3) AS kernel_dur, round(blocked / 1e6, 3) AS blocked,
 round(bytes, 3) AS bytes, kernels, serialized, round(host_gap / 1e6, 3) AS host_gap, round(launch_gap / 1e6, 3) AS launch_gap, streams FROM sig""")
def _(spark, d):
    s = S.signature(traced(spark, d))
    for c in ("cpu_dur", "kernel_dur", "blocked", "host_gap", "launch_gap"):
        s = s.withColumn(c, F.col(c) / 1e6)
    return r6(s, "cpu_dur", "kernel_dur", "blocked", "host_gap", "launch_gap", "bytes", digits=3)


@query("A14", "signature_diff", f"""WITH {SIG}, u AS (UNPIVOT (SELECT run_id, host_gap::DOUBLE AS host_gap, cpu_dur::DOUBLE AS cpu_dur, launch_gap::DOUBLE AS launch_gap,
 kernel_dur::DOUBLE AS kernel_dur, blocked::DOUBLE AS blocked, bytes::DOUBLE AS bytes, streams::DOUBLE AS streams, kernels::DOUBLE AS kernels,
 serialized::DOUBLE AS serialized FROM sig) ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE value)
SELECT a.run_id, b.run_id AS healthy_id, a.metric FROM u a JOIN u b ON a.metric = b.metric AND CAST(a.run_id AS DATE) = CAST(b.run_id AS DATE) + 15
WHERE a.value IS DISTINCT FROM b.value""")
def _(spark, d):
    s = spans(spark, d)
    pairs = s.where("arm = 'current'").select("run_id").distinct().withColumn(
        "healthy_id", F.date_sub(F.col("run_id").cast("date"), 15).cast("string"))
    return S.signature_diff(pairs, S.signature(traced(spark, d))).select("run_id", "healthy_id", "metric")


@query("D6", "novel_ops", f"""WITH {SPANS}, n AS (SELECT *, CASE WHEN k = 97 AND arm = 'current' THEN 'aten::t' WHEN k < 9 THEN 'aten::to' ELSE name END AS op FROM spans)
SELECT run_id, count(*) FILTER (op IN ('aten::transpose', 'aten::permute', 'aten::t')) AS n_ops,
 CASE WHEN count(*) FILTER (op IN ('aten::transpose', 'aten::permute', 'aten::t')) > 0 AND (SELECT count(*) FROM n WHERE arm = 'reference'
  AND op IN ('aten::transpose', 'aten::permute', 'aten::t')) = 0 THEN 'gpu' END AS stage FROM n WHERE arm = 'current' GROUP BY run_id""")
def _(spark, d):
    s = spans(spark, d).withColumn("name", F.when((F.col("k") == 97) & (F.col("arm") == "current"), "aten::t")
                                   .when(F.col("k") < 9, "aten::to").otherwise(F.col("name")))
    return C.novel_ops(s.where("arm = 'current'"), s.where("arm = 'reference'"), C.LAYOUT_OPS)


@query("F14", "perturb", f"""WITH {SV} SELECT run_id, stage, round(sum(CASE WHEN stage = 'queue' THEN greatest(1, round_even(value * 2.5, 0)) ELSE value END), 3) AS total
FROM sv GROUP BY ALL""")
def _(spark, d):
    v = S.perturb(S.stage_values(traced(spark, d)), "queue", 2.5)
    return v.groupBy("run_id", "stage").agg(F.round(F.sum("value"), 3).alias("total"))


@query("C19", "sensitivity", f"""WITH {SV}, m AS (SELECT stage, median(value) AS med FROM sv GROUP BY ALL),
mm AS (SELECT stage, med, median(abs(value - med)) AS mad FROM sv JOIN m USING (stage) GROUP BY ALL),
f AS (SELECT 1 + 7.0 * i / 64 AS f FROM range(1, 64) t(i)),
s AS (SELECT stage, f, median(CASE WHEN stage = 'queue' THEN greatest(1, round_even(value * f, 0)) ELSE value * f END) AS fm FROM sv, f GROUP BY ALL)
SELECT stage, min(CASE WHEN {Z.format('fm', 'med', 'mad')} > 2 THEN f END)::DOUBLE AS trip_factor FROM s JOIN mm USING (stage) GROUP BY stage""")
def _(spark, d):
    return C.sensitivity(S.stage_values(traced(spark, d)))


@query("P4", "check_comparable", """WITH c AS (SELECT conv_id, count(*) AS n_ops, string_agg(role || length(text) // 400, ',' ORDER BY turn) AS ctx FROM conversations GROUP BY conv_id),
h AS (SELECT DISTINCT ctx FROM c WHERE conv_id % 2 = 0)
SELECT conv_id, n_ops, ctx IN (SELECT ctx FROM h) AS strict_ok, n_ops IN (SELECT n_ops FROM c WHERE conv_id % 2 = 0) AS relaxed_ok FROM c WHERE conv_id % 2 = 1""")
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("op", F.concat("role", (F.length("text") / 400).cast("int").cast("string")))
    ctx = C.sequence_context(rows, "conv_id", "turn", "op")
    inc, base = ctx.where("conv_id % 2 = 1"), ctx.where("conv_id % 2 = 0")
    ok, no = C.check_comparable(inc, base, ["n_ops", "c1", "c2"])
    strict = ok.withColumn("strict_ok", F.lit(True)).unionByName(no.withColumn("strict_ok", F.lit(False)))
    ok, no = C.check_comparable(strict, base, ["n_ops"])
    both = ok.withColumn("relaxed_ok", F.lit(True)).unionByName(no.withColumn("relaxed_ok", F.lit(False)))
    return both.select("conv_id", "n_ops", "strict_ok", "relaxed_ok")


RAW_NAME = "case p_size % 4 when 0 then concat('void at::(anonymous namespace)::', replace(p_name, ' ', '_'), '_kernel<float>(int)') when 1 then p_name " \
           "when 2 then concat('ns::', p_type, '<int>(', p_brand, ')') else '' end"


@query("P6", "fill_derived", f"""WITH {SPANS} SELECT event_id, CASE WHEN kind <> 'gpu_kernel' THEN NULL WHEN k % 3 = 0 THEN 'given' ELSE name END AS kernel_name,
 CASE WHEN kind = 'sync_edge' THEN CASE WHEN k % 5 = 0 THEN k WHEN k % 5 = 1 THEN end_ns - start_ns ELSE dur_ns END END AS blocked_ns,
 CASE WHEN k % 4 = 0 THEN 'roofline-v1' ELSE 'kineto-' || CASE WHEN stream_id = 0 THEN 'unknown' ELSE 'card' || stream_id END || '-unknown' END AS timing_version FROM spans""")
def _(spark, d):
    s = spans(spark, d).withColumns({
        "kernel_name": F.when(F.col("k") % 3 == 0, "given"), "blocked_ns": F.when(F.col("k") % 5 == 0, F.col("k")),
        "dur_ns": F.when(F.col("k") % 5 != 1, F.col("dur_ns")),
        "timing_version": F.when(F.col("k") % 4 == 0, "roofline-v1").when(F.col("k") % 4 == 1, "unknown").when(F.col("k") % 4 == 2, ""),
        "hardware": F.when(F.col("stream_id") > 0, F.concat(F.lit("card"), F.col("stream_id").cast("string"))),
        "collector": F.lit(None).cast("string")})
    return S.fill_derived(s).select("event_id", "kernel_name", "blocked_ns", "timing_version")


@query("F1", "kernel_short_name", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '_') || '_kernel' WHEN 1 THEN
 regexp_extract(p_name, '(\\S+)$', 1) WHEN 2 THEN replace(regexp_extract(p_type, '(\\S+)$', 1), ' ', '_') ELSE 'UNKNOWN' END AS short FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", kernel_short_name(F.expr(RAW_NAME)).alias("short"))


