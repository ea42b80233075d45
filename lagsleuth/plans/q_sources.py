"""Ingest queries: files are first derived from the given tables, then read back by the source readers."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import spans as S
from ..operators.storage import materialize, shared_dir
from ..sources import events as E, traces as T
from .q_audit import run_rows
from .registry import query
from .views import PROGRESS, REQUESTS, SPANS, progress, requests, spans, table

C = F.col


def scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


DOC_EVENTS = 1000


def trace_docs(spark, d):
    """Trace documents of about a thousand events each, one per line, several shards per day."""
    s = spans(spark, d)
    cat = F.expr("case kind when 'cpu_launch' then if(k % 2 = 0, 'cuda_runtime', 'cpu_op') when 'gpu_kernel' then 'kernel' when 'transfer' then 'gpu_memcpy' else if(k % 3 = 0, 'cuda_sync', 'cuda_driver') end")
    name = F.expr("case when kind = 'sync_edge' and k % 3 > 0 then 'cudaStreamSynchronize' when kind = 'gpu_kernel' then concat('void at::native::', name, '_kernel<float>(int)') else name end")
    ev = F.struct(F.lit("X").alias("ph"), F.when(C("k") == 5, F.lit(None)).otherwise(F.concat(F.expr("start_ns div 1000").cast("string"), F.when(C("k") % 2 == 0, ".0").otherwise(""))).alias("ts"),
                  F.when(C("k") != 6, F.expr("dur_ns div 1000")).alias("dur"), (C("user_id") % 3).alias("pid"), C("stream_id").alias("tid"), name.alias("name"), F.when(C("k") == 7, "flow").otherwise(cat).alias("cat"),
                  F.when(C("k") % 4 == 0, C("cid")).alias("id"), F.struct(F.when(C("k") % 4 != 0, C("cid")).alias("External id"), (C("k") * 1024).cast("string").alias("bytes")).alias("args"))
    pieces = F.ceil(s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar() / DOC_EVENTS)
    shard = F.pmod(F.xxhash64("event_id"), pieces)
    docs = s.groupBy("run_id", shard.alias("shard")).agg(F.collect_list(ev).alias("traceEvents"))
    path = scratch(spark, "trace-docs")
    docs.select(F.concat_ws("~", "run_id", "shard").alias("shard_id"), F.to_json(F.struct(F.lit("unknown").alias("timing_model_version"), "traceEvents")).alias("value")).write.partitionBy("shard_id").text(path)
    return path


def shard_id():
    return F.regexp_extract(F.input_file_name(), "shard_id=([^/]+)/", 1)


RAW = f"""{SPANS}, raw AS (SELECT run_id, event_id, CASE WHEN k = 7 OR k = 5 THEN NULL ELSE kind END AS kind, cid, CASE kind WHEN 'gpu_kernel' THEN name || '_kernel' END AS kernel_name, CASE WHEN kind = 'sync_edge' AND k % 3 > 0 THEN 'cudaStreamSynchronize' WHEN kind = 'gpu_kernel' THEN 'void at::native::' || name || '_kernel<float>(int)' ELSE name END AS name,
 start_ns // 1000 * 1000 AS start_ns, CASE WHEN k = 6 THEN 0 ELSE dur_ns END AS dur_ns, k * 1024 AS bytes, k FROM spans)"""


@query("S1", "read_trace_json", f"WITH {RAW} SELECT run_id, kind, cid, name, kernel_name, start_ns, start_ns + dur_ns AS end_ns, dur_ns, bytes FROM raw WHERE kind IS NOT NULL")
def _(spark, d):
    s, _bad = T.read_trace_json(spark, trace_docs(spark, d), shard_id(), multiline=False)
    return T.merge_shards(s, F.substring_index("run_id", "~", 1)).select("run_id", "kind", "cid", "name", "kernel_name", "start_ns", "end_ns", "dur_ns", "bytes")


@query("F2", "trace_rejects", f"WITH {RAW} SELECT run_id, name, 'missing required field' AS reason FROM raw WHERE k = 5")
def _(spark, d):
    _s, bad = T.read_trace_json(spark, trace_docs(spark, d), shard_id(), multiline=False)
    return bad.select(F.substring_index("run_id", "~", 1).alias("run_id"), "name", "reason")


@query("S2", "merge_shards", f"""WITH {RAW}, g AS (SELECT run_id, start_ns, start_ns + dur_ns AS end_ns, event_id FROM raw WHERE kind = 'gpu_kernel'),
c AS (SELECT g.run_id, g.event_id, count(h.event_id) AS live FROM g LEFT JOIN g h ON h.run_id = g.run_id AND h.start_ns <= g.start_ns AND g.start_ns < h.end_ns GROUP BY ALL) SELECT run_id, count(*) AS kernels, sum(live)::BIGINT AS overlap, max(live) AS peak FROM c GROUP BY run_id""")
def _(spark, d):
    s, _bad = T.read_trace_json(spark, trace_docs(spark, d), shard_id(), multiline=False)
    m = materialize(T.merge_shards(s, F.substring_index("run_id", "~", 1)).withColumn("event_id", F.xxhash64("cid", "start_ns", "name")), "merged")
    return S.concurrency(m).groupBy("run_id").agg(F.count(F.lit(1)).alias("kernels"), F.sum("active_kernels").alias("overlap"), F.max("active_kernels").alias("peak"))


@query("S3", "normalize_cupti", f"""WITH {SPANS} SELECT run_id, kind, cid, CASE kind WHEN 'gpu_kernel' THEN coalesce(CASE WHEN k % 3 = 0 THEN n_name END, CASE WHEN k % 3 < 2 THEN 'REG' || k % 5 END, '') WHEN 'transfer' THEN CASE WHEN k % 14 > 10 THEN 'kind_' || k % 14 ELSE ['unknown', 'HtoD', 'DtoH', 'HtoA', 'AtoH', 'AtoA', 'AtoD', 'DtoA', 'DtoD', 'HtoH', 'PtoP'][1 + k % 14] END
 WHEN 'cpu_launch' THEN coalesce(n_name, '') ELSE 'synchronize' END AS name, start_ns, end_ns, dur_ns FROM spans LEFT JOIN nation ON n_nationkey = k % 30 WHERE k <> 11""")
def _(spark, d):
    s = spans(spark, d).withColumns({"correlation_id": F.when(C("k") != 11, C("user_id")), "start": C("start_ns"), "end": C("end_ns"), "copy_kind": (C("k") % 14).cast("int"), "bytes": C("k"),
                                     "name_id": F.when((C("kind") == "cpu_launch") | (C("k") % 3 == 0), C("k") % 30), "short_name_id": F.when(C("k") % 3 == 1, 100 + C("k") % 5), "demangled_id": F.when(C("k") % 3 < 2, 100 + C("k") % 5)})
    names = table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) id", "n_name value").union(table(spark, d, "region").selectExpr("cast(100 + r_regionkey as bigint)", "concat('REG', r_regionkey)"))
    k = lambda x: s.where(C("kind") == x).drop("name")
    return T.normalize_cupti(k("gpu_kernel"), k("transfer"), k("cpu_launch"), k("sync_edge"), names).select("run_id", "kind", "cid", "name", "start_ns", "end_ns", "dur_ns")


def event_files(spark, d):
    p = progress(spark, d)
    payload = F.struct(C("source").alias("source_instance"), "sequence", "clock", "time", "uncertainty", "boundary", F.create_map(F.lit("token"), C("token").cast("string")).alias("values"), F.create_map(F.lit("time"), F.lit("us")).alias("units"),
                       F.array(F.struct(F.lit("delivery").alias("relation"), "identity", F.lit("explicit").alias("certainty"))).alias("links"), F.array().cast("array<string>").alias("limitations"), F.struct("complete", F.lit(0).alias("drops")).alias("coverage"))
    line = F.when(C("k") == 12, "{broken").otherwise(F.to_json(F.struct(F.when(C("k") == 13, "network-v1").otherwise(E.VERSION).alias("version"), F.when(C("k") != 14, "event").alias("kind"), payload.alias("payload"))))
    path = scratch(spark, "events")
    p.select(line.alias("value")).write.text(path)
    return path


@query("S4", "read_events", f"WITH {PROGRESS} SELECT source AS source_instance, sequence, clock, time::DOUBLE AS time, boundary, CAST(token AS VARCHAR) AS token, identity, complete FROM progress WHERE k NOT IN (12, 13, 14)")
def _(spark, d):
    ok, _bad = E.read_events(spark, event_files(spark, d))
    return ok.select("source_instance", "sequence", "clock", "time", "boundary", C("values")["token"].alias("token"), C("links")[0]["identity"].alias("identity"), "coverage.complete")


@query("S4", "event_rejects", f"WITH {PROGRESS} SELECT CASE k WHEN 12 THEN 'unreadable' WHEN 13 THEN 'version' ELSE 'kind' END AS reason, count(*) AS n FROM progress WHERE k IN (12, 13, 14) GROUP BY ALL")
def _(spark, d):
    _ok, bad = E.read_events(spark, event_files(spark, d))
    return materialize(bad, "rejects").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("S5", "legacy_to_events", f"""WITH {REQUESTS}, q AS (SELECT request_id, finish_ns, CASE WHEN l_returnflag <> 'N' OR lineno > 3 THEN start_ns END AS sent_ns, clock_domain, row_number() OVER (ORDER BY start_ns, request_id, total_ns, price) - 1 AS sequence FROM requests)
SELECT sequence, clock_domain AS clock, coalesce(finish_ns, sent_ns) AS time, CASE WHEN finish_ns IS NOT NULL THEN 'consume' ELSE 'write_complete' END AS boundary, request_id AS identity FROM q WHERE coalesce(finish_ns, sent_ns) IS NOT NULL""")
def _(spark, d):
    r = requests(spark, d).withColumn("sent_ns", F.when((C("l_returnflag") != "N") | (C("lineno") > 3), C("start_ns")))
    return E.legacy_to_events(r, "log", ["start_ns", "request_id", "total_ns", "price"]).drop("source_instance")


@query("S6", "parse_packet_tsv", """SELECT l_orderkey * 10 + l_linenumber AS sequence, l_quantity AS time, 'src:tcp:' || l_suppkey AS connection, l_returnflag = 'R' AS retransmission, CAST(l_partkey AS VARCHAR) AS seq_raw, CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS VARCHAR) END AS len FROM lineitem""")
def _(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber a", "l_quantity b", "100 c", "'10.0.0.1' d", "'10.0.0.2' e", "l_suppkey f", "l_partkey g", "'' h", "if(l_linestatus = 'F', l_linenumber, null) i", "'0x10' j", "if(l_returnflag = 'R', '1', '') k")
    path = scratch(spark, "packets")
    l.toDF(*E.PACKET_FIELDS).write.option("sep", "\t").option("header", True).csv(path)
    ok, _bad = E.parse_packet_tsv(E.read_packet_tsv(spark, path), "src")
    return ok.select("sequence", "time", "connection", "retransmission", C("values")["seq_raw"].alias("seq_raw"), C("values")["len"].alias("len"))


@query("S7", "parse_sched_text", f"""WITH {PROGRESS} SELECT rid AS sequence, CASE WHEN k = 3 THEN 0 ELSE rid + .25 END::DOUBLE AS time, CASE WHEN k = 3 THEN 'socket_state' WHEN k % 2 = 0 THEN 'runnable' ELSE 'running' END AS boundary, CASE WHEN k <> 3 THEN source || ':' || identity ELSE source END AS thread, k <> 3 AS complete FROM progress WHERE k <> 4""")
def _(spark, d):
    p = progress(spark, d)
    wake = F.format_string("worker one %d/%d [002] %d.25: sched:sched_wakeup: comm=x pid=%s prio=120 target_cpu=002", "k", "k", "rid", "identity")
    sw = F.format_string("  worker %d/%d [001] %d.25: sched:sched_switch: prev_comm=w prev_pid=1 ==> next_comm=r next_pid=%s next_prio=1", "k", "k", "rid", "identity")
    line = F.when(C("k") == 3, "LOST 5 events!").when(C("k") == 4, "garbage").when(C("k") % 2 == 0, wake).otherwise(sw)
    ok, _bad = E.parse_sched_text(p.select("source", C("rid").alias("seq"), line.alias("line")))
    return ok.select("sequence", "time", "boundary", "thread", "complete")


@query("S8", "parse_station_counters", f"""WITH {PROGRESS}, l AS (SELECT source, CASE WHEN k % 3 = 0 THEN 'rx bytes' WHEN k % 3 = 1 THEN 'signal' ELSE 'inactive time' END AS name, k - 50 AS v, rid FROM progress) SELECT source, name, arg_max(v, rid) AS value, CASE name WHEN 'signal' THEN 'dBm' ELSE 'counter' END AS unit FROM l WHERE name <> 'inactive time' GROUP BY ALL""")
def _(spark, d):
    p = progress(spark, d)
    line = F.when(C("k") % 3 == 0, F.format_string("        rx bytes: %d", C("k") - 50)).when(C("k") % 3 == 1, F.format_string("  signal: %d dBm", C("k") - 50)).otherwise("inactive time: 12 ms")
    c = E.parse_station_counters(p.select("source", C("rid").alias("seq"), line.alias("line")))
    return c.select("source", F.explode("counters").alias("name", "v")).select("source", "name", "v.value", "v.unit")


@query("S9", "parse_qlog", f"""WITH {PROGRESS}, e AS (SELECT identity AS source_instance, rid, k, CASE k % 4 WHEN 0 THEN 'egress' WHEN 1 THEN 'ingress' WHEN 2 THEN 'recovery' END AS boundary FROM progress) SELECT source_instance, rid::DOUBLE AS time, boundary, CASE WHEN k % 4 = 0 THEN k ELSE NULL END AS lo, CASE WHEN k % 4 = 0 THEN k + 100 END AS hi,
 row_number() OVER (PARTITION BY source_instance ORDER BY rid) - 1 AS sequence FROM e WHERE boundary IS NOT NULL""")
def _(spark, d):
    p = progress(spark, d)
    name = F.expr("case k % 4 when 0 then 'transport:packet_sent' when 1 then 'transport:packet_received' when 2 then 'recovery:packet_lost' else 'http:frame' end")
    fr = F.when(C("k") % 4 == 0, F.array(F.struct(F.lit("stream").alias("frame_type"), F.lit(0).alias("stream_id"), C("k").alias("offset"), F.lit(100).alias("length")), F.struct(F.lit("ack").alias("frame_type"), F.lit(0).alias("stream_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).alias("length"))))
    ev = F.struct(C("rid").cast("double").alias("time"), name.alias("name"), F.struct(fr.alias("frames")).alias("data"))
    # One document per source; documents are small here because a source has few events.
    docs = p.groupBy(C("identity").alias("source")).agg(F.sort_array(F.collect_list(F.struct("rid", ev.alias("e")))).alias("x"))
    j = docs.select("source", F.to_json(F.struct(F.lit("0.3").alias("qlog_version"), F.array(F.struct(F.transform("x", lambda y: y["e"]).alias("events"))).alias("traces"))).alias("j"))
    e, _bad = E.parse_qlog(materialize(j.select("source", F.from_json("j", E.QLOG_SCHEMA).alias("d")).select("source", "d.*"), "qlog"))
    r = F.get("stream_ranges", 0)
    return e.select("source_instance", "time", "boundary", r["lo"].alias("lo"), r["hi"].alias("hi"), "sequence")


@query("S10", "parse_socket_text", f"""WITH {PROGRESS} SELECT source AS source_instance, rid * 2 + 1 AS sequence, 'ESTAB' AS state, k AS recv_queue, '10.0.0.' || k AS local, k * .5 AS cwnd, CASE WHEN k % 2 = 0 THEN rid END::DOUBLE AS bytes_sent FROM progress WHERE k % 7 > 0""".replace("k * .5 AS cwnd", "(k * .5)::DOUBLE AS cwnd"))
def _(spark, d):
    p = progress(spark, d)
    a = p.select("source", (C("rid") * 2).alias("seq"), F.when(C("k") % 7 > 0, F.format_string("ESTAB %d 0 10.0.0.%d 10.0.0.2:80", "k", "k")).otherwise("State Recv-Q Send-Q").alias("line"))
    b = p.select("source", (C("rid") * 2 + 1).alias("seq"), F.concat(F.format_string("\t cubic cwnd:%s rtt:1.5/2", (C("k") * 0.5).cast("string")), F.when(C("k") % 2 == 0, F.format_string(" bytes_sent:%d", "rid")).otherwise("")).alias("line"))
    return E.parse_socket_text(a.union(b)).select("source_instance", "sequence", "state", "recv_queue", "local", "cwnd", "bytes_sent")


@query("S11", "parse_probe_text", f"""WITH {PROGRESS} SELECT rid AS sequence, rid * 10 AS time, CASE k % 5 WHEN 0 THEN 'socket_state' WHEN 1 THEN 'retransmit' WHEN 2 THEN 'readable' ELSE 'queue_enqueue' END AS boundary, CASE k % 5 WHEN 2 THEN source || ':7:' || identity WHEN 3 THEN source || ':7' ELSE identity END AS identity FROM progress WHERE k % 5 < 4""")
def _(spark, d):
    p = progress(spark, d)
    f = F.expr("case k % 5 when 0 then format_string('state %d 7 %s 2 1', rid * 10, identity) when 1 then format_string('retransmit %d 7 %s', rid * 10, identity) when 2 then format_string('receive %d 7 %s 5 6', rid * 10, identity) "
               "when 3 then format_string('queue-in %d 7 %s', rid * 10, identity) else format_string('state %d 7', rid) end")
    e, _bad = E.parse_probe_text(p.select("source", C("rid").alias("seq"), f.alias("line")))
    return e.select("sequence", "time", "boundary", "identity")


@query("P8", "coverage_from_logs", """WITH o AS (SELECT o_orderkey AS id, o_custkey % 4 AS p, o_orderstatus, o_custkey % 3 AS a, o_custkey % 5 AS b FROM orders) SELECT id, CASE WHEN o_orderstatus = 'P' THEN false WHEN p = 0 THEN true WHEN p = 1 THEN a + b = 0 WHEN p = 2 THEN a = 2 ELSE false END AS complete,
 CASE WHEN o_orderstatus = 'P' THEN NULL WHEN p = 0 THEN 0 WHEN p = 1 THEN a + b WHEN p = 2 AND a < 2 THEN 2 - a WHEN p = 2 THEN 0 END AS drops FROM o""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey id", "o_custkey % 4 p", "o_orderstatus", "o_custkey % 3 a", "o_custkey % 5 b")
    c = o.select("id", F.expr("element_at(array('socket', 'packets', 'probe', 'scheduler'), cast(p + 1 as int))").alias("profile"), F.when(C("o_orderstatus") == "P", "timeout").otherwise("complete").alias("status"),
                 F.concat(F.lit("root-probe-v1\n"), F.expr("repeat('state 1 2 3 4 5\n', cast(a as int))"), F.lit("@events: 2\n")).alias("stdout"), F.when(C("p") == 1, F.format_string("x pcap: %d, ifdrop: %d", "a", "b")).otherwise("").alias("stderr"))
    return E.coverage_from_logs(c)


@query("P13", "expand_catalog", """WITH s AS (SELECT 'ep' || s_suppkey AS id, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['probe', 'magic'] ELSE ['socket', 'packets'] END) AS profile, s_acctbal AS seconds FROM supplier)
SELECT id || '-' || profile AS action, profile, id AS scope, id || ':' || profile AS capability_key, id || '|' || profile || '|f|e1|' AS resource_key, seconds, CASE profile WHEN 'socket' THEN 1 ELSE 2 END AS n_distinctions FROM s WHERE profile <> 'magic'""")
def _(spark, d):
    cfg = "named_struct('filter', 'f', 'interface', cast(null as string), 'seconds', s_acctbal, 'bytes', 1.0d, 'perturbation', 0.0d)"
    e = table(spark, d, "supplier").selectExpr("concat('ep', s_suppkey) id", f"if(s_suppkey % 3 = 0, map('probe', {cfg}, 'magic', {cfg}), map('socket', {cfg}, 'packets', {cfg})) sources")
    return E.expand_catalog(e, "e1").select("action", "profile", "scope", "capability_key", "resource_key", "seconds", F.size("distinctions").alias("n_distinctions"))


@query("S13", "ingest_runs", """WITH r AS (SELECT 'w' || o_custkey AS run_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS hardware, 'v' || month(o_orderdate) % 2 AS cv, o_orderkey AS seq, o_orderstatus FROM orders),
old AS (SELECT DISTINCT run_id, hardware, cv FROM r WHERE o_orderstatus = 'F') SELECT run_id, hardware, cv AS collector_version, min(seq) AS seq FROM r ANTI JOIN old USING (run_id, hardware, cv) WHERE o_orderstatus <> 'F' AND hardware IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    r = table(spark, d, "orders").selectExpr("concat('w', o_custkey) run_id", "if(o_orderpriority = '5-LOW', null, o_orderpriority) hardware", "concat('v', month(o_orderdate) % 2) collector_version", "o_orderkey seq", "'d' device", "'dr' driver", "'c' cuda", "o_orderstatus")
    ok, _bad = T.ingest_runs(r.where("o_orderstatus <> 'F'"), r.where("o_orderstatus = 'F'"))
    return ok.select("run_id", "hardware", "collector_version", "seq")


def run_folder(spark, d):
    path = scratch(spark, "runs")
    run_rows(spark, d).selectExpr("coalesce(hardware, 'none') run", "to_json(struct(run_id, workload, seed, fault)) value").repartition("run").write.partitionBy("run").text(path)
    return path


@query("S14", "verify_checksums")
def _(spark, d):
    f = materialize(T.file_digests(spark, run_folder(spark, d)), "digests")
    inv = f.select("path", F.when(C("path").contains("HIGH"), "0").otherwise(C("sha256")).alias("expected"))
    return T.verify_checksums(f, inv).select(F.regexp_extract("path", "run=([^/]+)", 1).alias("run"), "status")


@query("S12", "scan_runs")
def _(spark, d):
    f = materialize(T.file_digests(spark, run_folder(spark, d)), "digests").where("length > 0")
    dirs = f.withColumn("dir", F.regexp_replace("path", "/[^/]+$", "")).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    man = dirs.groupBy("dir").agg(F.map_from_entries(F.collect_list(F.struct("name", F.when(C("path").contains("URGENT"), "0").otherwise(C("sha256")).alias("digest")))).alias("sha256")).withColumn("run_id", F.regexp_extract("dir", "run=([^/]+)", 1))
    flags = dirs.where("dir not like '%LOW%'").select(F.concat_ws("/", "dir", F.lit("DONE")).alias("path")).distinct()
    return T.scan_runs(f.select("path", "sha256"), man, flags).select("run_id", "verified")


@query("S16", "write_table", "SELECT o_orderpriority, 2 * count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    path = scratch(spark, "dataset")
    for _i in range(2):
        T.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, "json")
    return spark.read.schema("o_orderkey bigint, o_orderpriority string").json(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

