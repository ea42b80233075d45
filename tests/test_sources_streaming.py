"""Parsers on hand-written text, and the stateful stream steps against plain Python."""
import random

from pyspark.sql import functions as F

from lagsleuth.sources import events as E, traces as T
from lagsleuth.streaming import ops as R


def lines(spark, *text):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "source string, seq long, line string")


def test_trace_document(spark, tmp_path):
    (tmp_path / "r1.json").write_text("""{"timing_model_version": "v", "traceEvents": [
      {"ph": "X", "ts": "1000.500", "dur": "3.250", "pid": 1, "tid": 2, "name": "aten::mm", "cat": "cpu_op", "args": {"External id": 7}},
      {"ph": "X", "ts": 1010, "pid": 0, "tid": 7, "name": "void foo_kernel<int>(x)", "cat": "kernel", "id": 9},
      {"ph": "X", "ts": 1020, "dur": 4, "pid": 0, "tid": 7, "name": "cudaDeviceSynchronize", "cat": "cuda_runtime"},
      {"ph": "X", "ts": 1020, "dur": 4, "pid": 0, "tid": 7, "name": "x", "cat": "cuda_api"}, {"ph": "X", "ts": "bad", "pid": 0, "tid": 7, "name": "y", "cat": "kernel"}]}""")
    s, bad = T.read_trace_json(spark, str(tmp_path / "*.json"))
    got = {r.name: r for r in s.collect()}
    assert (got["aten::mm"].start_ns, got["aten::mm"].dur_ns, got["aten::mm"].cid) == (1000500, 3250, "7")
    k = got["void foo_kernel<int>(x)"]
    assert (k.kind, k.dur_ns, k.cid, k.kernel_name, k.stream_id) == ("gpu_kernel", 0, "9", "foo_kernel", "7")
    y = got["cudaDeviceSynchronize"]
    assert (y.kind, y.blocked_ns, y.cid) == ("sync_edge", 4000, "") and len(got) == 3
    assert [r.reason for r in bad.collect()] == ["bad time"]


def test_scheduler_lines(spark):
    ok, bad = E.parse_sched_text(lines(spark, "# header", "w 901/903 [002] 123.5: sched:sched_wakeup: comm=r pid=903 prio=120", "w 9/9 [000] 124.5: sched:sched_switch: prev_pid=9 ==> next_comm=r next_pid=903", "LOST 3", "junk"))
    got = {r.sequence: r for r in ok.collect()}
    assert (got[1].boundary, got[1].thread, got[1].time, got[1].cpu) == ("runnable", "s:903", 123.5, 2)
    assert (got[2].boundary, got[2].thread) == ("running", "s:903") and got[3].complete is False
    assert [r.seq for r in bad.collect()] == [4]


def test_station_socket_probe(spark):
    c = E.parse_station_counters(lines(spark, "Station aa (on wlan0)", "  rx bytes: 12000", " signal: -51 dBm", " inactive time: 12 ms")).first().counters
    assert {k: tuple(v) for k, v in c.items()} == {"rx bytes": (12000, "counter"), "signal": (-51, "dBm")}
    s = E.parse_socket_text(lines(spark, "State  Recv-Q", "ESTAB 1 2 a:1 b:2", "\t cubic cwnd:10 rtt:1.5/2 bytes_sent:7", "ESTAB 0 0 c:1 d:2", "ESTAB 5 5 e:1 f:2", "  cwnd:3")).collect()
    assert [(r.recv_queue, r.local, r.cwnd, r.rtt, r.bytes_sent) for r in sorted(s, key=lambda r: r.sequence)] == [(1, "a:1", 10.0, 1.5, 7.0), (5, "e:1", 3.0, None, None)]
    ok, bad = E.parse_probe_text(lines(spark, "root-probe-v1 pid=1", "state 12 901 0xf 2 1", "retransmit 13 901 0xf", "queue-in 14 q t", "receive 15 1"))
    assert sorted((r.time, r.boundary, r.identity) for r in ok.collect()) == [(12, "socket_state", "0xf"), (13, "retransmit", "0xf"), (14, "queue_enqueue", "s:q")]
    assert [r.seq for r in bad.collect()] == [4]


def test_run_scan_detects_tampering(spark, tmp_path):
    import hashlib
    for run in ("a", "b", "c"):
        d = tmp_path / run
        d.mkdir()
        (d / "trace.json").write_text(run)
        if run != "c":
            (d / "DONE").write_text("")
    man = [(r, f"file:{tmp_path}/{r}", {"trace.json": hashlib.sha256(("x" if r == "b" else r).encode()).hexdigest()}) for r in "abc"]
    got = T.scan_runs(T.file_digests(spark, str(tmp_path)), spark.createDataFrame(man, "run_id string, dir string, sha256 map<string,string>"), T.done_flags(spark, str(tmp_path)))
    assert {r.run_id: r.verified for r in got.collect()} == {"a": True, "b": False, "c": False}


def test_ingest_is_idempotent(spark):
    cols = "run_id string, device string, hardware string, driver string, cuda string, collector_version string, seq long"
    new = spark.createDataFrame([("f:1", "d", "T4", "1", "1", "v", 1), ("f:1", "d", "T4", "1", "1", "v", 2), ("f:2", "d", None, "1", "1", "v", 3)], cols)
    add, bad = T.ingest_runs(new, new.limit(0))
    assert [(r.run_id, r.seq) for r in add.collect()] == [("f:1", 1)] and bad.count() == 1
    again, _ = T.ingest_runs(new, add)
    assert again.count() == 0


def test_stream_lifecycle_equals_state_machine(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(4), i, i * 1_000_000, r.choice(["INFERRED", "TESTED", "VERIFIED"]), r.random() < 0.7, r.random() < 0.7) for i in range(80)] + [(9, 999, 10**11, "TESTED", True, True)]
    schema = "id long, rid long, time long, to_status string, linked boolean, measured boolean"
    half = len(rows) // 2
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p={n}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withColumn("at", F.timestamp_micros("time"))
    got = {x.rid: (x.from_status, x.accepted) for x in R.run_available(R.stream_lifecycle(s, "at", "1 second"), "life").collect()}
    state, want = {}, {}
    for i, rid, _, to, linked, measured in rows[:-1]:
        now = state.get(i, "INFERRED")
        ok = {("INFERRED", "TESTED"): linked, ("TESTED", "VERIFIED"): linked and measured, ("TESTED", "INFERRED"): True}.get((now, to), False)
        want[rid] = (now, ok)
        state[i] = to if ok else now
    assert {k: got[k] for k in want if k in got} == {k: want[k] for k in want if k in got} and len(got) >= 79
