"""Graph, closure and path queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, intervals as I, spans as S
from ..operators.ordered import scan
from ..operators.storage import materialize
from .q_compare import GAPS, traced
from .registry import query
from .views import SPANS, spans, table

C = F.col


def r6(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


REC = f"""{SPANS}, rc AS (SELECT run_id, cid, kind, arg_max({{'s': start_ns, 'e': end_ns, 'd': dur_ns, 'st': stream_id, 'k': k, 'id': event_id}}, event_id) AS r FROM spans GROUP BY ALL),
cpu AS (SELECT run_id, cid, r FROM rc WHERE kind = 'cpu_launch'), gpu AS (SELECT run_id, cid, r FROM rc WHERE kind = 'gpu_kernel'), tx AS (SELECT run_id, cid, r FROM rc WHERE kind = 'transfer'), sy AS (SELECT run_id, cid, r FROM rc WHERE kind = 'sync_edge'),
nodes AS (SELECT run_id, 'cpu:' || cid AS node, 'host' AS stage, r.e - r.s AS dur_ns, false AS serialized FROM cpu UNION ALL SELECT run_id, 'gpu:' || cid, 'kernel', r.d, false FROM gpu
 UNION ALL SELECT run_id, 'tx:' || cid, 'transfer', r.d, false FROM tx UNION ALL SELECT run_id, 'sync:' || cid, 'sync', r.e - r.s, r.k % 2 = 0 FROM sy
 UNION ALL SELECT DISTINCT run_id, 'unknown:' || cid, 'other', 0, false FROM rc WHERE NOT EXISTS (FROM cpu WHERE cpu.run_id = rc.run_id AND cpu.cid = rc.cid) OR NOT EXISTS (FROM gpu WHERE gpu.run_id = rc.run_id AND gpu.cid = rc.cid)
 UNION ALL SELECT run_id, 'batch:shared', 'other', 0, false FROM gpu GROUP BY run_id HAVING count(DISTINCT r.st) > 1),
ho AS (SELECT cpu.run_id, cpu.cid, cpu.r, coalesce(sy.r.k % 2 = 0, false) AS ser, row_number() OVER o AS pos, lead(cpu.cid) OVER o AS nc, lead(cpu.r.s) OVER o AS ns FROM cpu LEFT JOIN sy ON sy.run_id = cpu.run_id AND sy.cid = cpu.cid WINDOW o AS (PARTITION BY cpu.run_id ORDER BY cpu.r.s, cpu.r.id)),
so AS (SELECT gpu.run_id, gpu.cid, pos, lead(gpu.cid) OVER o AS nc, lead(pos) OVER o AS np FROM gpu LEFT JOIN ho ON ho.run_id = gpu.run_id AND ho.cid = gpu.cid WINDOW o AS (PARTITION BY gpu.run_id, gpu.r.st ORDER BY gpu.r.s, gpu.cid)),
edges AS (SELECT c.run_id, 'cpu:' || c.cid AS src, 'gpu:' || c.cid AS dst, 'enqueue' AS kind, 1.0::DOUBLE AS confidence, true AS observed, greatest(0, g.r.s - c.r.e) AS w_ns, 'host' AS stage FROM cpu c JOIN gpu g USING (run_id, cid)
 UNION ALL SELECT run_id, 'cpu:' || cid, 'unknown:' || cid, 'unknown', 0, false, 0, 'other' FROM cpu ANTI JOIN gpu USING (run_id, cid)
 UNION ALL SELECT run_id, 'gpu:' || cid, 'unknown:' || cid, 'unknown', 0, false, 0, 'other' FROM gpu ANTI JOIN cpu USING (run_id, cid)
 UNION ALL SELECT run_id, 'tx:' || cid, 'gpu:' || cid, 'transfer', .8, true, 0, 'transfer' FROM tx SEMI JOIN gpu USING (run_id, cid)
 UNION ALL SELECT run_id, 'gpu:' || cid, 'sync:' || cid, 'sync', 1, true, 0, 'sync' FROM gpu SEMI JOIN sy USING (run_id, cid)
 UNION ALL SELECT run_id, 'cpu:' || cid, 'cpu:' || nc, 'host_order', 1, true, greatest(0, ns - r.e), CASE WHEN ser THEN 'sync' ELSE 'host' END FROM ho WHERE nc IS NOT NULL
 UNION ALL SELECT run_id, 'sync:' || cid, 'cpu:' || nc, 'sync_host', 1, true, 0, 'sync' FROM ho WHERE nc IS NOT NULL AND ser
 UNION ALL SELECT run_id, 'gpu:' || cid, 'gpu:' || nc, CASE WHEN coalesce(np - pos = 1, false) THEN 'stream_order' ELSE 'unknown' END, CASE WHEN coalesce(np - pos = 1, false) THEN .9 ELSE 0 END, coalesce(np - pos = 1, false), 0,
  CASE WHEN coalesce(np - pos = 1, false) THEN 'kernel' ELSE 'other' END FROM so WHERE nc IS NOT NULL
 UNION ALL SELECT run_id, 'gpu:' || cid, 'batch:shared', 'batch_share', .5, false, 0, 'other' FROM gpu WHERE run_id IN (SELECT run_id FROM nodes WHERE node = 'batch:shared'))"""


@query("J5", "graph_edges", f"WITH {REC} SELECT * FROM edges")
def _(spark, d):
    return G.graph_tables(spans(spark, d))[1]


@query("J5", "graph_nodes", f"WITH {REC} SELECT * FROM nodes")
def _(spark, d):
    return G.graph_tables(spans(spark, d))[0]


def chains(spark, d):
    """One graph per user and day: consecutive events, and the event after next, are linked by their gap."""
    s = spans(spark, d).select(F.concat_ws("/", "user_id", "run_id").alias("run_id"), C("event_id").cast("string").alias("node"), "stage", C("dur_ns"), "start_ns", "event_id")
    n = materialize(s, "chain-nodes")
    x = materialize(scan(n, ["run_id"], ["start_ns", "event_id"], pos=("sum", F.lit(1))), "chain-pos")
    to = x.select("run_id", C("node").alias("dst"), C("start_ns").alias("to_start"), C("pos").alias("to_pos"))
    j = x.select("run_id", C("node").alias("src"), "stage", "start_ns", F.explode(F.array(C("pos") + 1, C("pos") + 2)).alias("to_pos"), "pos").join(to, ["run_id", "to_pos"])
    w = F.when(C("to_pos") - C("pos") == 1, C("to_start") - C("start_ns")).otherwise(F.floor((C("to_start") - C("start_ns")) / 3)).cast("long")
    return n.select("run_id", "node", "stage", "dur_ns"), j.select("run_id", "src", "dst", w.alias("w_ns"), F.when(C("to_pos") - C("pos") == 1, C("stage")).otherwise("skip").alias("stage"))


CH = f"""{SPANS}, x AS (SELECT user_id || '/' || run_id AS run_id, event_id, CAST(event_id AS VARCHAR) AS node, stage, dur_ns, start_ns, row_number() OVER (PARTITION BY user_id, run_id ORDER BY start_ns, event_id) AS pos FROM spans),
ce AS (SELECT a.run_id, a.node AS src, b.node AS dst, a.pos AS sp, b.pos AS dp, b.dur_ns AS dd, CASE WHEN b.pos - a.pos = 1 THEN b.start_ns - a.start_ns ELSE (b.start_ns - a.start_ns) // 3 END AS w_ns, CASE WHEN b.pos - a.pos = 1 THEN a.stage ELSE 'skip' END AS stage
 FROM x a JOIN x b ON a.run_id = b.run_id AND b.pos - a.pos IN (1, 2)),
walk AS (SELECT run_id, node, node AS first, dur_ns AS dist, [node] AS path FROM x UNION ALL SELECT w.run_id, e.dst, w.first, w.dist + e.w_ns + e.dd, list_append(w.path, e.dst) FROM walk w JOIN ce e ON e.run_id = w.run_id AND e.src = w.node),
best AS (SELECT run_id, max(dist) AS total_ns, arg_min(path, (-dist, node)) AS path FROM walk GROUP BY ALL)"""


@query("G1", "critical_path", f"WITH RECURSIVE {CH} SELECT run_id, total_ns, len(path) AS hops FROM best")
def _(spark, d):
    n, e = chains(spark, d)
    total, path = G.critical_path(n, e)
    return total.select("run_id", "total_ns").join(path.groupBy("run_id").agg(F.count(F.lit(1)).alias("hops")), "run_id")


COST = f"""{CH}, p AS (SELECT run_id, unnest(path) AS node, path FROM best), h AS (SELECT run_id, node, lag(node) OVER (PARTITION BY run_id ORDER BY list_position(path, node)) AS prev FROM p),
cost AS (SELECT run_id, stage, sum(ns)::BIGINT AS cost_ns FROM (SELECT h.run_id, x.stage, x.dur_ns AS ns FROM h JOIN x ON x.run_id = h.run_id AND x.node = h.node UNION ALL SELECT h.run_id, e.stage, e.w_ns FROM h JOIN ce e ON e.run_id = h.run_id AND e.src = h.prev AND e.dst = h.node) GROUP BY ALL)"""


@query("G2", "stage_cost", f"WITH RECURSIVE {COST} SELECT * FROM cost")
def _(spark, d):
    n, e = chains(spark, d)
    return G.stage_cost(n, e, G.critical_path(n, e)[1])


@query("G2", "path_diff", f"""WITH RECURSIVE {COST}, pr AS (SELECT DISTINCT run_id, split_part(run_id, '/', 1) || '/' || CAST(CAST(split_part(run_id, '/', 2) AS DATE) - 15 AS VARCHAR) AS healthy_id FROM x WHERE split_part(run_id, '/', 2) >= '2024-01-16'),
z AS (SELECT coalesce(f.run_id, h.run_id) AS run_id, coalesce(f.stage, h.stage) AS stage, coalesce(f.c, 0) - coalesce(h.c, 0) AS ex FROM (SELECT pr.run_id, stage, cost_ns AS c FROM pr JOIN cost USING (run_id)) f
 FULL JOIN (SELECT pr.run_id, cost.stage, cost_ns AS c FROM pr JOIN cost ON cost.run_id = pr.healthy_id) h ON f.run_id = h.run_id AND f.stage = h.stage)
SELECT run_id, arg_max(stage, (ex, stage)) AS regressed_stage, max(ex) AS excess_ns FROM z GROUP BY run_id""")
def _(spark, d):
    n, e = chains(spark, d)
    cost = materialize(G.stage_cost(n, e, G.critical_path(n, e)[1]), "cost")
    p = n.select("run_id").distinct().withColumn("day", F.substring_index("run_id", "/", -1)).where("day >= '2024-01-16'")
    p = p.select("run_id", F.concat_ws("/", F.substring_index("run_id", "/", 1), F.date_sub(C("day").cast("date"), 15).cast("string")).alias("healthy_id"))
    x, top = G.path_diff(p, cost)
    return top.join(x.groupBy("run_id").agg(F.max("excess_ns").alias("excess_ns")), "run_id").drop("healthy_id")


@query("G1", "traced_path", f"""WITH RECURSIVE {REC}, ed AS (SELECT e.run_id, src, dst, max(w_ns) AS w FROM edges e WHERE EXISTS (FROM nodes n WHERE n.run_id = e.run_id AND n.node = src) GROUP BY ALL),
it AS (SELECT run_id, node, dur_ns, dur_ns AS dist, NOT EXISTS (FROM ed WHERE ed.run_id = nodes.run_id AND dst = node) AS settled, true AS fresh, 0 AS k FROM nodes UNION ALL
 SELECT i.run_id, i.node, i.dur_ns, CASE WHEN NOT i.settled AND p.ok THEN greatest(i.dur_ns, p.d + i.dur_ns) ELSE i.dist END, i.settled OR coalesce(p.ok, false), NOT i.settled AND coalesce(p.ok, false), i.k + 1
 FROM (SELECT *, bool_or(fresh) OVER () AS go FROM it) i LEFT JOIN (SELECT s.run_id, ed.dst, bool_and(s.settled) AS ok, max(s.dist + w) AS d FROM it s JOIN ed ON ed.run_id = s.run_id AND ed.src = s.node GROUP BY ALL) p ON p.run_id = i.run_id AND p.dst = i.node WHERE go),
z AS (SELECT run_id, node, arg_max(dist, k) AS dist, arg_max(settled, k) AS settled FROM it GROUP BY ALL)
SELECT run_id, max(dist) AS total_ns, arg_min(node, (-dist, node)) AS end_node, count(*) FILTER (NOT settled) AS cyclic FROM z GROUP BY run_id""")
def _(spark, d):
    n, e = (materialize(x, "graph") for x in G.graph_tables(spans(spark, d)))
    both = G.solved(n, e)
    total, _ = G.critical_path(n, e, solution=both)
    every = G.node_values(n, e, solution=both).groupBy("run_id").agg(F.count_if("cyclic").alias("cyclic"))
    return total.join(every, "run_id")


HOOD = f"""{REC}, ct AS (SELECT run_id, max('gpu:' || cid) AS center FROM gpu GROUP BY ALL), adj AS (SELECT run_id, src AS a, dst AS b FROM edges UNION SELECT run_id, dst, src FROM edges),
h0 AS (SELECT run_id, center, center AS node FROM ct), h1 AS (SELECT * FROM h0 UNION SELECT h.run_id, center, b FROM h0 h JOIN adj ON adj.run_id = h.run_id AND a = node), h2 AS (SELECT * FROM h1 UNION SELECT h.run_id, center, b FROM h1 h JOIN adj ON adj.run_id = h.run_id AND a = node)"""


def centers(e):
    return e.where("kind = 'batch_share'").groupBy("run_id").agg(F.max("src").alias("center"))


@query("G3", "neighborhood", f"""WITH {HOOD} SELECT h.run_id, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.run_id = h.run_id AND EXISTS (FROM h2 x WHERE x.run_id = e.run_id AND x.node = e.src) AND EXISTS (FROM h2 x WHERE x.run_id = e.run_id AND x.node = e.dst)) AS edges FROM h2 h GROUP BY h.run_id""")
def _(spark, d):
    e = materialize(G.graph_tables(spans(spark, d))[1], "edges")
    n, x = G.neighborhood(e, centers(e), 2)
    return n.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes")).join(x.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges")), "run_id")


@query("G4", "producer_chain", f"""WITH {HOOD} SELECT h.run_id, center, node, g.r.s AS start_ns FROM h2 h JOIN gpu g ON g.run_id = h.run_id AND 'gpu:' || g.cid = node JOIN gpu c ON c.run_id = h.run_id AND 'gpu:' || c.cid = center WHERE node <> center AND g.r.s < c.r.s""")
def _(spark, d):
    s = spans(spark, d)
    e = materialize(G.graph_tables(s)[1], "edges")
    return G.producer_chain(s, e, centers(e))


@query("G5", "clock_offset", f"""WITH {GAPS}, rc AS (SELECT run_id, cid, kind, arg_max({{'s': start_ns, 'e': end_ns, 'id': event_id, 'k': k}}, event_id) AS r FROM traced WHERE kind IN ('cpu_launch', 'gpu_kernel') GROUP BY ALL),
j AS (SELECT coalesce(c.run_id, g.run_id) AS run_id, g.r.s - c.r.e - launch_gap_ns - g.r.k * 1000 AS r FROM (SELECT * FROM rc WHERE kind = 'cpu_launch') c FULL JOIN (SELECT * FROM rc WHERE kind = 'gpu_kernel') g ON g.run_id = c.run_id AND g.cid = c.cid LEFT JOIN lg ON lg.event_id = g.r.id),
m AS (SELECT run_id, median(r) AS off FROM j GROUP BY ALL)
SELECT j.run_id, coalesce(any_value(off), 0) AS offset_ns, CASE WHEN count(r) > 0 THEN max(abs(r - off)) + 1000 + (count(*) - count(r)) * 5000 ELSE 1e7 * count(*) END AS uncertainty_ns, count(r) AS n, count(*) - count(r) AS missing FROM j JOIN m USING (run_id) GROUP BY j.run_id""")
def _(spark, d):
    s = traced(spark, d)
    g = S.launch_gaps(s).select("run_id", "event_id", "launch_gap_ns", (C("k") * 1000).alias("queue_wait_ns"))
    return G.clock_offset(s, g)


NEED = """a AS (SELECT p_partkey AS id, CASE WHEN p_size = 50 THEN 'root' ELSE 'user' END AS capability FROM part),
nd AS (SELECT p_partkey AS item, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0 AND p_size % 3 <> 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 0 AND p_size % 4 = 1
 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 97 = 1 AND p_partkey > 1 AND p_size % 3 <> 0 UNION SELECT p_partkey, -p_partkey FROM part WHERE p_size = 49 AND p_partkey > 0),
rs AS (SELECT p_partkey AS id, p_brand AS k, 1.0 + CAST(replace(p_brand, 'Brand#', '') AS INT) AS seconds, 10.0 AS bytes, 0.0 AS pert FROM part)"""


def needs(spark, d):
    p = table(spark, d, "part")
    a = p.selectExpr("p_partkey id", "case when p_size = 50 then 'root' else 'user' end capability")
    n = (p.where("p_partkey > 0 and p_size % 3 <> 0").selectExpr("p_partkey item", "p_partkey div 2 needs").union(p.where("p_partkey > 0 and p_size % 4 = 1").selectExpr("p_partkey", "p_partkey div 5"))
         .union(p.where("p_partkey % 97 = 1 and p_partkey > 1 and p_size % 3 <> 0").selectExpr("p_partkey div 2", "p_partkey")).union(p.where("p_size = 49 and p_partkey > 0").selectExpr("p_partkey", "-p_partkey")).distinct())
    r = p.selectExpr("p_partkey id", "p_brand key", "1.0d + cast(replace(p_brand, 'Brand#', '') as int) seconds", "10.0d bytes", "0.0d perturbation")
    return a, n, r


@query("G6", "prerequisites", f"""WITH RECURSIVE {NEED}, re AS (SELECT id AS root, id AS item FROM a UNION SELECT root, needs FROM re JOIN nd USING (item)),
st AS (SELECT DISTINCT nd.item AS i0, nd.needs AS item FROM nd UNION SELECT i0, nd.needs FROM st JOIN nd USING (item)), cy AS (SELECT DISTINCT i0 AS item FROM st WHERE i0 = item),
f AS (SELECT root, count(*) AS size, bool_or(a.id IS NULL OR cy.item IS NOT NULL) AS broken, bool_or(coalesce(capability = 'root', false)) AS unc FROM re LEFT JOIN a ON a.id = re.item LEFT JOIN cy ON cy.item = re.item GROUP BY ALL),
ks AS (SELECT DISTINCT root, k, seconds, bytes FROM re JOIN rs ON rs.id = re.item WHERE k <> 'Brand#7'), co AS (SELECT root, sum(seconds) AS s, sum(bytes) AS b FROM ks GROUP BY ALL),
sh AS (SELECT root, bool_and(coalesce(k = 'Brand#7', false)) AS shared FROM re LEFT JOIN rs ON rs.id = re.item GROUP BY ALL)
SELECT root AS id, size, coalesce(s, 0)::DOUBLE AS seconds, coalesce(b, 0)::DOUBLE AS bytes, CASE WHEN broken THEN 'missing/cyclic prerequisite' WHEN unc THEN 'missing capability' WHEN coalesce(s, 0) <= 0 AND NOT shared THEN 'unknown cost' WHEN s > 60 OR b > 60 THEN 'budget exhausted' END AS rejected
FROM f LEFT JOIN co USING (root) LEFT JOIN sh USING (root)""")
def _(spark, d):
    a, n, r = needs(spark, d)
    act = r.where("key = 'Brand#7'").select("key").distinct()
    return G.prerequisites(a, n, r, act, ["user"], {"seconds": 60, "bytes": 60, "perturbation": 0}).drop("perturbation")


EVID = """ev AS (SELECT conv_id * 1000 + turn AS item, conv_id, turn, role = 'user' AS is_raw FROM conversations), inp AS (SELECT item, item - 1 AS needs FROM ev WHERE NOT is_raw UNION SELECT item, item - 2 FROM ev WHERE turn >= 2)"""


def evidence(spark, d):
    e = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn item", "conv_id", "turn", "role = 'user' is_raw")
    return e, e.where("not is_raw").selectExpr("item", "item - 1 needs").union(e.where("turn >= 2").selectExpr("item", "item - 2")).distinct()


@query("G7", "provenance", f"""WITH RECURSIVE {EVID}, cl AS (SELECT item AS claim, item FROM ev WHERE NOT is_raw UNION SELECT claim, needs FROM cl JOIN inp USING (item)) SELECT claim, item AS raw FROM cl JOIN ev USING (item) WHERE is_raw""")
def _(spark, d):
    e, i = evidence(spark, d)
    return G.provenance(e.where("not is_raw").select(C("item").alias("claim")), i, e)


@query("D7", "unresolved_refs", f"""WITH {EVID}, e AS (SELECT item, CASE WHEN turn = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS incident, CASE WHEN turn = 3 THEN 'trace' ELSE 'network' END AS domain, conv_id, turn FROM ev WHERE turn <> 5),
r AS (SELECT item AS id, incident, unnest([item - 1, item - 1000, item - 2]) AS ref FROM e WHERE turn > 1)
SELECT id, r.incident, ref, CASE WHEN e.item IS NULL THEN 'missing' WHEN e.domain <> 'network' THEN 'other domain' ELSE 'other incident' END AS reason FROM r LEFT JOIN e ON e.item = r.ref
WHERE e.item IS NULL OR e.domain <> 'network' OR (e.incident <> '' AND e.incident <> r.incident)""")
def _(spark, d):
    e, _i = evidence(spark, d)
    ev = e.where("turn <> 5").selectExpr("item id", "case when turn = 0 then '' else cast(conv_id as string) end incident", "case when turn = 3 then 'trace' else 'network' end domain", "turn")
    refs = ev.where("turn > 1").select("id", "incident", F.explode(F.array(C("id") - 1, C("id") - 1000, C("id") - 2)).alias("ref"))
    return G.unresolved_refs(refs, ev)


@query("G8", "nominate", f"""WITH {SPANS}, h AS (SELECT run_id, (lead(start_ns) OVER (PARTITION BY run_id ORDER BY start_ns, event_id) - end_ns) / 1e6 AS gap FROM spans WHERE kind = 'cpu_launch'),
b AS (SELECT run_id, dur_ns / 1e6 AS b, row_number() OVER (PARTITION BY run_id ORDER BY start_ns, event_id) AS i FROM spans WHERE kind = 'sync_edge'), v AS (SELECT run_id, var_pop(gap) AS vg, count(gap) AS n FROM h GROUP BY ALL), w AS (SELECT run_id, var_pop(b) AS vb, count(*) AS n FROM b WHERE i > 1 GROUP BY ALL)
SELECT v.run_id, CASE WHEN vg >= coalesce(vb, 0) AND v.n > 0 THEN 'host' WHEN w.n > 0 THEN 'sync' END AS nomination, false AS overrides_edge FROM v LEFT JOIN w USING (run_id)""")
def _(spark, d):
    return I.nominate(spans(spark, d))


@query("J13", "roofline", f"""WITH {SPANS} SELECT event_id, CASE WHEN d > 2 * greatest(tc, tm) * 1e9 THEN 'latency-bound' WHEN tc >= tm THEN 'compute-bound' ELSE 'memory-bound' END AS family FROM (SELECT event_id, dur_ns / 1e8 AS d, CASE name WHEN 'k1' THEN 2e9 WHEN 'k2' THEN 4e9 WHEN 'k3' THEN 2e8 ELSE 1e9 END / (100e12 * .35) AS tc,
 k * 1e6 / 1.6e12 AS tm FROM spans WHERE kind = 'gpu_kernel')""")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for kv in (("k1", "attn_kernel"), ("k2", "mlp_kernel"), ("k3", "layernorm_kernel")) for x in kv])
    k = spans(spark, d).where("kind = 'gpu_kernel'").select("event_id", F.coalesce(names[C("name")], C("name")).alias("name"), (C("dur_ns") / 1e8).alias("dur_ns"), (C("k") * 1e6).alias("bytes"))
    return G.roofline(k, spark.createDataFrame(list(G.KERNEL_FLOPS), "name string, flops double")).select("event_id", "family")


@query("D9", "indistinguishable", """WITH i AS (SELECT DISTINCT l_shipdate::DATE AS inc, l_orderkey AS path, l_partkey % 300 AS resource FROM lineitem), s AS (SELECT inc, resource, string_agg(path, ',' ORDER BY path) AS sig FROM i GROUP BY ALL)
SELECT CAST(inc AS VARCHAR) AS inc, min(resource) OVER (PARTITION BY inc, sig) AS class, resource, count(*) OVER (PARTITION BY inc, sig) AS members FROM s QUALIFY count(*) OVER (PARTITION BY inc, sig) > 1""")
def _(spark, d):
    i = table(spark, d, "lineitem").selectExpr("cast(cast(l_shipdate as date) as string) inc", "l_orderkey path", "l_partkey % 300 resource")
    return G.indistinguishable(i, "inc")


def bound_rounds(n):
    out = "b0 AS (SELECT DISTINCT resource, 0.0::DOUBLE AS lb, 'inf'::DOUBLE AS ub FROM inc)"
    for k in range(n):
        out += f""", x{k} AS (SELECT inc.path, inc.resource, lo, hi, lb, ub, sum(lb) OVER (PARTITION BY inc.path) - lb AS olb, coalesce(sum(ub) OVER (PARTITION BY inc.path ORDER BY inc.resource ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS oub FROM inc JOIN b{k} USING (resource)),
b{k + 1} AS (SELECT resource, greatest(max(lb), coalesce(max(lo - oub), 0)) AS lb, least(min(ub), min(hi - olb)) AS ub FROM x{k} GROUP BY ALL)"""
    return out


@query("C22", "path_bounds", f"""WITH inc AS (SELECT DISTINCT l_orderkey AS path, l_suppkey AS resource, lo, hi FROM lineitem JOIN (SELECT l_orderkey AS k, sum(l_quantity) * .9 AS lo, sum(l_quantity) * 1.1 + 40 AS hi FROM lineitem GROUP BY ALL) p ON k = l_orderkey),
{bound_rounds(3)} SELECT resource, round(lb, 6) AS lo, round(ub, 6) AS hi, lb > ub + 1e-9 AS inconsistent FROM b3""")
def _(spark, d):
    l = table(spark, d, "lineitem")
    p = l.groupBy(C("l_orderkey").alias("path")).agg((F.sum("l_quantity") * 0.9).alias("lo"), (F.sum("l_quantity") * 1.1 + 40).alias("hi"))
    return r6(G.path_bounds(l.select(C("l_orderkey").alias("path"), C("l_suppkey").alias("resource")), p), "lo", "hi")


M6 = f"""{REC}, c AS (SELECT run_id, stage, sum(ns) AS ns FROM (SELECT run_id, CASE stage WHEN 'kernel' THEN 'gpu' WHEN 'sync' THEN 'scheduler' WHEN 'transfer' THEN 'transport' WHEN 'host' THEN 'preprocess' END AS stage, dur_ns AS ns FROM nodes
 UNION ALL SELECT run_id, CASE WHEN stage = 'sync' THEN 'scheduler' ELSE 'cpu' END, w_ns FROM edges WHERE kind = 'host_order') WHERE stage IS NOT NULL GROUP BY ALL),
m AS (SELECT stage, sum(ns) / (SELECT count(DISTINCT run_id) FROM spans WHERE arm = 'reference') AS base FROM c WHERE run_id < '2024-01-16' GROUP BY ALL),
st AS (SELECT run_id, avg(k) AS dm, max(stream_id) AS sm FROM spans WHERE kind = 'gpu_kernel' GROUP BY ALL), bs AS (SELECT avg(dm) AS d, max(sm) AS s FROM st WHERE run_id < '2024-01-16'),
fl AS (SELECT run_id, bool_or(serialized) AS ser, bool_or(node = 'batch:shared') AS batch FROM nodes WHERE run_id >= '2024-01-16' GROUP BY ALL),
gr AS (SELECT fl.*, dm, sm, unnest(['cpu', 'scheduler', 'gpu', 'transport', 'preprocess', 'queue']) AS stage FROM fl LEFT JOIN st USING (run_id)),
sc AS (SELECT run_id, stage, greatest(coalesce(ns, 0) - coalesce(base, 0), 0) / 1e6 AS excess_ms, CASE WHEN ser AND stage = 'scheduler' THEN 2 WHEN ser AND stage = 'cpu' THEN .5 WHEN stage = 'queue' AND batch AND dm > bs.d AND sm > bs.s AND sm > 1 THEN 1.5 ELSE 1 END AS multiplier
 FROM gr LEFT JOIN c USING (run_id, stage) LEFT JOIN m USING (stage) CROSS JOIN bs)"""


def structural(spark, d):
    s = spans(spark, d)
    n, e = G.graph_tables(s)
    st = s.where("kind = 'gpu_kernel'").groupBy("run_id").agg(F.avg("k").alias("depth_mean"), F.max("stream_id").alias("streams_max"))
    return G.structural_scores(materialize(n, "nodes"), e, st, s.where("arm = 'reference'").select("run_id").distinct())


@query("M6", "structural_scores", f"WITH {M6} SELECT run_id, stage, round(excess_ms, 3) AS excess_ms, multiplier::DOUBLE AS multiplier FROM sc")
def _(spark, d):
    return r6(structural(spark, d), "excess_ms", digits=3)

