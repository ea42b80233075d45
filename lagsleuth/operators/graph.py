"""Dependency graphs of many runs, longest paths, neighbourhoods and closures.

Nodes: run_id, node, stage, dur_ns. Edges: run_id, src, dst, kind, confidence, observed, w_ns, stage.
Iterations store every round as a table (see ``storage``), so lineage stays short and lost executors cost one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import paths
from .ordered import join_on, scan
from .quantiles import median_mad
from .storage import materialize

C = F.col
# Device peaks and per-kernel work used by the roofline families.
PEAK_FLOPS, PEAK_BANDWIDTH, UTILISATION, DEFAULT_FLOPS = 100e12, 1.6e12, 0.35, 1e9
KERNEL_FLOPS = (("attn_kernel", 2.0e9), ("mlp_kernel", 4.0e9), ("layernorm_kernel", 0.2e9))


def last_records(spans: DataFrame) -> DataFrame:
    """One row per (run, id) with the last host, kernel, transfer and sync record of that id as structs."""
    rec = F.struct("start_ns", "end_ns", "dur_ns", "stream_id", "k", "event_id")
    def last(kind):
        return F.max_by(rec, F.when(C("kind") == kind, C("event_id")))
    return spans.where(F.coalesce("cid", F.lit("")) != "").groupBy("run_id", "cid").agg(
        last("cpu_launch").alias("cpu"), last("gpu_kernel").alias("gpu"), last("transfer").alias("tx"), last("sync_edge").alias("sync"))


def _serialized(s: str = "sync"):
    return C(f"{s}.k") % 2 == 0


def graph_tables(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every run. No order is invented: an id seen on one side only gets an explicit unknown edge, and
    consecutive kernels of a stream are ordered only when their host rows are adjacent."""
    w = materialize(last_records(spans), "last-records")
    name = lambda p: F.concat(F.lit(p + ":"), C("cid"))
    kinds = (("cpu", "cpu", "host"), ("gpu", "gpu", "kernel"), ("tx", "tx", "transfer"), ("sync", "sync", "sync"))
    one_sided = C("cpu").isNull() | C("gpu").isNull()
    dur = lambda s: F.when(F.lit(s in ("cpu", "sync")), C(f"{s}.end_ns") - C(f"{s}.start_ns")).otherwise(C(f"{s}.dur_ns"))
    cand = F.array(*[F.when(C(s).isNotNull(), F.struct(name(p).alias("node"), F.lit(st).alias("stage"), dur(s).alias("dur_ns"),
                                                       (F.coalesce(_serialized(), F.lit(False)) if s == "sync" else F.lit(False)).alias("serialized"))) for s, p, st in kinds],
                   F.when(one_sided, F.struct(name("unknown").alias("node"), F.lit("other").alias("stage"), F.lit(0).cast("long").alias("dur_ns"), F.lit(False).alias("serialized"))))
    nodes = w.select("run_id", F.explode(F.array_compact(cand)).alias("n")).select("run_id", "n.*")

    def edge(src, dst, kind, conf, seen, wt, stage):
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"), F.lit(seen).alias("observed"),
                        wt.cast("long").alias("w_ns"), (stage if not isinstance(stage, str) else F.lit(stage)).alias("stage"))
    zero = F.lit(0)
    has = lambda *s: [C(x).isNotNull() for x in s]
    def both(a, b):
        x, y = has(a, b)
        return x & y
    local = F.array(
        F.when(both("cpu", "gpu"), edge(name("cpu"), name("gpu"), "enqueue", 1.0, True, F.greatest(zero, C("gpu.start_ns") - C("cpu.end_ns")), "host")),
        F.when(C("cpu").isNotNull() & C("gpu").isNull(), edge(name("cpu"), name("unknown"), "unknown", 0.0, False, zero, "other")),
        F.when(C("gpu").isNotNull() & C("cpu").isNull(), edge(name("gpu"), name("unknown"), "unknown", 0.0, False, zero, "other")),
        F.when(both("tx", "gpu"), edge(name("tx"), name("gpu"), "transfer", 0.8, True, zero, "transfer")),
        F.when(both("gpu", "sync"), edge(name("gpu"), name("sync"), "sync", 1.0, True, zero, "sync")))
    edges = w.select("run_id", F.explode(F.array_compact(local)).alias("e")).select("run_id", "e.*")
    h = w.where("cpu is not null").select("run_id", "cid", C("cpu.start_ns").alias("at"), C("cpu.event_id").alias("eid"), C("cpu.end_ns").alias("end_ns"),
                                          F.coalesce(_serialized(), F.lit(False)).alias("ser"))
    h = materialize(scan(h, ["run_id"], ["at", "eid"], nxt=("lead", F.struct("cid", "at")), pos=("sum", F.lit(1))), "host-order")
    nx = F.concat(F.lit("cpu:"), C("nxt.cid"))
    hops = F.array(edge(name("cpu"), nx, "host_order", 1.0, True, F.greatest(zero, C("nxt.at") - C("end_ns")), F.when(C("ser"), "sync").otherwise("host")),
                   F.when(C("ser"), edge(name("sync"), nx, "sync_host", 1.0, True, zero, "sync")))
    edges = edges.unionByName(h.where("nxt is not null").select("run_id", F.explode(F.array_compact(hops)).alias("e")).select("run_id", "e.*"))
    g = w.where("gpu is not null").select("run_id", "cid", C("gpu.stream_id").alias("stream_id"), C("gpu.start_ns").alias("at"))
    g = g.join(h.select("run_id", "cid", "pos"), ["run_id", "cid"], "left")
    g = scan(materialize(g, "streams"), ["run_id", "stream_id"], ["at", "cid"], nxt=("lead", F.struct("cid", "pos"))).where("nxt is not null")
    adj = F.coalesce(C("nxt.pos") - C("pos") == 1, F.lit(False))
    ng = F.concat(F.lit("gpu:"), C("nxt.cid"))
    order = F.when(adj, edge(name("gpu"), ng, "stream_order", 0.9, True, zero, "kernel")).otherwise(edge(name("gpu"), ng, "unknown", 0.0, False, zero, "other"))
    edges = edges.unionByName(g.select("run_id", order.alias("e")).select("run_id", "e.*"))
    multi = w.where("gpu is not null").groupBy("run_id").agg((F.min("gpu.stream_id") != F.max("gpu.stream_id")).alias("m")).where("m").select("run_id")
    nodes = nodes.unionByName(multi.select("run_id", F.lit("batch:shared").alias("node"), F.lit("other").alias("stage"), F.lit(0).cast("long").alias("dur_ns"), F.lit(False).alias("serialized")))
    share = w.where("gpu is not null").join(multi, "run_id").select("run_id", edge(name("gpu"), F.lit("batch:shared"), "batch_share", 0.5, False, zero, "other").alias("e"))
    return nodes, edges.unionByName(share.select("run_id", "e.*"))


def critical_path(nodes: DataFrame, edges: DataFrame, order: str | None = None, local_rows: int = paths.LOCAL_ROWS, block_nodes: int = paths.BLOCK_NODES, solution: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(total per run, path rows) of the longest path by node durations and edge waits; ties go to the lower node id.

    Runs of at most ``local_rows`` nodes and edges are solved whole, many to a task; larger ones in blocks along ``order``, a numeric column
    of nodes (their start, say), see ``paths``. Their path is marked by doubling. Nodes on or behind a cycle keep their own
    duration and are flagged (``cyclic``); edges from or to unknown nodes do not count. ``solution``: what `solved` gave for this graph."""
    state, end, path = solution or solved(nodes, edges, order, local_rows, block_nodes)
    return end, path


def node_values(nodes: DataFrame, edges: DataFrame, order: str | None = None, local_rows: int = paths.LOCAL_ROWS, block_nodes: int = paths.BLOCK_NODES, solution: tuple | None = None) -> DataFrame:
    """(run_id, node, dist, prev, cyclic) of all nodes: the longest path that ends there."""
    return (solution or solved(nodes, edges, order, local_rows, block_nodes))[0]


def solved(nodes: DataFrame, edges: DataFrame, order: str | None = None, local_rows: int = paths.LOCAL_ROWS, block_nodes: int = paths.BLOCK_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all nodes' values, end of each run, path rows)."""
    own = nodes.select("run_id", "node", "dur_ns", (C(order) if order else F.xxhash64("node")).cast("double").alias("at"))
    e = edges.groupBy("run_id", "src", "dst").agg(F.max("w_ns").alias("w_ns")).join(own.select("run_id", C("node").alias("dst"), "dur_ns"), ["run_id", "dst"])
    e = materialize(e.select("run_id", "src", "dst", (C("w_ns") + C("dur_ns")).alias("step")), "edges")
    sizes = own.select("run_id").unionByName(e.select("run_id")).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    large = materialize(sizes.where(C("rows") > local_rows).select("run_id"), "large-runs")
    some = not large.isEmpty()
    small_nodes, small_edges = (own.join(large, "run_id", "left_anti"), e.join(large, "run_id", "left_anti")) if some else (own, e)
    state = materialize(paths.solve_small(small_nodes, small_edges), "longest")
    end = state.groupBy("run_id").agg(F.max("dist").alias("total_ns"), F.min_by("node", F.struct(-C("dist"), C("node"))).alias("end_node"))
    path = state.where("marked").drop("marked")
    if some:
        values, more, its = path_of_large(own.join(large, "run_id", "left_semi"), e.join(large, "run_id", "left_semi"), local_rows, block_nodes)
        state, end, path = state.drop("marked").unionByName(values), end.unionByName(more), path.unionByName(its)
    return state.select("run_id", "node", "dist", "prev", "cyclic"), end, path


def path_of_large(own: DataFrame, e: DataFrame, local_rows: int, block_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = materialize(e.join(own.select("run_id", C("node").alias("src")), ["run_id", "src"], "left_semi"), "edges")
    done = paths.longest_large(own.withColumnRenamed("dur_ns", "least"), e, "at", local_rows, block_nodes)
    far = materialize(own.join(done, ["run_id", "node"], "left").select("run_id", "node", "dur_ns", F.coalesce("dist", "dur_ns").alias("dist"), C("dist").isNull().alias("cyclic")), "dist")
    into = e.join(far.where("not cyclic").select("run_id", C("node").alias("src"), C("dist").alias("from")), ["run_id", "src"])
    best = into.groupBy("run_id", C("dst").alias("node")).agg(F.max(C("from") + C("step")).alias("d"), F.min_by("src", F.struct(-(C("from") + C("step")), C("src"))).alias("prev"))
    state = far.join(best, ["run_id", "node"], "left").select("run_id", "node", "dist", F.when(~C("cyclic") & (C("d") > C("dur_ns")), C("prev")).alias("prev"), "cyclic")
    state = materialize(state, "longest")
    end = state.groupBy("run_id").agg(F.max("dist").alias("total_ns"), F.min_by("node", F.struct(-C("dist"), C("node"))).alias("end_node"))
    jump, marked = state.where("prev is not null").select("run_id", "node", C("prev").alias("up")), end.select("run_id", C("end_node").alias("node"))
    while not jump.isEmpty():
        step = marked.join(jump, ["run_id", "node"]).select("run_id", C("up").alias("node"))
        marked = materialize(marked.unionByName(step), "path")
        j2 = jump.select("run_id", C("node").alias("up"), C("up").alias("up2"))
        jump = materialize(jump.join(j2, ["run_id", "up"]).select("run_id", "node", C("up2").alias("up")), "jump")
    return state, end, marked.join(state, ["run_id", "node"])


def stage_cost(nodes: DataFrame, edges: DataFrame, path: DataFrame) -> DataFrame:
    """Cost per (run, stage) on the path: node durations and the waits of edges between consecutive path nodes."""
    on = path.select("run_id", "node").join(nodes, ["run_id", "node"]).select("run_id", "stage", C("dur_ns").alias("ns"))
    hop = path.where("prev is not null").select("run_id", C("prev").alias("src"), C("node").alias("dst"))
    we = hop.join(edges, ["run_id", "src", "dst"]).select("run_id", "stage", C("w_ns").alias("ns"))
    return on.unionByName(we).groupBy("run_id", "stage").agg(F.sum("ns").alias("cost_ns"))


def path_diff(pairs: DataFrame, cost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(excess per stage, regressed stage) of each pair run_id / healthy_id."""
    f = pairs.join(cost, "run_id").select("run_id", "healthy_id", "stage", C("cost_ns").alias("f"))
    h = pairs.join(cost.withColumnRenamed("run_id", "healthy_id"), "healthy_id").select("run_id", "healthy_id", "stage", C("cost_ns").alias("h"))
    x = f.join(h, ["run_id", "healthy_id", "stage"], "full").withColumn("excess_ns", F.coalesce("f", F.lit(0)) - F.coalesce("h", F.lit(0)))
    top = x.groupBy("run_id", "healthy_id").agg(F.max_by("stage", F.struct("excess_ns", "stage")).alias("regressed_stage"))
    return x.select("run_id", "healthy_id", "stage", "excess_ns"), top


def neighborhood(edges: DataFrame, centers: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges) within ``radius`` undirected hops; centers: run_id, center."""
    adj = edges.select("run_id", C("src").alias("node"), C("dst").alias("to")).union(edges.select("run_id", "dst", "src")).distinct()
    seen = centers.select("run_id", "center", C("center").alias("node"))
    for _ in range(radius):
        step = seen.join(adj, ["run_id", "node"]).select("run_id", "center", C("to").alias("node"))
        seen = materialize(seen.union(step).distinct(), "hood")
    a = seen.withColumnRenamed("node", "src")
    inside = edges.join(a, ["run_id", "src"]).join(seen.withColumnRenamed("node", "dst"), ["run_id", "center", "dst"])
    return seen, inside


def producer_chain(spans: DataFrame, edges: DataFrame, centers: DataFrame, radius: int = 2) -> DataFrame:
    """Kernels in the slice around each suspect kernel that start before it, in start order."""
    g = materialize(last_records(spans).where("gpu is not null").select("run_id", F.concat(F.lit("gpu:"), C("cid")).alias("node"), C("gpu.start_ns").alias("start_ns")), "kernels")
    seen, _ = neighborhood(edges, centers, radius)
    t0 = seen.where("node = center").join(g, ["run_id", "node"]).select("run_id", "center", C("start_ns").alias("t0"))
    return seen.where("node <> center").join(g, ["run_id", "node"]).join(t0, ["run_id", "center"]).where("start_ns < t0").select("run_id", "center", "node", "start_ns")


def clock_offset(spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per run: host/device offset (median) and its uncertainty; unmatched ids widen the bound, never move the estimate.
    ``gaps``: run_id, event_id, launch_gap_ns, queue_wait_ns of each kernel."""
    w = last_records(spans.where("kind in ('cpu_launch', 'gpu_kernel')"))
    w = w.withColumn("event_id", C("gpu.event_id")).join(gaps, ["run_id", "event_id"], "left")
    r = materialize(w.select("run_id", F.when(C("cpu").isNotNull() & C("gpu").isNotNull(), C("gpu.start_ns") - C("cpu.end_ns") - C("launch_gap_ns") - C("queue_wait_ns")).cast("double").alias("r")), "offsets")
    m = median_mad(r, ["run_id"], "r").select("run_id", C("med").alias("off"))
    g = r.join(m, "run_id", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count("r").alias("n"), F.max("off").alias("off"), F.max(F.abs(C("r") - C("off"))).alias("spread"))
    miss = C("total") - C("n")
    return g.select("run_id", F.coalesce("off", F.lit(0.0)).alias("offset_ns"),
                    F.when(C("n") > 0, C("spread") + 1000 + miss * 5000).otherwise(1e7 * F.greatest("total", F.lit(1))).alias("uncertainty_ns"), "n", miss.alias("missing"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, item): everything reachable from each root over (item, needs), the root included. Only new rows are expanded."""
    seen = materialize(roots.select("root", C("root").alias("item")).distinct(), "closure")
    front = seen
    while True:
        step = front.join(edges, "item").select("root", C("needs").alias("item")).distinct()
        new = materialize(step.join(seen, ["root", "item"], "left_anti"), "front")
        if new.isEmpty():
            return seen
        seen = materialize(seen.unionByName(new), "closure")
        front = new


def into_cycles(edges: DataFrame) -> DataFrame:
    """(item) for the items on a cycle of (item, needs), or that need one: what is left when items that need nothing are taken off again and again.

    A chain goes from both ends in a round: items that nobody left needs are set aside with the edge that they hang on, and
    go back over these edges at the end, so only what stands between cycles is worked on in full."""
    left = materialize(edges.select("item", "needs").distinct(), "needs")
    aside, n = [], left.count()
    while n:
        kept = left.join(left.select(C("item").alias("needs")).distinct(), "needs", "left_semi").select("item", "needs")
        kept = materialize(kept, "needs")
        inner = materialize(kept.join(kept.select(C("needs").alias("item")).distinct(), "item", "left_semi").select("item", "needs"), "needs")
        aside.append(kept.join(inner.select("item").distinct(), "item", "left_anti"))
        left, before, n = inner, n, inner.count()
        if n == before:
            break
    found = left.select("item").distinct()
    for hanging in reversed(aside):
        more = hanging.join(found.select(C("item").alias("needs")), "needs", "left_semi").select("item").distinct()
        found = materialize(found.unionByName(more).distinct(), "into-cycles")
    return found


def prerequisites(actions: DataFrame, needs: DataFrame, resources: DataFrame, active: DataFrame, capabilities: list[str], budgets: dict[str, float]) -> DataFrame:
    """Bundle per action: transitive prerequisites with costs, each shared resource once; rejected with a reason.

    actions: id, capability; needs: item, needs; resources: id, key, seconds, bytes, perturbation; active: key.
    Missing or cyclic prerequisites, missing capabilities, unknown cost and exhausted budgets reject an action."""
    reach = closure(needs, actions.select(C("id").alias("root")))
    cyclic = into_cycles(needs).withColumn("cyc", F.lit(True))
    b = materialize(reach.join(actions.select(C("id").alias("item"), "capability"), "item", "left").join(cyclic, "item", "left"), "bundle")
    flags = b.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("cyc", F.lit(False)) | C("capability").isNull()).alias("broken"),
                                  F.max(~F.coalesce(C("capability").isin(capabilities), F.lit(True))).alias("uncapable"))
    res = b.select("root", "item").join(resources.withColumnRenamed("id", "item"), "item")
    open_ = res.join(active, "key", "left_anti")
    costs = ("seconds", "bytes", "perturbation")
    once = open_.groupBy("root", "key").agg(*[F.max(c).alias(c) for c in costs], F.max(F.coalesce(*[F.when(C(c).isNull() | (C(c) < 0), True) for c in costs], F.lit(False))).alias("unknown"))
    cost = once.groupBy("root").agg(*[F.sum(c).alias(c) for c in costs], F.max("unknown").alias("unknown"))
    held = b.select("root", "item").join(resources.select(C("id").alias("item"), "key"), "item", "left").join(active.withColumn("act", F.lit(True)), "key", "left").groupBy("root").agg(F.bool_and(F.coalesce("act", F.lit(False))).alias("shared"))
    j = flags.join(cost, "root", "left").join(held, "root", "left")
    for c in costs:
        j = j.withColumn(c, F.coalesce(c, F.lit(0.0)))
    over = F.lit(False)
    for c in costs:
        over = over | (C(c) > budgets.get(c, 0))
    why = (F.when(C("broken"), "missing/cyclic prerequisite").when(C("uncapable"), "missing capability")
           .when(F.coalesce("unknown", F.lit(False)) | ((C("seconds") <= 0) & ~C("shared")), "unknown cost").when(over, "budget exhausted"))
    return j.select(C("root").alias("id"), "size", *costs, why.alias("rejected"))


def provenance(claims: DataFrame, inputs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim, raw): every raw event transitively behind a claim. inputs: item, needs; evidence: item, is_raw."""
    c = closure(inputs, claims.select(C("claim").alias("root")))
    return c.join(evidence.where("is_raw").select("item"), "item").select(C("root").alias("claim"), C("item").alias("raw"))


def unresolved_refs(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """References (id, incident, ref) that do not point to network evidence of the same or no incident, with the reason."""
    e = evidence.select(C("id").alias("ref"), C("incident").alias("e_incident"), C("domain").alias("e_domain"), F.lit(True).alias("found"))
    j = refs.join(e, "ref", "left")
    why = (F.when(C("found").isNull(), "missing").when(C("e_domain") != "network", "other domain")
           .when((C("e_incident") != "") & (C("e_incident") != C("incident")), "other incident"))
    return j.withColumn("reason", why).where("reason is not null").select("id", "incident", "ref", "reason")


def roofline(kernels: DataFrame, priors: DataFrame) -> DataFrame:
    """Family per kernel: latency bound above twice the modelled time, else the larger of compute and memory time."""
    j = kernels.join(priors, "name", "left")
    tc = F.coalesce("flops", F.lit(DEFAULT_FLOPS)) / (PEAK_FLOPS * UTILISATION)
    tm = C("bytes") / PEAK_BANDWIDTH
    return j.withColumn("family", F.when(C("dur_ns") > 2.0 * F.greatest(tc, tm) * 1e9, "latency-bound").when(tc >= tm, "compute-bound").otherwise("memory-bound")).drop("flops")


def indistinguishable(incidence: DataFrame, key: str) -> DataFrame:
    """(class, resource) for resources crossing exactly the same paths. Path sets are compared by count and two 64-bit
    fingerprints, so no path list is gathered."""
    s = incidence.select(key, "resource", "path").distinct().groupBy(key, "resource").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path")).alias("h1"), F.sum(F.xxhash64(F.lit("p"), "path").cast("decimal(20,0)")).alias("h2"))
    g = s.groupBy(key, "n", "h1", "h2").agg(F.min("resource").alias("class"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return join_on(s, g, [key, "n", "h1", "h2"]).select(key, "class", "resource", "members")


def path_bounds(incidence: DataFrame, paths: DataFrame, rounds: int = 3) -> DataFrame:
    """Outer bounds of each resource's delay from additive path intervals, by ``rounds`` rounds of interval propagation.

    Every round is valid and none is looser than the one before; on inconsistent models the bounds would cross and drift for ever,
    so the number of rounds is a parameter and not a test for rest.

    incidence: path, resource; paths: path, lo, hi. A bound of null means unlimited; lo > hi marks an inconsistent model."""
    inc = materialize(incidence.select("path", "resource").distinct().join(paths, "path"), "incidence")
    b = inc.select("resource").distinct().select("resource", F.lit(0.0).alias("lb"), F.lit(None).cast("double").alias("ub"))
    for _ in range(rounds):
        j = inc.join(b, "resource")
        s = j.groupBy("path").agg(F.sum("lb").alias("slb"), F.sum("ub").alias("sub"), F.count_if(C("ub").isNull()).alias("open"))
        x = j.join(s, "path")
        others_open = C("open") - F.when(C("ub").isNull(), 1).otherwise(0)
        lo = F.when(others_open == 0, C("lo") - (C("sub") - F.coalesce("ub", F.lit(0.0))))
        lo = F.when((others_open == 0) & (C("open") > 0), C("lo") - F.coalesce("sub", F.lit(0.0))).otherwise(lo)
        hi = C("hi") - (C("slb") - C("lb"))
        b = materialize(x.groupBy("resource").agg(F.greatest(F.max("lb"), F.coalesce(F.max(lo), F.lit(0.0))).alias("lb"), F.least(F.min(hi), F.min("ub")).alias("ub")), "bounds")
    return b.select("resource", C("lb").alias("lo"), C("ub").alias("hi"), F.coalesce(C("lb") > C("ub") + 1e-9, F.lit(False)).alias("inconsistent"))


def structural_scores(nodes: DataFrame, edges: DataFrame, streams: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per incident run and stage: component excess over the mean of the baseline runs (ms, not below 0) and multiplier.

    ``streams``: run_id, depth_mean, streams_max of each run; ``baseline``: run_id of the healthy runs."""
    st = F.create_map(*[F.lit(x) for kv in {"kernel": "gpu", "sync": "scheduler", "transfer": "transport", "host": "preprocess"}.items() for x in kv])
    n = nodes.select("run_id", st[C("stage")].alias("stage"), C("dur_ns").alias("ns")).where("stage is not null")
    e = edges.where("kind = 'host_order'").select("run_id", F.when(C("stage") == "sync", "scheduler").otherwise("cpu").alias("stage"), C("w_ns").alias("ns"))
    c = n.unionByName(e).groupBy("run_id", "stage").agg(F.sum("ns").alias("ns"))
    base = baseline.select("run_id").distinct()
    nb = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    m = c.join(base, "run_id").groupBy("stage").agg((F.sum("ns") / nb).alias("base"))
    flags = nodes.groupBy("run_id").agg(F.max("serialized").alias("ser"), F.max(C("node") == "batch:shared").alias("batch")).join(streams, "run_id", "left").join(base, "run_id", "left_anti")
    bs = streams.join(base, "run_id").agg(F.struct(F.avg("depth_mean").alias("d"), F.max("streams_max").alias("s")).alias("b")).scalar()
    crowd = C("batch") & (C("depth_mean") > bs["d"]) & (C("streams_max") > bs["s"]) & (C("streams_max") > 1)
    grid = flags.select("run_id", "ser", F.coalesce(crowd, F.lit(False)).alias("crowd"), F.explode(F.array(*[F.lit(s) for s in ("cpu", "scheduler", "gpu", "transport", "preprocess", "queue")])).alias("stage"))
    x = grid.join(c, ["run_id", "stage"], "left").join(m, "stage", "left")
    ms = F.greatest(F.coalesce("ns", F.lit(0)) - F.coalesce("base", F.lit(0.0)), F.lit(0.0)) / 1e6
    mult = (F.when(C("ser") & (C("stage") == "scheduler"), 2.0).when(C("ser") & (C("stage") == "cpu"), 0.5).when(C("crowd") & (C("stage") == "queue"), 1.5).otherwise(1.0))
    return x.select("run_id", "stage", ms.alias("excess_ms"), mult.alias("multiplier"))
