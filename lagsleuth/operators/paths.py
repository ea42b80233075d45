"""Longest paths of many runs: small runs whole, many to a task; large runs by contraction of blocks.

A run of at most LOCAL_ROWS nodes and edges is solved by one task, together with other small ones. The nodes of a larger run are cut into
blocks along an order. A block is replaced by its border, the nodes with an edge from or to another block, and by one step for each pair
(node entered from outside, border node behind it): the longest way between them inside. What is left is a smaller run, and so on, until
it is small; then each block is solved again with the values of its border. Rounds follow the logarithm of a run's size as long as
few edges leave a block. A run that does not shrink that way is reduced to its core by `cored_longest`; a core that is
still large is settled by `doubled_longest`.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import scan
from .storage import materialize

C = F.col
LOCAL_ROWS = 100_000
BLOCK_NODES = 8_192
MOST_ENTRIES = 512
STATE = "run_id string, node string, dist bigint, prev string, cyclic boolean, marked boolean"
ROWS = "run_id string, block bigint, src string, node string, num bigint, known bigint, role string"


class Local:
    """The nodes and steps of one or more graphs, numbered, in topological order as far as there is one."""

    def __init__(self, names: list, least: list[int], edges: list[tuple]):
        self.names, self.least = names, least
        at = {n: i for i, n in enumerate(names)}
        self.into: list[list] = [[] for _ in names]
        self.out: list[list] = [[] for _ in names]
        for a, b, step in edges:
            i, j = at.get(a), at.get(b)
            if i is not None and j is not None:
                self.out[i].append((j, step))
                self.into[j].append((i, step))
        need = [len(x) for x in self.into]
        self.order = [i for i, n in enumerate(need) if n == 0]
        for i in self.order:
            for j, _ in self.out[i]:
                need[j] -= 1
                if need[j] == 0:
                    self.order.append(j)
        self.cyclic = [n > 0 for n in need]

    def longest(self, known: dict[int, int] | None = None) -> list[int]:
        """Each node's value: its own, or that of a predecessor and the step, or the value known from outside if that is larger."""
        dist = list(self.least)
        for i, d in (known or {}).items():
            dist[i] = max(dist[i], d)
        for j in self.order:
            for i, step in self.into[j]:
                if dist[i] + step > dist[j]:
                    dist[j] = dist[i] + step
        return dist

    def best(self, j: int, dist: list[int]):
        """The predecessor that gives a node its value, the first by name of equals; None if the node starts a path."""
        found = [(-(dist[i] + step), self.names[i]) for i, step in self.into[j] if not self.cyclic[i] and dist[i] + step > self.least[j]]
        return min(found)[1] if found else None


def solve_small(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, node, dist, prev, cyclic, marked) of whole runs; marked nodes lie on the run's longest path."""
    none = F.lit(None).cast("string")
    rows = nodes.select("run_id", none.alias("src"), "node", C("dur_ns").alias("num")).unionByName(edges.select("run_id", "src", C("dst").alias("node"), C("step").alias("num")))

    def solve(held):
        keys = [(r, n) for r, s, n, _ in held if s is None]
        g = Local(keys, [v for _, s, _, v in held if s is None], [((r, s), (r, n), v) for r, s, n, v in held if s is not None])
        dist = g.longest()
        dist = [g.least[i] if g.cyclic[i] else d for i, d in enumerate(dist)]
        prev = [None if g.cyclic[j] else (g.best(j, dist) or (None, None))[1] for j in range(len(keys))]
        ends: dict = {}
        for i, (run, node) in enumerate(keys):
            if run not in ends or (-dist[i], node) < ends[run]:
                ends[run] = (-dist[i], node)
        at, marked = {k: i for i, k in enumerate(keys)}, [False] * len(keys)
        for run, (_, node) in ends.items():
            while node is not None:
                marked[at[run, node]] = True
                node = prev[at[run, node]]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(dist, pa.int64()), pa.array(prev, pa.string()),
                                           pa.array(g.cyclic, pa.bool_()), pa.array(marked, pa.bool_())], names=["run_id", "node", "dist", "prev", "cyclic", "marked"])

    def run(batches):
        held: list = []
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            if held and len(held) + len(rows) > LOCAL_ROWS:  # whole runs go
                last = held[-1][0]
                whole = [r for r in held if r[0] != last]
                if whole:
                    yield solve(whole)
                    held = [r for r in held if r[0] == last]
            held += rows
        if held:
            yield solve(held)

    return rows.repartition("run_id").sortWithinPartitions("run_id").mapInArrow(run, STATE)


def in_blocks(nodes: DataFrame, edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """Nodes and inner edges by block; role of a node: e entered from outside, x left to outside, b both."""
    of = nodes.select("run_id", "node", "block")
    inner = edges.where("src_block = dst_block").select("run_id", C("src_block").alias("block"), "src", C("dst").alias("node"), C("step").alias("num"), F.lit(None).cast("bigint").alias("known"), F.lit("").alias("role"))
    across = edges.where("src_block <> dst_block")
    marks = across.select("run_id", C("dst").alias("node"), F.lit("e").alias("m")).unionByName(across.select("run_id", C("src").alias("node"), F.lit("x").alias("m")))
    marks = marks.groupBy("run_id", "node").agg(F.when(F.min("m") != F.max("m"), "b").otherwise(F.min("m")).alias("role"))
    own = nodes.select("run_id", "block", F.lit(None).cast("string").alias("src"), "node", C("least").alias("num")).join(marks, ["run_id", "node"], "left")
    own = own.join(known, ["run_id", "node"], "left") if known is not None else own.withColumn("known", F.lit(None).cast("bigint"))
    return own.select("run_id", "block", "src", "node", "num", "known", F.coalesce("role", F.lit("")).alias("role")).unionByName(inner).repartition("run_id", "block")


def local_of(t: pa.Table):
    rows = list(zip(*(t.column(c).to_pylist() for c in ("src", "node", "num", "known", "role"))))
    own = sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    return own, Local([r[1] for r in own], [r[2] for r in own], [(s, n, v) for s, n, v, _, _ in rows if s is not None])


def shrink_block(key, t):
    """A block's border nodes (src null) with their values from inside, and the steps between them. A block with too many entries stays as it is."""
    run, block = (k.as_py() for k in key)
    own, g = local_of(t)
    entries = [i for i, r in enumerate(own) if r[4] in ("e", "b")]
    border = {i for i, r in enumerate(own) if r[4]}
    if len(entries) > MOST_ENTRIES:
        out = [(None, r[1], r[2]) for r in own] + [(g.names[i], g.names[j], s) for i in range(len(own)) for j, s in g.out[i]]
    else:
        reach: dict[int, np.ndarray] = {}
        far = np.int64(-(2**62))
        slot = {i: k for k, i in enumerate(entries)}
        out, left = [], [sum(1 for j, _ in g.out[i] if not g.cyclic[j]) for i in range(len(own))]
        for j in g.order:
            v = None
            for i, step in g.into[j]:
                u = reach.get(i)
                if u is not None:
                    v = u + step if v is None else np.maximum(v, u + step)
                left[i] -= 1
                if left[i] == 0:
                    reach.pop(i, None)
            if v is not None and j in border:
                out += [(g.names[entries[k]], g.names[j], int(v[k])) for k in np.flatnonzero(v > far // 2) if entries[k] != j]
            if j in slot:
                v = np.full(len(entries), far) if v is None else v.copy()
                v[slot[j]] = 0
            if v is not None and left[j]:
                reach[j] = v
        dist = g.longest()
        out += [(None, g.names[i], dist[i]) for i in border if not g.cyclic[i]]
        # what lies on or behind a cycle in here waits for itself
        out += [x for i in border if g.cyclic[i] for x in ((None, g.names[i], g.least[i]), (g.names[i], g.names[i], 0))]
    return pa.table({"run_id": pa.array([run] * len(out), pa.string()), "src": pa.array([x[0] for x in out], pa.string()), "node": pa.array([x[1] for x in out], pa.string()), "num": pa.array([x[2] for x in out], pa.int64())})


def open_block(key, t):
    """The values of all nodes of a block whose border is known."""
    run, _ = (k.as_py() for k in key)
    own, g = local_of(t)
    border = {i: r[3] for i, r in enumerate(own) if r[3] is not None}
    unknown = {i for i, r in enumerate(own) if r[4] and r[3] is None}  # cyclic from outside
    dist = g.longest(border)
    for j in g.order:
        if any(i in unknown for i, _ in g.into[j]):
            unknown.add(j)
    keep = [i for i in range(len(own)) if not g.cyclic[i] and i not in unknown]
    return pa.table({"run_id": pa.array([run] * len(keep), pa.string()), "node": pa.array([g.names[i] for i in keep], pa.string()), "dist": pa.array([dist[i] for i in keep], pa.int64())})


def blocked(nodes: DataFrame, edges: DataFrame, order: str, block_nodes: int) -> tuple[DataFrame, DataFrame]:
    placed = scan(nodes, ["run_id"], [order, "node"], _pos=("sum", F.lit(1)))
    n = materialize(placed.withColumn("block", F.expr(f"(_pos - 1) div {block_nodes}")).drop("_pos"), "blocks")
    of = n.select("run_id", "node", "block")
    e = edges.join(of.select("run_id", C("node").alias("src"), C("block").alias("src_block")), ["run_id", "src"])
    return n, materialize(e.join(of.select("run_id", C("node").alias("dst"), C("block").alias("dst_block")), ["run_id", "dst"]), "block-edges")


def behind_cycles(edges: DataFrame) -> DataFrame:
    """(run_id, node) of nodes that are surely on or behind a cycle, in general not of all.

    Each node follows one of its predecessors, one with predecessors of its own; a way that does not end runs into a cycle. Ways are joined
    by doubling. Once a round ends none, none that is left ends: a finite way of any length has shorter ones behind it that end before."""
    inner = edges.join(edges.select("run_id", C("dst").alias("src")).distinct(), ["run_id", "src"], "left_semi")
    way = materialize(inner.groupBy("run_id", C("dst").alias("node")).agg(F.min_by("src", F.struct(F.xxhash64("src", "dst"), "src")).alias("up")), "ways")
    left, n = None, way.count()
    while n and n != left:
        further = way.select("run_id", C("node").alias("up"), C("up").alias("up2"))
        way = materialize(way.join(further, ["run_id", "up"]).select("run_id", "node", C("up2").alias("up")), "ways")
        left, n = n, way.count()
    return way.select("run_id", "node")


def longest_large(nodes: DataFrame, edges: DataFrame, order: str, local_rows: int = LOCAL_ROWS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(run_id, node, dist) of the nodes that are on or behind no cycle. nodes: run_id, node, least, order; edges: run_id, src, dst, step."""
    n, e = blocked(nodes, edges, order, block_nodes)
    made = materialize(in_blocks(n, e, None).groupBy("run_id", "block").applyInArrow(shrink_block, "run_id string, src string, node string, num bigint"), "shrunk")
    across = e.where("src_block <> dst_block").select("run_id", "src", "dst", "step")
    less = materialize(made.where("src is null").select("run_id", "node", C("num").alias("least")).join(n.select("run_id", "node", order), ["run_id", "node"]), "border")
    steps = materialize(made.where("src is not null").select("run_id", "src", C("node").alias("dst"), C("num").alias("step")).unionByName(across), "border-steps")
    was, now = nodes.count() + edges.count(), less.count() + steps.count()
    most = less.select("run_id").unionByName(steps.select("run_id")).groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if most <= local_rows:
        small = solve_small(less.withColumnRenamed("least", "dur_ns"), steps).where("not cyclic").select("run_id", "node", C("dist").alias("known"))
    elif now <= 0.75 * was:
        small = longest_large(less, steps, order, local_rows, block_nodes).withColumnRenamed("dist", "known")
    else:
        small = cored_longest(less, steps, local_rows).withColumnRenamed("dist", "known")
    known = materialize(small, "border-values")
    return materialize(in_blocks(n, e, known).groupBy("run_id", "block").applyInArrow(open_block, "run_id string, node string, dist bigint"), "opened")


def cored_longest(nodes: DataFrame, edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(run_id, node, dist) for graphs that do not shrink by blocks, by way of their core.

    What is surely behind a cycle is left out, nodes without predecessors are settled at once, and nodes without successors,
    hubs that all others lead to among them, at the end."""
    key = ["run_id", "node"]
    at = lambda e, end: e.select("run_id", C(end).alias("node")).distinct()
    of = lambda n, end: n.select("run_id", C("node").alias(end))
    never = behind_cycles(edges)
    n = materialize(nodes.join(never, key, "left_anti"), "open-nodes")
    e = edges.join(of(n, "dst"), ["run_id", "dst"], "left_semi").join(of(never, "src").withColumn("never", F.lit(True)), ["run_id", "src"], "left")
    e = materialize(e, "open-edges")
    # what has such a predecessor waits for itself
    loops = e.where("never").select("run_id", C("dst").alias("src"), "dst", F.lit(0).cast("long").alias("step")).distinct()
    e = materialize(e.where("never is null").select("run_id", "src", "dst", "step").unionByName(loops), "open-steps")
    first = materialize(n.join(at(e, "dst"), key, "left_anti").select("run_id", "node", C("least").alias("dist")), "first")
    come = e.join(first.select("run_id", C("node").alias("src"), "dist"), ["run_id", "src"], "left")
    given = come.where("dist is not null").groupBy("run_id", C("dst").alias("node")).agg(F.max(C("dist") + C("step")).alias("given"))
    n = n.join(first, key, "left_anti").join(given, key, "left").select("run_id", "node", F.greatest("least", "given").alias("least"))
    n, e = materialize(n, "later-nodes"), materialize(come.where("dist is null").drop("dist"), "later-steps")
    leads = at(e, "src")
    core = materialize(n.join(leads, key, "left_semi"), "core")
    inner = materialize(e.join(of(core, "dst"), ["run_id", "dst"], "left_semi"), "core-steps")
    most = core.select("run_id").unionByName(inner.select("run_id")).groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if most <= local_rows:
        done = solve_small(core.select("run_id", "node", C("least").alias("dur_ns")), inner).where("not cyclic").select("run_id", "node", "dist")
    else:
        done = doubled_longest(core, inner)
    done = materialize(done, "core-values")
    last = n.join(leads, key, "left_anti")
    into = e.join(of(last, "dst"), ["run_id", "dst"], "left_semi").join(done.select("run_id", C("node").alias("src"), "dist"), ["run_id", "src"], "left")
    into = into.groupBy("run_id", C("dst").alias("node")).agg(F.max(C("dist") + C("step")).alias("d"), F.count_if(C("dist").isNull()).alias("open"))
    last = last.join(into, key, "left").where(F.coalesce("open", F.lit(0)) == 0).select("run_id", "node", F.greatest("least", "d").alias("dist"))
    return materialize(first.unionByName(done).unionByName(last), "large")


def doubled_longest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, node, dist) for graphs of any shape.

    A node that waits for one predecessor only is a function of it, x -> max(own, x + step); such functions are joined by doubling, so
    a chain of any length takes as many rounds as its logarithm. Nodes that wait for several predecessors are settled phase by phase: those
    that are known become part of the node's own value, and what waits for one more is doubled again."""
    e_left = edges
    waiting = materialize(nodes.select("run_id", "node", "least").join(edges.select("run_id", C("dst").alias("node")).distinct(), ["run_id", "node"], "left_semi"), "waiting")
    fresh = materialize(nodes.select("run_id", "node", C("least").alias("dist")).join(waiting, ["run_id", "node"], "left_anti"), "known")
    known = [fresh]
    while not fresh.isEmpty() and not waiting.isEmpty():
        waiting, e_left, fresh = settle(waiting, e_left, fresh)
        known.append(fresh)
    return reduce(DataFrame.unionByName, known)


def settle(waiting: DataFrame, e: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One phase: (nodes that still wait, edges from unknown nodes, nodes known now)."""
    known = fresh.select("run_id", C("node").alias("src"), "dist")
    e = materialize(e.join(known, ["run_id", "src"], "left"), "edges")
    sums = e.groupBy("run_id", C("dst").alias("node")).agg(F.max(C("dist") + C("step")).alias("d"), F.count_if(C("dist").isNull()).alias("open"),
                                                           F.max(F.when(C("dist").isNull(), F.struct("src", "step"))).alias("last"))
    now = waiting.join(sums, ["run_id", "node"], "left").select("run_id", "node", F.greatest("least", "d").alias("least"), F.coalesce("open", F.lit(0)).alias("open"), "last")
    now = materialize(now, "open")
    ready = now.where("open = 0").select("run_id", "node", C("least").alias("dist"))
    f = doubled(now.where("open = 1").select("run_id", "node", C("last.src").alias("root"), C("last.step").alias("step"), "least"))
    ends = f.join(ready.select("run_id", C("node").alias("root"), "dist"), ["run_id", "root"])
    ready = materialize(ready.unionByName(ends.select("run_id", "node", F.greatest("least", C("dist") + C("step")).alias("dist"))), "known")
    waiting = materialize(now.join(ready, ["run_id", "node"], "left_anti").select("run_id", "node", "least"), "waiting")
    return waiting, e.where("dist is null").drop("dist"), ready


def doubled(f: DataFrame) -> DataFrame:
    """Each function (node, root, step, least) in terms of the first root that is no function itself; those that end in a cycle are left out."""
    f, done, left = materialize(f, "steps"), None, None
    while True:
        up = (f if done is None else f.unionByName(done)).select("run_id", C("node").alias("root"), C("root").alias("root2"), C("step").alias("step2"), C("least").alias("least2"))
        settled = (done.select("run_id", C("node").alias("root"), F.lit(True).alias("s")) if done is not None else f.limit(0).select("run_id", "root", F.lit(True).alias("s")))
        j = f.join(up, ["run_id", "root"], "left").join(settled, ["run_id", "root"], "left")
        more = C("root2").isNotNull()
        j = materialize(j.select("run_id", "node", F.coalesce("root2", "root").alias("root"), F.when(more, C("step") + C("step2")).otherwise(C("step")).alias("step"),
                                 F.when(more, F.greatest("least", C("least2") + C("step"))).otherwise(C("least")).alias("least"), (~more | C("s").isNotNull()).alias("ends")), "doubled")
        ended = j.where("ends").drop("ends")
        done = ended if done is None else done.unionByName(ended)
        f = j.where("not ends").drop("ends")
        n = f.count()
        if n == 0 or n == left:
            return done
        left = n
