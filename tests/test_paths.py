"""Longest paths: small runs in one pass, large runs in blocks, any shape; all against a plain walk."""
import random

import pyarrow as pa
import pytest

from lagsleuth.operators import graph as G, paths

NODES, EDGES = "run_id string, node string, stage string, dur_ns long, at double", "run_id string, src string, dst string, w_ns long, stage string"


def plain(nodes, edges):
    """node -> (dist, prev, cyclic), by hand."""
    dur = {n[1]: n[3] for n in nodes}
    into = {n: {} for n in dur}
    for _, a, b, w, _ in edges:
        if a in dur and b in dur:
            into[b][a] = max(w, into[b].get(a, w))
    state = {}
    while True:
        ready = [n for n in dur if n not in state and all(a in state for a in into[n])]
        if not ready:
            return {n: state.get(n, (dur[n], None, True)) for n in dur}
        for n in ready:
            best = max([(state[a][0] + w + dur[n]) for a, w in into[n].items()], default=0)
            prev = min((a for a, w in into[n].items() if state[a][0] + w + dur[n] == best), default=None)
            state[n] = (best, prev, False) if best > dur[n] else (dur[n], None, False)


def walk(nodes, edges):
    s = plain(nodes, edges)
    end = min(s, key=lambda n: (-s[n][0], n))
    on, at = [], end
    while at is not None:
        on.append((at, *s[at]))
        at = s[at][1]
    return (s[end][0], end), sorted(on)


def check(spark, runs, **how):
    nodes, edges = [n for r in runs for n in r[0]], [e for r in runs for e in r[1]]
    tot, path = G.critical_path(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **how)
    got = {r.run_id: (r.total_ns, r.end_node) for r in tot.collect()}
    on = {}
    for r in path.collect():
        on.setdefault(r.run_id, []).append((r.node, r.dist, r.prev, r.cyclic))
    for n, e in runs:
        assert (got[n[0][0]], sorted(on[n[0][0]])) == walk(n, e)
    assert len(got) == len(runs)


def some_run(name, n, seed, cycle=False, spread=6, density=0.4):
    r = random.Random(seed)
    nodes = [(name, f"n{i}", "s", r.randrange(4), float(i)) for i in range(n)]
    edges = [(name, f"n{i}", f"n{j}", r.randrange(3), "s") for i in range(n) for j in range(i + 1, min(n, i + spread)) if r.random() < density]
    edges += edges[:3] + [(name, "gone", "n1", 5, "s"), (name, "n1", "gone", 5, "s")]
    if cycle:
        edges += [(name, f"n{n // 2 + 2}", f"n{n // 2}", 1, "s"), (name, f"n{n // 2}", f"n{n // 2 + 2}", 1, "s"), (name, f"n{n // 3}", f"n{n // 3}", 1, "s")]
    return nodes, edges


RUNS = [some_run("a", 60, 1), some_run("b", 45, 2, cycle=True), some_run("c", 1, 3), some_run("d", 30, 4, spread=30, density=0.08), some_run("e", 70, 5, cycle=True, spread=3)]


@pytest.mark.parametrize("runs, how", [(RUNS, {}), (RUNS, {"order": "at", "local_rows": 30, "block_nodes": 12}), (RUNS[1:2], {"order": "at", "local_rows": 0, "block_nodes": 25}), (RUNS[:2], {"order": "at", "local_rows": 50, "block_nodes": 1})])
def test_equals_plain(spark, runs, how):
    check(spark, runs, **how)


def test_blocks_with_many_entries_stay(spark, monkeypatch):
    t = pa.table({"src": [None, None, None, "a", "b"], "node": ["a", "b", "c", "b", "c"], "num": [1, 2, 3, 5, 7], "known": pa.nulls(5, pa.int64()), "role": ["b", "e", "x", "", ""]})
    key = (pa.scalar("r"), pa.scalar(0))
    whole = {(r["src"], r["node"], r["num"]) for r in paths.shrink_block(key, t).to_pylist()}
    assert whole == {(None, "a", 1), (None, "b", 6), (None, "c", 13), ("a", "b", 5), ("a", "c", 12), ("b", "c", 7)}
    monkeypatch.setattr(paths, "MOST_ENTRIES", 1)
    assert {(r["src"], r["node"], r["num"]) for r in paths.shrink_block(key, t).to_pylist()} == {(None, "a", 1), (None, "b", 2), (None, "c", 3), ("a", "b", 5), ("b", "c", 7)}


@pytest.mark.parametrize("run", [1, 3])
def test_any_shape_by_doubling(spark, run):
    nodes, edges = RUNS[run]
    dur = {n[1]: n[3] for n in nodes}
    e = {}
    for _, a, b, w, _ in edges:
        if a in dur and b in dur:
            e[a, b] = max(w, e.get((a, b), w))
    got = paths.doubled_longest(spark.createDataFrame([(n[0], n[1], n[3]) for n in nodes], "run_id string, node string, least long"),
                                spark.createDataFrame([(nodes[0][0], a, b, w + dur[b]) for (a, b), w in e.items()], "run_id string, src string, dst string, step long"))
    assert {r.node: r.dist for r in got.collect()} == {n: d for n, (d, _, cyclic) in plain(nodes, edges).items() if not cyclic}


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """20,000 nodes in a row: two rounds of blocks, or fifteen of doubling."""
    n = 20_000
    nodes = spark.range(n).selectExpr("'r' run_id", "concat('n', id) node", "'s' stage", "1L dur_ns", "double(id) at")
    edges = spark.range(n - 1).selectExpr("'r' run_id", "concat('n', id) src", "concat('n', id + 1) dst", "2L w_ns", "'s' stage")
    tables = []
    real = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, name="t": (tables.append(name), real(df, name))[1])
    for how in ({}, {"order": "at", "local_rows": 2_000, "block_nodes": 1_000}):
        tot, path = G.critical_path(nodes, edges, **how)
        assert [tuple(r) for r in tot.collect()] == [("r", 3 * n - 2, f"n{n - 1}")]
        assert path.count() == n
    assert tables.count("shrunk") == 1 and len(tables) < 20
    tables.clear()
    own = nodes.selectExpr("run_id", "node", "dur_ns least")
    d = paths.doubled_longest(own, edges.selectExpr("run_id", "src", "dst", "w_ns + 1 step"))
    assert d.selectExpr("count(*)", "max(dist)").first()[:] == (n, 3 * n - 2)
    assert tables.count("doubled") <= 16


def test_empty(spark):
    tot, path = G.critical_path(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert tot.count() == path.count() == 0


def traced(name, n, seed):
    """Two rows of nodes linked at random, with cycles, a hub behind all of one row, sources and sinks."""
    r = random.Random(seed)
    nodes = [(name, f"{k}{i}", "s", r.randrange(4), float(i)) for k in "cgts" for i in range(n)] + [(name, "hub", "s", 0, 0.0)]
    there = r.sample(range(n), n)
    edges = [(name, f"{k}{i}", f"{k}{i + 1}", r.randrange(3), "s") for k in "cg" for i in range(n - 1)] + [(name, f"g{i}", "hub", 0, "s") for i in range(n)]
    edges += [(name, f"c{i}", f"g{there[i]}", 1, "s") for i in range(0, n, 3)] + [(name, f"t{i}", f"g{i}", 2, "s") for i in range(n)] + [(name, f"g{i}", f"s{i}", 1, "s") for i in range(n)]
    edges += [(name, f"s{i}", f"c{there[i]}", 0, "s") for i in range(n // 4, n, 7)]
    return nodes, edges


def test_core_of_runs_that_do_not_shrink(spark, monkeypatch):
    runs = [traced("u", 60, 1), traced("v", 40, 2), some_run("b", 45, 2, cycle=True), traced("w", 3, 3)]
    tables = []
    real = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, name="t": (tables.append(name), real(df, name))[1])
    monkeypatch.setattr(paths, "MOST_ENTRIES", 1)
    check(spark, runs, local_rows=150, block_nodes=20)
    assert "doubled" not in tables and tables.count("ways") <= 14


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_cored_equals_plain(spark, local_rows):
    for nodes, edges in (traced("u", 40, 4), RUNS[1]):
        dur = {n[1]: n[3] for n in nodes}
        e = {}
        for _, a, b, w, _ in edges:
            if a in dur and b in dur:
                e[a, b] = max(w, e.get((a, b), w))
        got = paths.cored_longest(spark.createDataFrame([(n[0], n[1], n[3]) for n in nodes], "run_id string, node string, least long"),
                                  spark.createDataFrame([(nodes[0][0], a, b, w + dur[b]) for (a, b), w in e.items()], "run_id string, src string, dst string, step long"), local_rows)
        assert sorted((r.node, r.dist) for r in got.collect()) == sorted((n, d) for n, (d, _, cyclic) in plain(nodes, edges).items() if not cyclic)
