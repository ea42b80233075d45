"""Known answers and brute-force checks on small rows."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagsleuth.functions import scalars as X
from lagsleuth.operators import graph as G, inference as N, intervals as I, pooling as P, population as U, spans as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def L(*v):
    return [F.lit(x) for x in v]


def test_interval_bounds(spark):
    assert tuple(one(spark, X.local_interval(*L(100, 8, 110, 8), F.lit(True)))) == (-6, 26)
    assert one(spark, X.local_interval(*L(100, 1, 90, 1), F.lit(True))) is None
    m = F.struct(*[F.lit(v).alias(n) for n, v in (("valid_lo", 0), ("valid_hi", 50), ("rate_lo", 1), ("rate_hi", 1), ("off_lo", 100), ("off_hi", 100))])
    assert tuple(one(spark, X.mapped_interval(*L(10, 8, 120, 8), m))) == (-6, 26)
    r = one(spark, X.residual(*L(100.0, 100.0, 20.0, 20.0, 0.9, 1.1), F.lit(True)))
    assert (round(r.raw.lo, 6), round(r.kept.hi, 6)) == (78, 82)


def test_names_times_and_sequences(spark):
    names = [("void at::(anonymous namespace)::foo_kernel<float>(int)", "foo_kernel"), ("volta_sgemm_128x64_nn", "volta_sgemm_128x64_nn"), ("void ns::bar<int>(x)", "bar"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("a-b", "a_b")]
    df = spark.createDataFrame([(a, b) for a, b in names], "a string, b string").select(X.kernel_short_name(F.col("a")).alias("g"), "b")
    assert [r.g for r in df.collect()] == [b for _, b in names]
    assert one(spark, X.us_to_ns(F.lit("1000.500"))) == 1000500 and one(spark, X.us_to_ns(F.lit("3.250"))) == 3250 and one(spark, X.us_to_ns(F.lit("x"))) is None
    for cp in (0, 5, 2**32 - 3, 2**32 + 10, 7 * 2**32 + 2**31):
        for v in (0, 1, 2**31, 2**32 - 1):
            base = cp // 2**32 * 2**32
            best = min((base + v - 2**32, base + v, base + v + 2**32), key=lambda c: abs(c - cp))
            assert one(spark, X.unwrap_seq(F.lit(v), F.lit(cp))) == (best if abs(best - cp) < 2**31 else None)


REQ = "request_id string, delivery_id string, status string, finish_ns long, deadline_ns long, clock_domain string, block string, o long"


def test_population_bounds_missing_data(spark):
    df = spark.createDataFrame([(f"r{i}", f"r{i}", s, f, 10, "c", "b", i) for i, (s, f) in enumerate([("ok", 5), ("ok", 15), ("timeout", 5), ("timeout", 15)])], REQ)
    p = U.population(df, ["block"]).first()
    assert (p.eligible, p.missed, p.on_time, p.unknown_deadline) == (4, 2, 1, 1)


def test_drought_and_merge(spark):
    df = spark.createDataFrame([("a", "a", "ok", 10, 5, "c", "1", 1), ("b", "b", "ok", 20, 5, "c", "1", 2), ("c", "c", "ok", 90, 5, "c", "2", 3), ("d", "d", "ok", 100, 5, "c", "2", 4)], REQ)
    s = U.miss_runs(df, ["block"], ["o"]).join(U.drought(df, ["block"], ["o"]), "block").withColumns({"ord": F.col("block").cast("long"), "g": F.lit("x")})
    m = U.merge_blocks(s, ["g"], "ord").first()
    assert (m.max_gap, m.max_run, m.prefix, m.suffix, m.all_missed, m.ordered) == (70, 4, 4, 4, True, True)


def test_merge_equals_whole_on_random_runs(spark):
    r = random.Random(2)
    rows = [(f"r{i}", f"r{i}", "ok", i * 10 + (11 if r.random() < 0.6 else 1), i * 10 + 5, "c", str(i // 7), i) for i in range(70)]
    df = spark.createDataFrame(rows, REQ).withColumn("g", F.lit("x"))
    s = U.miss_runs(df, ["block"], ["o"]).join(U.drought(df, ["block"], ["o"]), "block").withColumns({"ord": F.col("block").cast("long"), "g": F.lit("x")})
    a, b = U.merge_blocks(s, ["g"], "ord").first(), U.miss_runs(df, ["g"], ["o"]).first()
    assert (a.max_run, a.prefix, a.suffix, a.all_missed) == (b.max_run, b.prefix, b.suffix, b.all_missed)
    assert a.max_gap == U.drought(df, ["g"], ["o"]).first().max_gap


EV = "rid string, relation string, identity string, clock string, token long, boundary string, time long, unit string, uncertainty long, complete boolean, limitations array<string>"


def ev(rid, tok, b, t):
    return (rid, "resource", "q", "c", tok, b, t, "ns", 0, True, [])


def test_pairing_by_token(spark):
    df = spark.createDataFrame([ev("1", 1, "queue_enqueue", 0), ev("2", 2, "queue_enqueue", 100), ev("3", 1, "queue_dequeue", 101), ev("4", 2, "queue_dequeue", 102)], EV)
    p, u = I.pair_intervals(df)
    assert sorted(r.duration for r in p.collect()) == [2, 101] and u.count() == 0


def test_pairing_equals_state_machine(spark):
    r = random.Random(7)
    rows = [ev(f"{i:03d}", r.choice([None, 1, 2]), r.choice(["queue_enqueue", "queue_dequeue", "link_assign", "access", "eligible"]), r.randrange(60)) for i in range(200)]
    p, u = I.pair_intervals(spark.createDataFrame(rows, EV))
    want, lost = [], []
    for s, e, kind in I.INTERVAL_KINDS:
        open_, amb = {}, set()
        for x in sorted(rows, key=lambda x: (x[6], x[0])):
            tok = x[4]
            if x[5] == s:
                if tok in open_:
                    amb.update((open_[tok][0], x[0]))
                    lost.append((kind, open_[tok][0], x[0]))
                open_[tok] = x
            elif x[5] == e and tok in open_:
                a = open_.pop(tok)
                want.append((kind, a[0], x[0], x[6] - a[6], a[0] in amb))
            elif x[5] == e:
                lost.append((kind, None, x[0]))
        lost += [(kind, a[0], None) for a in open_.values()]
    got = [(x.kind, x.start_rid, x.end_rid, x.duration, len(x.limitations) > 0) for x in p.collect()]
    assert sorted(got) == sorted(want)
    assert sorted(((x.kind, x.rid1, x.rid2) for x in u.collect()), key=repr) == sorted(lost, key=repr)


def test_concurrency_equals_definition(spark):
    r = random.Random(4)
    k = [("r", i, r.choice([None, 1, 2, 3]), s, s + r.choice([0, 0, 1, 5, 20])) for i, s in enumerate(r.choices(range(40), k=120))]
    df = spark.createDataFrame([("gpu_kernel", *x) for x in k], "kind string, run_id string, event_id long, stream_id long, start_ns long, end_ns long")
    spark.conf.set("lagsleuth.segmentRows", "25")
    got = {x.event_id: x for x in S.concurrency(df).collect()}
    spark.conf.unset("lagsleuth.segmentRows")
    for _, i, _s, s, _e in k:
        live = [h for h in k if h[3] <= s < h[4]]
        assert got[i].active_kernels == len(live)
        assert got[i].active_streams == max(1, len({h[2] for h in live if h[2] is not None}))
        assert got[i].queue_depth == 3


def test_readiness_equals_definition(spark):
    r = random.Random(9)
    rows = [(k, "c", "ns", r.randrange(50), lo, lo + r.randrange(1, 9)) for k in range(12) for lo in r.choices(range(20), k=12)]
    need = [(k, 3, 15 + k % 4) for k in range(12)]
    got = {x.k: x.ready for x in I.readiness(spark.createDataFrame(rows, "k long, clock string, unit string, time long, lo long, hi long"), spark.createDataFrame(need, "k long, lo long, hi long"), "k").collect()}
    for k, lo, hi in need:
        want = None
        for t in sorted({x[3] for x in rows if x[0] == k}):
            have = sorted((x[4], x[5]) for x in rows if x[0] == k and x[3] <= t)
            at = lo
            for a, b in have:
                if a <= at < b:
                    at = b
            if at >= hi:
                want = t
                break
        assert got[k] == want


def test_block_compare_regression_and_null(spark):
    def blocks(key, ref, cur):
        return [(key, a, f"{a}{i}", v, v, 1 / 200, i + 1, "r") for a, v in (("reference", ref), ("current", cur)) for i in range(200)]
    b = spark.createDataFrame(blocks("x", 0.0, 1.0) + blocks("y", 0.0, 0.0), "key string, arm string, unit string, lo double, hi double, weight double, start long, regime string")
    c = spark.createDataFrame([(k, 0.05, 0.05, "confirmatory", 0, "independent_blocks", "shop", "r", 1) for k in "xy"], "key string, alpha double, threshold double, selection string, frozen_at long, dependence string, basis string, regime string, look int")
    got = {r.key: r.regression for r in N.block_compare(b, c, "key").collect()}
    assert got == {"x": True, "y": False}


def test_joint_outcomes_keeps_pairing(spark):
    df = spark.createDataFrame([("a", 1, 11), ("a", 11, 1), ("b", 1, 1), ("b", 11, 11)], "k string, x int, y int")
    assert {r.k: r.simultaneous_exceedance for r in N.joint_outcomes(df, ["k"], "x", "y", 5).collect()} == {"a": 0, "b": 0.5}


def test_randomization_matches_enumeration(spark):
    r = random.Random(1)
    d = [r.gauss(0.4, 1) for _ in range(9)]
    got = N.paired_randomization(spark.createDataFrame([("k", i, x, 0.0) for i, x in enumerate(d)], "key string, pair int, control double, treatment double"), "key").first()
    m = sum(d) / 9
    hits = sum(sum(a * b for a, b in zip(d, s)) / 9 >= m - 1e-12 for s in itertools.product((-1, 1), repeat=9))
    assert got.assignments == 512 and math.isclose(got.p_value, hits / 512)


def test_path_bounds_and_twins(spark):
    inc = spark.createDataFrame([("i", 1, "x"), ("i", 1, "y")], "inc string, path long, resource string")
    b = {r.resource: (r.lo, r.hi) for r in G.path_bounds(inc, spark.createDataFrame([(1, 10.0, 10.0)], "path long, lo double, hi double")).collect()}
    assert b == {"x": (0, 10), "y": (0, 10)}
    assert {r.resource for r in G.indistinguishable(inc, "inc").collect()} == {"x", "y"}


def test_critical_path_equals_brute_force(spark):
    r = random.Random(6)
    n = [("g", f"n{i:02d}", "s", r.randrange(1, 20)) for i in range(14)]
    e = [("g", f"n{i:02d}", f"n{j:02d}", r.randrange(5), "s") for i in range(14) for j in range(i + 1, 14) if r.random() < 0.25]
    dur = {x[1]: x[3] for x in n}
    best = {}
    for v in sorted(dur):
        best[v] = max([dur[v]] + [best[a] + w + dur[v] for _, a, b, w, _ in e if b == v])
    tot, path = G.critical_path(spark.createDataFrame(n, "run_id string, node string, stage string, dur_ns long"), spark.createDataFrame(e, "run_id string, src string, dst string, w_ns long, stage string"))
    assert tot.first().total_ns == max(best.values())
    p = sorted(((x.dist, x.node) for x in path.collect()))
    wsum = {(a, b): w for _, a, b, w, _ in e}
    assert sum(dur[x] for _, x in p) + sum(wsum[(a[1], b[1])] for a, b in zip(p, p[1:])) == max(best.values())


def test_quantile_helpers():
    for got, want in ((P.chi2_ppf(0.95, 1), 3.841459), (P.chi2_ppf(0.025, 9), 2.700389), (P.chi2_ppf(0.975, 29), 45.722286), (P.t_ppf(0.975, 1), 12.706205), (P.t_ppf(0.975, 10), 2.228139), (P.t_ppf(0.975, 100), 1.983972)):
        assert math.isclose(got, want, rel_tol=1e-5)


CELLS = [("m", f"c{i}", y, v) for i, (y, v) in enumerate([(1.0, 0.2), (2.5, 0.4), (0.3, 0.1), (4.0, 0.5), (2.2, 0.3)])]


def cells(spark):
    return spark.createDataFrame(CELLS, "metric string, ctx string, y double, v double")


def q_of(t2):
    w = [1 / (v + t2) for *_, v in CELLS]
    mu = sum(a * c[2] for a, c in zip(w, CELLS)) / sum(w)
    return sum(a * (c[2] - mu) ** 2 for a, c in zip(w, CELLS)), mu, sum(w)


def test_tau2_against_dense_grids(spark):
    y, v = np.array([c[2] for c in CELLS]), np.array([c[3] for c in CELLS])
    grid = np.linspace(0, 20, 200001)
    w = 1 / (v[None] + grid[:, None])
    mu = (w * y).sum(1) / w.sum(1)
    q = (w * (y - mu[:, None]) ** 2).sum(1)
    ml = -0.5 * (np.log(v[None] + grid[:, None]).sum(1) + q)
    reml = ml - 0.5 * np.log(w.sum(1))
    assert abs(P.tau2_grid(cells(spark), ["metric"], "reml").first().tau2 - grid[reml.argmax()]) < 2e-4
    pm = P.tau2_grid(cells(spark), ["metric"], "pm").first().tau2
    assert abs(q_of(pm)[0] - 4) < 1e-6
    lam = -math.log(0.05) / y.std(ddof=1)
    tau = np.sqrt(grid[1:])
    obj = ml[1:] - lam * tau + np.log(tau)
    assert abs(P.tau2_grid(cells(spark), ["metric"], "pc").first().tau2 - grid[1:][obj.argmax()]) < 3e-4


def test_q_profile_and_prediction(spark):
    r = P.q_profile(cells(spark), ["metric"]).first()
    for t, p in ((r.lo, 0.975), (r.hi, 0.025)):
        assert t == 0 or abs(q_of(t * t)[0] - P.chi2_ppf(p, 4)) < 1e-5
    x = P.prediction_interval(cells(spark), ["metric"]).first()
    _, mu, sw = q_of(x.tau2)
    assert math.isclose(x.mu, mu, rel_tol=1e-6) and math.isclose(x.hi - x.mu, P.t_ppf(0.975, 3) * math.sqrt(x.tau2 + 1 / sw), rel_tol=1e-6)


def test_borrow_gate_reasons(spark):
    base = [("ok", f"c{i}", 10 + 0.01 * i, 0.5, True) for i in range(4)]
    rows = base + [("box", c, y + 9 * i, v, m) for i, (_, c, y, v, m) in enumerate(base)] + [("prov", c, y, v, i < 2) for i, (_, c, y, v, m) in enumerate(base)]
    got = {r.metric: r.reason for r in P.borrow_gate(spark.createDataFrame(rows, "metric string, ctx string, y double, v double, measured boolean"), ["metric"], threshold=5.0).collect()}
    assert got == {"ok": "borrow", "box": "box", "prov": "provenance"}


def test_loo_equals_brute_force(spark):
    r = random.Random(8)
    obs = {c: [r.gauss(m, 1) for _ in range(4)] for c, m in zip("abc", (0, 1, 3))}

    def pool(means, var):
        y, v = list(means.values()), list(var.values())
        w = [1 / x for x in v]
        mu = sum(a * b for a, b in zip(w, y)) / sum(w)
        q = sum(a * (b - mu) ** 2 for a, b in zip(w, y))
        t2 = max(0, (q - len(y) + 1) / (sum(w) - sum(a * a for a in w) / sum(w)))
        ws = [1 / (x + t2) for x in v]
        m = sum(a * b for a, b in zip(ws, y)) / sum(ws)
        return {k: var[k] / (var[k] + t2) * m + (1 - var[k] / (var[k] + t2)) * means[k] for k in means}
    sse = [0, 0, 0]
    for c in obs:
        for i, x in enumerate(obs[c]):
            tr = {k: [z for j, z in enumerate(v) if (k, j) != (c, i)] for k, v in obs.items()}
            flat = [z for v in tr.values() for z in v]
            part = pool({k: np.mean(v) for k, v in tr.items()}, {k: np.var(v, ddof=1) / len(v) for k, v in tr.items()})[c]
            for k, p in enumerate((np.mean(flat), np.mean(tr[c]), part)):
                sse[k] += (p - x) ** 2 / 12
    got = P.loo_mse(spark.createDataFrame([("m", c, x) for c, v in obs.items() for x in v], "metric string, ctx string, value double"), ["metric"], "ctx").first()
    assert np.allclose([got.pooled, got.unpooled, got.partial], sse)


@pytest.mark.parametrize("shift", [-1, 0, 2])
def test_xcorr_sign(spark, shift):
    r = random.Random(11)
    a = [r.random() for _ in range(60)]
    rows = [("k", i, a[i], a[i - shift] if 0 <= i - shift < 60 else 0.5) for i in range(60)]
    got = I.xcorr(spark.createDataFrame(rows, "k string, i long, a double, b double"), "k", ["i"]).first()
    assert got.lag == -shift


def test_longest_path_with_a_cycle(spark):
    """a -> b <-> c -> d, and x -> y: the nodes on and behind the cycle keep their own duration."""
    from lagsleuth.operators import graph as G

    n = [("r", c, "host", d) for c, d in (("a", 5), ("b", 7), ("c", 9), ("d", 50), ("x", 1), ("y", 2))]
    e = [("r", "a", "b", 1, "host"), ("r", "b", "c", 1, "host"), ("r", "c", "b", 1, "host"), ("r", "c", "d", 1, "host"), ("r", "x", "y", 3, "host"), ("r", "x", "gone", 3, "host")]
    tot, path = G.critical_path(spark.createDataFrame(n, "run_id string, node string, stage string, dur_ns long"), spark.createDataFrame(e, "run_id string, src string, dst string, w_ns long, stage string"))
    assert [tuple(r) for r in tot.collect()] == [("r", 50, "d")]
    assert [(r.node, r.dist, r.cyclic) for r in path.collect()] == [("d", 50, True)]
    tot, path = G.critical_path(spark.createDataFrame(n[4:], "run_id string, node string, stage string, dur_ns long"), spark.createDataFrame(e[4:], "run_id string, src string, dst string, w_ns long, stage string"))
    assert [tuple(r) for r in tot.collect()] == [("r", 6, "y")] and {(r.node, r.cyclic) for r in path.collect()} == {("x", False), ("y", False)}


def test_unreadable_trace_is_a_reject(spark, tmp_path):
    from lagsleuth.sources.traces import read_trace_json

    (tmp_path / "good.json").write_text('{"traceEvents": [{"ph": "X", "ts": 1, "dur": 2, "pid": 1, "tid": 1, "name": "op", "cat": "cpu_op"}]}')
    (tmp_path / "cut.json").write_text('{"traceEvents": [{"ph": "X", "ts"')
    (tmp_path / "none.json").write_text('{"other": 1}')
    spans, rejects = read_trace_json(spark, str(tmp_path / "*.json"))
    assert spans.count() == 1
    assert sorted((r.run_id.split("/")[-1], r.reason) for r in rejects.collect()) == [("cut.json", "unreadable document"), ("none.json", "no events")]


def test_pinning_skips_only_what_does_not_fit(spark):
    from lagsleuth.operators.intervals import pin_events

    sizes = {"a": [5, 9, 3, 2, 1, 1], "b": [20], "c": [4, 4, 4]}
    rows = [(s, k, "c", k, n) for s, ns in sizes.items() for k, n in enumerate(ns)]
    kept, cov = pin_events(spark.createDataFrame(rows, "source string, sequence long, clock string, time long, bytes long"), {"max_bytes": 10})
    assert sorted((r.source, r.sequence) for r in kept.collect()) == [("a", 0), ("a", 2), ("a", 3), ("c", 0), ("c", 1)]
    assert sorted(tuple(r) for r in cov.collect()) == [("a", 6, 3, 0, 3), ("b", 1, 1, None, None), ("c", 3, 1, 0, 1)]


def test_retrieval_is_alike_for_any_block_size(spark):
    from lagsleuth.operators.ranking import retrieve

    z = [float(i) for i in range(8)]
    store = spark.createDataFrame([(i, f"slow queue number{i % 5} token{i}", "v1", ["k1", f"k{i % 3}"], [x + i for x in z], "cpu", "VERIFIED", "x", False) for i in range(30)],
                                  "id long, text string, version string, kernels array<string>, z array<double>, stage string, tier string, cause string, retracted boolean")
    queries = store.where("id < 9").selectExpr("id qid", "text", "version", "kernels", "z", "stage")
    rows = [sorted(tuple(r) for r in retrieve(queries, store, 3, query_block=n, store_block=n).select("qid", "id", "rank").collect()) for n in (1000, 2)]
    assert rows[0] == rows[1] and len(rows[0]) == 27


def test_randomization_draws_equal_plain_numbers(spark):
    import hashlib

    from lagsleuth.operators import inference as N

    r = random.Random(4)
    rows = [(k, f"p{i}", r.gauss(0, 1) + (0.3 if k == "a" else 0), r.gauss(0, 1) if i % 9 else None) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, pair string, control double, treatment double").repartition(4)
    got = {x.k: x for x in N.paired_randomization(df, "k", 500, "s").collect()}
    for k in ("a", "b"):
        d = [(p, c - t) for kk, p, c, t in rows if kk == k and t is not None]
        effect = sum(x for _, x in d) / len(d)
        hits = 0
        for j in range(1, 501):
            total = 0.0
            for p, x in d:
                base = int(hashlib.md5(f"s|{p}".encode()).hexdigest()[:15], 16)
                bit = (((base ^ (j * N.SPREAD_DRAW % 2**64)) * N.SPREAD % 2**64) >> N.SIGN_BIT) & 1
                total += -x if bit else x
            hits += total / len(d) >= effect - 1e-12
        assert (got[k].n, got[k].assignments) == (len(d), 500) and abs(got[k].p_value - (hits + 1) / 501) < 1e-12


def test_items_that_need_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "d"), ("x", "y"), ("y", "z"), ("c", "m"), ("m", "n"), ("n", "n"), ("q", "x"), ("s", "q"), ("s", "e")]
    got = {r.item for r in G.into_cycles(spark.createDataFrame(edges, "item string, needs string")).collect()}
    assert got == {"a", "b", "c", "d", "e", "m", "n", "s"}
    assert G.into_cycles(spark.createDataFrame(edges[5:7], "item string, needs string")).count() == 0


def test_times_since_1970_are_exact(spark):
    for us, ns in (("1704067200179575", 1704067200179575000), ("1704067200179575.123", 1704067200179575123), ("1e3", 1000000), ("NaN", None), ("1e40", None), ("-1.5", -1500)):
        assert one(spark, X.us_to_ns(F.lit(us))) == ns
    assert one(spark, X.us_to_ns(F.lit(1000.5))) == 1000500 and one(spark, X.us_to_ns(F.lit(7))) == 7000


def test_leave_one_context_out_equals_brute_force(spark, monkeypatch):
    r = random.Random(12)
    obs = [("m", f"c{c}", r.gauss(c % 4, 1 + c % 3)) for c in range(9) for _ in range(2 + c)]
    obs += [("zero", f"c{c}", float(c)) for c in range(4) for _ in range(3)] + [("one", "c0", 1.0), ("one", "c0", 2.0)]
    obs += [("same", f"c{c}", x) for c in range(3) for x in (1.0, 3.0)] + [("same", "c9", x) for x in (5.0, 9.0)] + [("two", f"c{c}", x + c) for c in range(2) for x in (0.0, 1.0)]

    def cell(x):
        m = sum(x) / len(x)
        s2 = sum((v - m) ** 2 for v in x)
        return len(x), m, (s2 / (len(x) - 1) / len(x) if len(x) > 1 else 0.0), s2

    want = {}
    for metric in ("m", "zero", "same", "two"):
        cells = {c: cell([v for k, cc, v in obs if (k, cc) == (metric, c)]) for c in {cc for k, cc, _ in obs if k == metric}}
        pooled = partial = total = 0
        for c, (n, y, v, s2) in cells.items():
            o = [x for d, x in cells.items() if d != c]
            mu = sum(x[1] for x in o) / len(o)
            w = [1 / x[2] if x[2] > 0 else 0 for x in o]
            if len(o) > 1 and min(x[2] for x in o) > 0 and max(x[1] for x in o) > min(x[1] for x in o):
                fe = sum(a * x[1] for a, x in zip(w, o)) / sum(w)
                t2 = max(0, (sum(a * (x[1] - fe) ** 2 for a, x in zip(w, o)) - len(o) + 1) / (sum(w) - sum(a * a for a in w) / sum(w)))
                w = [1 / (x[2] + t2) for x in o]
                mu = sum(a * x[1] for a, x in zip(w, o)) / sum(w)
            grand = sum(x[0] * x[1] for x in o) / sum(x[0] for x in o)
            pooled, partial, total = pooled + s2 + n * (grand - y) ** 2, partial + s2 + n * (mu - y) ** 2, total + n
        want[metric] = (total, pooled / total, partial / total)
    df = spark.createDataFrame(obs, "metric string, ctx string, value double")
    for size in (8192, 3):
        monkeypatch.setattr(P, "CELL_BLOCK", size)
        monkeypatch.setattr(P, "TARGET_BLOCK", size)
        got = {x.metric: (x.n, x.pooled, x.partial) for x in P.loo_context_mse(df, ["metric"], "ctx").collect()}
        assert set(got) == set(want)
        for k in want:
            assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[k], want[k])), k
