"""Retrieval in tiles gives the rows of a full comparison, for any number of queries and any tile size."""
import math
import random
import re
from collections import Counter

import pytest

from lagsleuth.operators import nearest, ranking as R

SCHEMA = "id long, text string, version string, kernels array<string>, z array<double>, stage string, tier string, cause string, retracted boolean"


def rows(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text = " ".join(["the", "slow"] * r.randrange(4) + [words[min(299, int(r.expovariate(0.03)))] for _ in range(r.randrange(14))])
        out.append((i, None if i % 29 == 0 else text, r.choice(["a", "b", None]), r.choice([None, [], ["k1"], ["k1", "k2", "k2"], ["k3"]]),
                    r.choice([None, [0.0] * 8, [r.gauss(0, 1) for _ in range(8)]]), r.choice(["cpu", "gpu", None]), r.choice(["VERIFIED", "TESTED"]), f"c{i % 5}", i % 13 == 0))
    return out + [(n, "alone", None, None, None, None, "TESTED", "x", False), (n + 1, " ".join(words) * 40, "a", ["k1"], [1.0] * 8, "cpu", "VERIFIED", "y", False)]


def plain(queries, store, k, text_only=False):
    store = [s for s in store if not s[8]]
    terms = lambda t: Counter(w for w in re.split(r"\W+", (t or "").lower()) if len(w) > 1)
    st = {s[0]: terms(s[1]) for s in store}
    df = Counter(t for c in st.values() for t in c)
    n1 = len(store) + 2
    idf = lambda c: math.log(n1 / (c + 1)) + 1
    out = []
    for q in queries:
        qt = terms(q[1])
        w = {t: idf(df[t] + 1) for t in qt}
        qn = math.sqrt(sum((qt[t] * w[t]) ** 2 for t in qt))
        scored = []
        for s in store:
            c = st[s[0]]
            dot = sum(qt[t] * c[t] * w[t] ** 2 for t in qt if t in c)
            sem = dot / qn / math.sqrt(sum((c[t] * w.get(t, idf(df[t]))) ** 2 for t in c)) if dot else 0.0
            a, b = set(q[3] or ()), set(s[3] or ())
            x, y = q[4] or [0] * 8, s[4] or [0] * 8
            n = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
            cos = max(0, sum(u * v for u, v in zip(x, y)) / n) if n else 0
            struct = 0.4 * (q[2] == s[2]) + 0.3 * (len(a & b) / len(a | b) if a | b else 0) + 0.3 * cos
            graph = float(q[5] == s[5] and q[5] is not None)
            score = sem if text_only else 0.5 * struct + 0.3 * sem + 0.2 * graph
            if sem > 0 or not text_only:
                scored.append((round(score, 6), q[0], s[0], round(sem, 6), s[7] if s[6] == "VERIFIED" else None, -round(score, 9)))
        scored.sort(key=lambda r: (r[5], r[2]))
        out += [(*r[1:3], r[0], *((r[3],) if text_only else (r[3], r[4])), n + 1) for n, r in enumerate(scored[:k])]
    return sorted(out)


def frames(spark, queries, store):
    return (spark.createDataFrame(queries, SCHEMA).selectExpr("id qid", "text", "version", "kernels", "z", "stage"), spark.createDataFrame(store, SCHEMA))


@pytest.mark.parametrize("n, block, part", [(1, 1000, 8000), (60, 1000, 8000), (60, 7, 20), (60, 25, 1)])
def test_retrieve_equals_full_comparison(spark, n, block, part):
    store, queries = rows(120), rows(160, 2)[-n:]
    q, s = frames(spark, queries, store)
    got = R.retrieve(q, s, 3, query_block=block, store_block=part).collect()
    assert sorted((r.qid, r.id, round(r.score, 6), round(r.semantic, 6), r.cause, r["rank"]) for r in got) == plain(queries, store, 3)


def test_small_steps_inside_a_tile(spark):
    """A bar rises between the steps of a tile; what it shuts out would not have been among the best."""
    import numpy as np
    import pyarrow as pa

    store, queries = [s for s in rows(150) if not s[8]], rows(40, 3)
    q, d = (t.toArrow() for t in nearest.vectors(*(f.drop("retracted") for f in frames(spark, queries, store))))
    got = []
    for cells in (nearest.CELLS, 200):
        old, nearest.CELLS = nearest.CELLS, cells
        try:
            i, j, score, sem = nearest.tile(3, 0.3, R.Incident(), False)(q, d)
        finally:
            nearest.CELLS = old
        best = {}
        for a, b, x in sorted(zip(i, j, np.round(score, 9)), key=lambda r: (r[0], -r[2], d["id"][int(r[1])].as_py())):
            best.setdefault(a, []).append((b, x))
        got.append({a: x[:3] for a, x in best.items()})
    assert got[0] == got[1] and isinstance(d, pa.Table)


def test_topk_similar(spark):
    store, queries = rows(100), rows(30, 4)
    q, s = frames(spark, queries, store)
    got = nearest.topk_similar(q, s.where("not retracted"), 5, 8, 30).collect()
    assert sorted((r.qid, r.id, round(r.sim, 6), round(r.sim, 6), r["rank"]) for r in got) == plain(queries, store, 5, True)


def test_many_queries_store_few_rows(spark, monkeypatch):
    stored = []
    real = nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda df, name="t": (stored.append(name), real(df, name))[1])
    store = rows(200)
    sizes = {}
    for n in (999, 2500):
        queries = [(i, *rows(50, 5)[i % 50][1:]) for i in range(n)]
        q, s = frames(spark, queries, store)
        got = R.retrieve(q, s, 3).select("qid", "id", "rank").collect()
        assert len(got) == 3 * n
        sizes[n] = {r.qid: [x.id for x in got if x.qid == r.qid] for r in got if r.qid < 50}
    assert {k: sorted(v) for k, v in sizes[999].items()} == {k: sorted(v) for k, v in sizes[2500].items()}
    assert set(stored) == {"query-terms", "terms", "df", "query-vectors", "vectors"}


def test_words_are_counted_where_the_texts_are(spark):
    """One shuffle of texts and none of words; the vectors go on without the texts. An id that comes twice has the words of both texts."""
    q, s = frames(spark, rows(20, 2), rows(60))
    plan = nearest.term_counts(s, "id", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(id" in plan
    assert all("text" not in v.columns for v in nearest.vectors(q, s))
    twice = nearest.term_counts(spark.createDataFrame([(1, "ab cd"), (1, "ab"), (2, None)], "id long, text string"), "id", 8)
    assert sorted(tuple(r) for r in twice.collect()) == [(1, "ab", 2), (1, "cd", 1)]


def test_empty(spark):
    q, s = frames(spark, rows(3), rows(3))
    assert R.retrieve(q.limit(0), s).count() == 0 and R.retrieve(q, s.limit(0)).count() == 0
