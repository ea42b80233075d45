import random
from math import comb

import numpy as np
import zstandard
from pyspark.sql import functions as F

from lagsleuth.llm import near_dups as nd


def brute(rows, size, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        sets[i], root[i] = s, i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in sets)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows, bases = [], [[word() for _ in range(n)] for n in (1, 2, 3, 6, 30, 200, 200, 400)]
    for i in rng.sample(range(5000), 300):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(int(len(w) * rng.choice([0, 0, 0.01, 0.03, 0.06, 0.1]))):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else " \n".join(w)))
    return rows + [(6000, None), (6001, ""), (6002, " \t")]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    for size, block in ((2, 4096), (5, 8)):
        monkeypatch.setattr(nd, "BLOCK", block)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.components(docs, size=size).collect())
        assert got == brute(rows, size, 80)


def test_a_chain_of_edits(spark):
    """Each text is near only to its neighbours."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(words)))
        words = words[2:] + [f"v{i}", f"u{i}"]
    got = nd.components(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, int(n * 0.9))], rng.integers(0, 2**63, n - max(1, int(n * 0.9))).astype(np.uint64)])
        s = nd.sketches([a, b], 250)
        assert (s != nd.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.13
    assert (nd.sketches([a], 250) == nd.sketches([a[::-1]], 250)).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (4, "x y z q r s t")], "doc_id long, text string")
    got = sorted(nd.components(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert sorted(r.doc_id or -1 for r in nd.drop_near_duplicates(docs).collect()) == [-1, 4, 4, 4]
    assert nd.components(docs.limit(0)).count() == 0


def test_main_component_is_renamed_by_the_best_partners(spark):
    """The least label of the main component changes after the rows were marked; node 900 still finds its second partner there."""
    same = lambda n: np.concatenate([np.zeros(n, "<u2"), np.ones(nd.COORDINATES - n, "<u2")])
    far = same(nd.COORDINATES)
    far[5:25] = 7
    sketch = {500: same(250), 501: same(250), 502: same(250), 100: same(173), 950: far, 900: far}
    sketch[900] = np.where(np.arange(nd.COORDINATES) < 235, far, 9).astype("<u2")
    words = " ".join(f"w{i}" for i in range(100))
    text = dict.fromkeys(sketch, words) | {950: "quite other words"}
    press = zstandard.ZstdCompressor()
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sketch.items()], "id long, sketch binary")
    texts = spark.createDataFrame([(i, bytearray(press.compress(t.encode()))) for i, t in text.items()], "id long, packed binary")
    shared = nd.band_keys(nodes, nd.COORDINATES, nd.ROWS).groupBy("key").agg(F.collect_list("id").alias("ids")).where("size(ids) = 6").select("key", F.explode("ids").alias("id"))
    labels = spark.createDataFrame([(i, 500 if 500 <= i <= 502 else i) for i in sketch], "id long, comp long")
    some = nd.marked(nd.other_rows(shared, labels), nodes, nd.COORDINATES, 80)
    best = some.where("partner is not null").select(F.col("id").alias("a"), F.col("partner").alias("b")).distinct()
    assert (900, 950) in {(r.a, r.b) for r in best.collect()}
    labels = nd.merge(labels, nd.linked(best, texts, 2, 80))
    assert {r.id: r.comp for r in labels.collect()} == {100: 100, 500: 100, 501: 100, 502: 100, 950: 950, 900: 900}
    links = nd.links_in_blocks(some, labels, nodes, texts, nd.COORDINATES, nd.ROWS, 2, 80)
    assert {r.id: r.comp for r in nd.merge(labels, links).collect()} == {100: 100, 500: 100, 501: 100, 502: 100, 950: 950, 900: 100}


def test_sketch_threshold_loses_less_than_the_bands():
    """Of pairs of similarity 0.8."""
    need = (0.8 - nd.SLACK) * nd.COORDINATES
    below = sum(comb(nd.COORDINATES, k) * 0.8**k * 0.2 ** (nd.COORDINATES - k) for k in range(nd.COORDINATES) if k < need)
    assert below < 1e-10 < (1 - 0.8**nd.ROWS) ** (nd.COORDINATES // nd.ROWS) < 2.5e-9
