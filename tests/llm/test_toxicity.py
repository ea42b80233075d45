import random

import pytest

from lagsleuth.llm import toxicity as tx


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, labels = [], []
    for i in range(n):
        bad, poor = rng.random() < 0.25, rng.random() < 0.3
        w = [word() for _ in range(rng.randint(20, 80))] + (["nasty" + rng.choice(["", "ly", "er", word()])] if bad else []) + (["spam"] if poor else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(poor), int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(random.Random(8), 1200)
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, poor int, bad int")
    return docs, labels, tx.fit(docs, given.where("doc_id < 800"), ["poor", "bad"])


def test_held_out_accuracy(trained):
    docs, labels, chain = trained
    got = {r.doc_id: (r.p_poor, r.p_bad) for r in tx.predict(docs, chain).where("doc_id >= 800").collect()}
    right = [sum((got[i][k] >= 0.5) == bool(y[k]) for i, *y in labels if i >= 800) / 400 for k in (0, 1)]
    assert min(right) > 0.97 and len(chain.parts[1][2]) == 1


def test_score_equals_one_by_one(trained):
    _, _, chain = trained
    p = chain.score([b"some NASTY, spam", b""])
    for i, t in enumerate((b"some NASTY, spam", b"")):
        before = []
        for intercept, weights, earlier in chain.parts:
            z = intercept + sum(weights.get(m, 0) for m in tx.marks(t)) + sum(w * q for w, q in zip(earlier, before, strict=True))
            before.append(1 / (1 + 2.718281828459045**-z))
        assert p[i].tolist() == pytest.approx(before)
    assert p[0, 1] > 0.5 > p[1, 1]


def test_threshold():
    import numpy as np

    assert 0.2 < tx.best_threshold(np.array([0.9, 0.1, 0.6, 0.2]), np.array([1, 0, 1, 0])) < 0.6
    assert tx.best_threshold(np.array([0.3, 0.3]), np.array([1, 1])) <= 0.3


def test_odd_tables(spark, trained):
    docs = spark.createDataFrame([(None, "nasty", 1.0), (1, None, 2.0), (1, None, 2.0)], "doc_id long, text string, P_bad double")
    got = tx.predict(docs, trained[2])
    assert got.columns == ["doc_id", "text", "p_poor", "p_bad"] and got.count() == 3
    kept = tx.keep_clean(docs, trained[2], "bad")
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, None, 2.0)] * 2
    none = spark.createDataFrame([], "doc_id long, poor int, bad int")
    flat = tx.fit(docs, none, ["poor", "bad"])
    assert {(r.p_poor, r.p_bad) for r in tx.predict(docs, flat).collect()} == {(0.5, 0.5)}
    assert tx.predict(docs.limit(0), flat).count() == 0
    one = tx.fit(docs, spark.createDataFrame([(1, 0, None), (1, 0, 1), (77, 1, 1)], "doc_id long, poor int, bad int"), ["poor", "bad"])
    assert {round(r.p_poor, 4) for r in tx.predict(docs, one).collect()} == {round(1 / 3, 4)}
