import random

from lagsleuth.llm import substrings as ss


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out.append((-1 if i is None else i, len(w), keep.count(False), b" ".join(x for x, on in zip(w, keep, strict=True) if on)))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n, k: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    shared = [say(n, 26) for n in (13, 14, 20, 60)]
    rows = [(i, " ".join(rng.choice([*shared, say(rng.randint(0, 30), rng.choice([2, 26]))]) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(1000), 150)]
    rows += [(None, shared[3]), (rows[0][0], rows[1][1]), (2000, None), (2001, ""), (2002, " \t\n "), (2003, shared[3]), (2004, "a " * 5000), (2005, "a " * 4000)] + [(3000 + i, "copy " + shared[3]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
    for window, row_bytes in ((13, 1), (13, 4 << 20), (9, 900)):
        monkeypatch.setattr(ss, "ROW_BYTES", row_bytes)
        got = ss.remove_repeats(docs, window=window)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()) == brute(rows, window)


def test_cover():
    assert {(a - b) % ss.PERIOD for a in ss.COVER for b in ss.COVER} == set(range(ss.PERIOD))


def test_empty(spark):
    assert ss.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
