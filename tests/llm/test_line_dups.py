import random

import numpy as np

from lagsleuth.llm import line_dups as ld
from lagsleuth.llm import substrings as ss


def brute(rows, percent=80):
    lines = []
    for d, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = set(line.encode().lower().split())
            if w and i is not None:
                lines.append((i, d, k, w))
    gone = set()
    for i, d, k, w in lines:
        for j, e, m, v in lines:
            if (j < i or (e == d and m < k)) and 100 * len(w & v) >= percent * len(w | v):
                gone.add((d, k))
                break
    out = []
    for d, (i, t) in enumerate(rows):
        all_ = (t or "").split("\n")
        out.append((-1 if i is None else i, sum(bool(x.encode().split()) for x in all_), sum((d, k) in gone for k in range(len(all_))), "\n".join(x for k, x in enumerate(all_) if (d, k) not in gone)))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 1, 2, 3])))
    bases = [[word() for _ in range(n)] for n in (1, 2, 4, 5, 8, 9, 10, 12, 30, 60, 130)]

    def line():
        if rng.random() < 0.4:
            return " ".join(word() for _ in range(rng.randint(0, 12)))
        w = list(rng.choice(bases))
        for _ in range(int(len(w) * rng.choice([0, 0, 0.05, 0.1, 0.2, 0.3]) + rng.random() / 2)):
            a = rng.random()
            if a < 0.4:
                w[rng.randrange(len(w))] = word()
            elif a < 0.7:
                w.insert(rng.randrange(len(w) + 1), word())
            elif len(w) > 1:
                del w[rng.randrange(len(w))]
        rng.shuffle(w)
        return " ".join(w).upper() if rng.random() < 0.1 else "\t ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in rng.sample(range(3000), 160)]
    rows += [(None, rows[0][1]), (rows[3][0], rows[4][1]), (5000, None), (5001, ""), (5002, "\n\n \n"), (5003, "same line\n" * 50), (5004, "Same LINE")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(4)
    for percent, row_bytes in ((80, 1), (80, 4 << 20), (60, 500)):
        monkeypatch.setattr(ss, "ROW_BYTES", row_bytes)
        got = ld.remove_similar_lines(docs, percent=percent)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.kept) for r in got.collect()) == brute(rows, percent)


def test_filters_lose_nothing():
    """Any two similar sets have an offer in common that the filters let through."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        a = np.unique(rng.integers(0, 2**60, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**60, int(n * 0.1))]))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        size, keys, place, maps = [], [], [], []
        for s in (a, b):
            m = np.zeros((1, 4), np.uint64)
            bit = s % 256
            np.bitwise_or.at(m[0], bit & 3, np.uint64(1) << (bit >> 2).astype(np.uint64))
            m = ld.fold(m, int(ld.width_of(np.array([len(s)]))[0]))
            for p in range(len(s) - -(-80 * len(s) // 100) + 1):
                keys.append(s[p])
                place.append(p)
                size.append(len(s))
                maps.append(np.pad(m, ((0, 0), (0, 4 - m.shape[1])))[0])
        assert ld.useful(np.array(keys), np.array(size), np.array(place), np.array(maps), 80).any()


def test_empty(spark):
    assert ld.remove_similar_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
