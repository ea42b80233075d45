import hashlib
import random

import numpy as np

from lagsleuth.llm import winnowing as wn


def plain(text, k, w):
    """One window at a time, over hashes of one gram at a time."""
    codes = np.array([ord(c) for c in text], np.uint32)
    k = min(k, len(codes))
    if not k:
        return []
    h = [int(wn.gram_hashes(codes[i : i + k], k)[0]) for i in range(len(codes) - k + 1)]
    out = set()
    for i in range(max(1, len(h) - w + 1)):
        win = range(i, min(i + w, len(h)))
        least = min(h[j] >> wn.PLACE_BITS for j in win)
        out.add(max(j for j in win if h[j] >> wn.PLACE_BITS == least))
    return sorted((j, h[j]) for j in out)


def test_equals_plain_windows(monkeypatch):
    rng = random.Random(1)
    for block in (wn.BLOCK, 7):
        monkeypatch.setattr(wn, "BLOCK", block)
        for n in [0, 1, 3, 5, 8, 12, 40, 150]:
            for k, w in ((5, 4), (3, 1), (1, 6), (8, 8)):
                t = "".join(rng.choice("abé😀") for _ in range(n))
                p, h = wn.winnow(t, k, w)
                assert list(zip(p.tolist(), h.tolist(), strict=True)) == plain(t, k, w)


def test_guarantee_and_density():
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for _ in range(50):
        same = say(wn.K + wn.W - 1)
        a, b = wn.winnow(say(rng.randint(0, 300)) + same + say(99))[1], wn.winnow(say(rng.randint(0, 300)) + same + say(50))[1]
        assert len(np.intersect1d(a, b))
    assert abs(len(wn.winnow(say(50_000))[0]) / 50_000 * (wn.W + 1) / 2 - 1) < 0.1


def test_next_of_each_document(spark):
    rng = random.Random(4)
    texts = {i * 3: "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 3, 4, 90, 400]))) for i in range(60)}
    texts[9] = texts[12] = "same text " * 20
    rows = [(i, t or None, "x") for i, t in texts.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, look string")
    ids = sorted(texts)
    want = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, q = texts[a], len(texts[a]) // 4
        new = t[: len(t) - q] + texts[b][:q]
        prints = [set(wn.winnow(x)[1].tolist()) for x in (t, new, texts[b])]
        like = [1.0 if not prints[0] | p else len(prints[0] & p) / len(prints[0] | p) for p in prints[1:]]
        want[a] = (len(t), hashlib.sha256(new.encode()).hexdigest(), *like)
    for part_bytes in (1, 500, 1 << 20):
        got = wn.compare_with_next(docs, part_bytes=part_bytes).collect()
        assert len(got) == len(want)
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[9] == by[12] != by[15]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "ab" * 40), (5, "cd" * 40), (5, "cd" * 40)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in wn.compare_with_next(docs).collect()) == [(0, 80), (5, 80), (5, 80)]
    one = wn.compare_with_next(docs.where("doc_id is null")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(None, 1.0)]
    assert wn.compare_with_next(docs.limit(0)).count() == 0
    assert [len(r.places) for r in wn.fingerprints(docs).collect()] == [len(r.hashes) for r in wn.fingerprints(docs).collect()]
