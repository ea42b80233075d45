import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lagsleuth.llm import mixing as mx


def corpus(rng, n):
    """Pairs of words follow each other, so a context tells much."""
    pairs = [("".join(rng.choice("abcdefg") for _ in range(4)), "".join(rng.choice("abcdefg") for _ in range(4))) for _ in range(150)]
    rows = []
    for i in range(n):
        w = [x for _ in range(rng.randint(0, 60)) for x in rng.choice(pairs)]
        if rng.random() < 0.3:
            w.append("".join(rng.choice("xyzé") for _ in range(6)))
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else "\n".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "unknown only")]


def test_base_equals_plain_counts(spark):
    rows = corpus(random.Random(1), 300)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    count = Counter(w for i, ws in words.items() if i not in out for w in ws)
    n, v = sum(count.values()), len(count)
    for top in (mx.TOP_WORDS, 20):
        got = {r.doc_id: r for r in mx.score(docs, top_words=top).collect()}
        assert got.keys() == words.keys()
        for i, ws in words.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(ws), sum(w in count for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            assert r.score < 0
        if top > 20:
            held = [got[i] for i in out]
            assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in mx.score(docs.repartition(2), top_words=20).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, rel=1e-4)


def test_huffman_and_probabilities():
    """Codes are prefix free and complete; the probabilities of all symbols after a context sum to one."""
    counts = np.array([0, 3, 50, 7, 7, 1, 20])
    code, length = mx.huffman(counts)
    assert sum(2.0 ** -length) == 1 and len({(c, n) for c, n in zip(code.tolist(), length.tolist(), strict=True)}) == len(counts)
    assert length.argmin() == 2
    rng = np.random.default_rng(1)
    coder = mx.Coder([b"a", b"b", b"c"], [9, 5, 1], 4, 2, np.arange(257))
    tables = [rng.integers(0, 256, 1 << mx.TABLE_BITS).astype(np.uint8) for _ in range(2)]
    mixer = mx.Mixer(coder, tables, rng.random((3, mx.GATES)).astype(np.float32))
    symbols = np.arange(5)
    contexts = [np.full(5, 77, np.uint32), np.full(5, 99, np.uint32)]
    sign, logit, gate, first = mixer.read(symbols, contexts, np.zeros(5, np.int64))
    lost = np.log1p(np.exp(-mixer.margin(sign, logit, gate, mixer.start)))
    assert np.exp(-np.add.reduceat(lost, first)).sum() == pytest.approx(1, rel=1e-5)


def test_no_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = mx.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3
    assert mx.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert mx.score(spark.createDataFrame([(None, "a b"), (None, None), (1, "b a")], "doc_id long, text string")).count() == 3


def test_states_are_exact_counts_of_each_context(spark, monkeypatch):
    """However many contexts there are, none sees the counts of another one; parts of one document give the same scores."""
    rng = random.Random(5)
    words = [b"%d" % i for i in range(300)]
    coder = mx.Coder(words, list(range(300, 0, -1)), 50, 5, np.arange(257)).prepare()
    docs = [[rng.choice(words) for _ in range(40)] + [b"odd%d" % i] for i in range(80)]
    symbol, keys, *_ = coder.units(docs)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at)
    state, ends = mx.path_states(coder, key, n)
    count: dict = {}
    for k, m, s in zip(key.tolist(), n.tolist(), coder.symbols(key).tolist(), strict=True):
        path = tuple(coder.sign[coder.start[s] : coder.start[s] + coder.length[s]].tolist())
        for d, bit in enumerate(path):
            count.setdefault((int(mx.contexts(np.array([k]))[0]), path[:d]), [0, 0])[int(bit > 0)] += m
    for k, s, a, b in zip(key.tolist(), coder.symbols(key).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        path = tuple(coder.sign[coder.start[s] : coder.start[s] + coder.length[s]].tolist())
        want = mx.states(np.array([count[int(mx.contexts(np.array([k]))[0]), path[:d]] for d in range(len(path))]))
        assert state[a:b].tolist() == want.tolist()
    frame = spark.createDataFrame([(i, b" ".join(d).decode()) for i, d in enumerate(docs)], "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r.score for r in mx.score(frame, top_words=250).collect()}
    monkeypatch.setattr(mx, "TABLE_BITS", 6)
    assert {r.doc_id: r.score for r in mx.score(frame, top_words=250).collect()} == pytest.approx(whole, rel=1e-4)


def test_tuning_documents_enter_the_counts(spark):
    """A context that only tuning documents have is known to the scores, and not to the fit of the starting weights."""
    coder = mx.Coder([b"a", b"b", b"c"], [9, 5, 1], 4, 2, np.arange(257))
    _, keys, *_ = coder.prepare().units([[b"a", b"b"]])
    rows = [(0, int(k), 0, 20) for k in np.unique(np.concatenate(keys))] + [(1, 5 << mx.SYMBOL_BITS | 2, 7, 0)]
    got = mx.key_states(spark.createDataFrame(rows, "part long, key long, n long, m long"), spark.sparkContext.broadcast(coder)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.key == rows[-1][1]:
            assert r.fitted is None and all(x >> 6 == 2 for x in r.states)
        else:
            assert all(x >> 6 == 3 for x in r.states) and all(x >> 6 == 0 for x in r.fitted)


def test_weights_are_refined_after_each_block(monkeypatch):
    coder = mx.Coder([b"a", b"b", b"c"], [9, 5, 1], 4, 2, np.arange(257))
    docs = [[b"a", b"b"] * 30, [b"c"] * 10, [b"a"] * 1000]
    _, keys, *_ = coder.prepare().units(docs)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    state, *_, ends = mx.path_states(coder, key, np.bincount(at))
    start, learned, learn = np.full((3, mx.GATES), 0.3, np.float32), [], mx.Mixer.learn
    mixer = mx.Mixer.of_part(coder, pa.table({"key": key, "states": [state[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]}), start)
    monkeypatch.setattr(mx.Mixer, "learn", staticmethod(lambda *a: learned.append(1) or learn(*a)))
    refined = mixer.scores(docs)[0]
    assert len(learned) == 1000 // 32
    monkeypatch.setattr(mx.Mixer, "learn", staticmethod(lambda *a: None))
    fixed = mixer.scores(docs)[0]
    assert refined[1] == fixed[1] and refined[0] > fixed[0] and refined[2] > fixed[2]


def plain_parts(coder, rng, n, words):
    """Use and documents of some parts, and one with a context so frequent that its logits are cut."""
    parts = [(rng.choice((0, 1, 1, 2)), [[rng.choice(words) for _ in range(rng.randint(0, 40))] + [b"odd%d" % rng.randint(0, 9)] for _ in range(5)]) for _ in range(n)]
    return [*parts, (1, [[words[0], words[1]] * 6000, []]), (2, [[words[0], words[1], words[2]] * 7, []])]


def test_ranges_answer_each_part_with_the_states_of_the_plain_rows(spark):
    rng = random.Random(7)
    words = [b"%d" % i for i in range(60)]
    coder = mx.Coder(words, list(range(60, 0, -1)), 50, 5, np.arange(257)).prepare()
    parts = plain_parts(coder, rng, 9, words)
    keys = [np.unique(np.concatenate(coder.units(docs)[1]), return_counts=True) for _, docs in parts]
    rows = [(i, int(k), int(t) if use == 1 else 0, int(t) if use == 2 else 0) for i, ((use, _), (key, n)) in enumerate(zip(parts, keys, strict=True)) for k, t in zip(key, n, strict=True)]
    known = {r.key: r for r in mx.key_states(spark.createDataFrame(rows, "part long, key long, n long, m long"), spark.sparkContext.broadcast(coder)).collect()}
    every = np.unique(np.concatenate([k for k, _ in keys]))
    cuts = every[[40, 41, 300, len(every) // 2, -5]]
    for bounds in (np.zeros(0, np.int64), np.unique(np.where(cuts >> mx.KIND_AT < 2, cuts >> mx.SYMBOL_BITS << mx.SYMBOL_BITS, cuts >> mx.LETTER_BITS << mx.LETTER_BITS))):
        asked = [[] for _ in range(len(bounds) + 1)]
        for i, ((use, _), (key, n)) in enumerate(zip(parts, keys, strict=True)):
            cut = mx.parted(key, bounds)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                asked[r].append((i, use, mx.pack_keys(key[cut[r] : cut[r + 1]], n[cut[r] : cut[r + 1]] if use else n[:0])))
        told = [(r, *x) for r, some in enumerate(asked) if some for x in mx.answers(coder, some)]
        for i, ((use, _), (key, _)) in enumerate(zip(parts, keys, strict=True)):
            for column, at in (("states", 2), ("fitted", 3)):
                mine = [(x[0], x[at]) for x in told if x[1] == i]
                if column == "fitted" and use != 2:
                    assert all(x is None for _, x in mine)
                    continue
                got = mx.told(coder, key, bounds, pa.table({"range": [x for x, _ in mine], "states": pa.array([x for _, x in mine], pa.binary())}))
                assert got.column("key").to_pylist() == key.tolist()
                assert got.column("states").to_pylist() == [bytes(known[k][column]) for k in key.tolist()]


def test_packed_keys_come_back():
    rng = np.random.default_rng(3)
    for kind, wide in ((0, 38), (1, 57), (2, 36), (3, 54)):
        key = np.unique(np.concatenate([rng.integers(0, 1 << wide, 500), rng.integers(0, 1 << 10, 50)])) + (kind << mx.KIND_AT)
        n = rng.integers(1, 1 << 20, len(key))
        for times in (n, n[:0]):
            got = mx.unpack_keys(mx.pack_keys(key, times))
            assert got[0].tolist() == key.tolist() and got[1].tolist() == times.tolist()


def test_a_state_of_counts_on_one_side_mirrors_the_other():
    n = np.concatenate([np.arange(20_000), 2 ** np.arange(15, 50)])
    ones, zeros = mx.states(np.stack([0 * n, n], axis=1)), mx.states(np.stack([n, 0 * n], axis=1))
    alone = mx.alone_states(n)
    assert (mx.turned(np.zeros(len(n), bool), alone) == zeros).all()
    assert (np.where(alone & 63 == 0, alone | 63, alone) == ones).all()


def test_keys_and_states_are_stored_packed(spark, monkeypatch):
    """A key of a part costs a few bytes of disk, not a row; settings are as before when the score is done."""
    rng = random.Random(9)
    docs = [(i, " ".join("w%d" % int(rng.expovariate(0.002)) for _ in range(400))) for i in range(250)]
    stored, write = {}, mx.materialize

    def noted(df, name, *by):
        out = write(df, name, *by)
        stored.setdefault(name, []).append((out.count(), sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(mx, "materialize", noted)
    was = spark.conf.get(mx.CLEANUP, None)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert mx.score(frame).count() == len(docs)
    assert spark.conf.get(mx.CLEANUP, None) == was
    keys = 2 * sum(len(t.split()) + 1 for _, t in docs) * 0.7
    rows, size = (sum(x[i] for name in stored if name not in ("word-counts", "top-words", "scored") for x in stored[name]) for i in range(2))
    assert rows < 200 and size < 6 * keys
