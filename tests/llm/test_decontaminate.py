import random

from lagsleuth.llm import decontaminate as dc


def brute(docs, items, window):
    out = []
    for text in docs:
        w, hit, found = dc.words_of((text or "").encode()), set(), set()
        for item_id, t in items:
            q = dc.words_of((t or "").encode())
            n = min(len(q), window)
            for j in range(len(q) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[j : j + n]:
                        hit |= set(range(i, i + n))
                        found.add(item_id or "")
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    say = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(str(i), say(rng.randint(0, 14), 3)) for i in range(12)] + [(None, "a b, A-c!"), ("x", None), ("3", "zz yy xx ww vv")]
    texts = [say(rng.randint(0, 60), rng.choice([3, 4, 8])) for _ in range(60)] + [None, "", "ZZ yy.xx ww vv", say(3000, 3)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Matches int").repartition(3)
    for window, block in ((4, 1 << 20), (4, 40), (10, 1 << 20)):
        got = dc.find(docs, spark.createDataFrame(items, "item_id string, text string"), window=window, block_bytes=block)
        assert got.columns == ["doc_id", "text", "n_words", "n_hit", "matches"]
        out = [(r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) for r in sorted(got.collect())]
        assert out == brute(texts, items, window)


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "x p a b c d e f q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "z a b c d e f y")], "item_id long, text string")
    m = dc.find(docs, items, window=3).first().matches
    assert [tuple(x) for x in m] == [("7", 1, 2, 6)]


def test_empty_tables_and_remove(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "k l")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs, none).where("n_hit > 0 or size(matches) > 0").count() == 0
    assert dc.find(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    assert [tuple(r) for r in dc.remove(docs, one).collect()] == [(None, "k l")]


def test_repeated_items_are_one_item(spark):
    """Else all copies come to one block, however small the blocks are, and to the matches."""
    docs = spark.createDataFrame([(1, "x p a b c d e f q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "z a b c d e f y")] * 50 + [(8, "z a b c d e f y")], "item_id long, text string")
    m = dc.find(docs, items, window=3, block_bytes=100).first().matches
    assert sorted(tuple(x) for x in m) == [("7", 1, 2, 6), ("8", 1, 2, 6)]
