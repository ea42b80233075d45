import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

from lagsleuth.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, count int, Number long"


def plain(rows, min_df=3, top=4):
    """The contract term by term, over dictionaries."""
    df, inside, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        inside[lang, source].update(words)
        df.update((lang, w) for w in set(words))
    kept = defaultdict(set)
    for (lang, w), n in df.items():
        if n >= min_df:
            kept[lang].add(w)

    def shares(lang, counts):
        n = sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

    of = {g: shares(g[0], inside[g]) for g in groups}
    out = []
    for lang, source in groups:
        whole = shares(lang, sum((inside[g] for g in groups if g[0] == lang), Counter()))
        p = of[lang, source]
        pairs = [(h[1], sum(abs(p[t] - of[h][t]) for t in kept[lang])) for h in groups if h[0] == lang and h[1] != source]
        over = [(t, p[t] - whole[t]) for t in kept[lang] if inside[lang, source][t] > 0 and p[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


WORDS = ["Haus", "der", "die", "éé", "漢字", "a", "b'c", "x1y", "𝒳z", "rare"]


def rows(n=240):
    out = []
    for i in range(n):
        text = " ".join(WORDS[(i * k + k * k) % (9 if i % 50 else 10)] for k in range(1, 2 + i % 11))
        out.append((i, None if i % 41 == 0 else text, [None, "de", "fr", "de"][i % 4], [None, "s1", "s2", "s3", "s1", "s10", "S1"][i % 7], 1, 2))
    out += [(500, "only odd words here", "xx", "s1", 0, 0), (501, "", "xx", "s2", 0, 0), (502, None, "yy", None, 0, 0), (3, "a " * 50_000, "de", "s1", 0, 0), (3, "a " * 50_000, "de", "s1", 0, 0)]
    return out


@pytest.mark.parametrize("limit, block, sources, bits", [(1 << 21, 2048, 128, None), (4, 3, 2, 3)])
def test_equals_plain(spark, monkeypatch, limit, block, sources, bits):
    monkeypatch.setattr(divergence, "SAMPLED", 1 if limit == 4 else 1024)
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, 3, 4, limit, block, sources, bits).collect())
    assert got == plain(data)


def test_sums_flush(spark):
    from pyspark.ml.linalg import Vectors

    data = [("en", f"s{i % 3}", Vectors.sparse(9, [(i % 9, 2.0), (8, 1.0)] if i % 9 < 8 else [(8, 3.0)])) for i in range(200)]
    df = spark.createDataFrame(data, ["lang", "source", "vector"]).coalesce(1)
    whole, cut = ({(r.source, r.number): r["count"] for r in divergence.summed(df, most).collect()} for most in (1 << 20, 10))
    assert whole == cut and sum(whole.values()) == sum(int(v.values.sum()) for _, _, v in data)


def test_no_kept_terms_and_empty(spark):
    data = rows(20)
    docs = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in divergence.audit(docs, min_df=1000).collect()) == plain(data, 1000)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_ties_go_by_bytes(spark):
    data = [(i, f"{w} same", "en", s, 0, 0) for i, (w, s) in enumerate(zip(["z", "é", "𝒳", "ﬁ"] * 3, ["p", "p", "p", "p", "q", "q", "q", "q", "r", "r", "r", "r"], strict=True))]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(data, SCHEMA), min_df=1, top=3).collect())
    assert got == plain(data, 1, 3)


def test_rows_of_slots_are_small(spark, monkeypatch):
    """Spark hands rows to Python ten thousand at a time, so 32 KB each were 320 MB."""
    stored, materialize = [], divergence.materialize
    monkeypatch.setattr(divergence, "materialize", lambda df, name: stored.append(materialize(df, name)) or stored[-1])
    base = divergence.columns(spark.createDataFrame(rows(), SCHEMA))
    bits, _ = divergence.frequent_slots(base, 3, 22)
    assert len(bits) == 1 << 19 and sum(bin(b).count("1") for b in bits if b) > 5
    assert stored[0].selectExpr("max(octet_length(counts))").first()[0] <= 1024


def test_workers_do_not_import_spark_ml():
    done = subprocess.run([sys.executable, "-c", "import sys, lagsleuth.llm.divergence; sys.exit('pyspark.ml' in sys.modules)"], env={"PYTHONPATH": ":".join(p for p in sys.path if p)})
    assert done.returncode == 0
