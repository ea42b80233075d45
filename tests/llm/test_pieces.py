import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lagsleuth.llm import pieces

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def split(ids, count):
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab theЖ▁▁   \n\t\x00é漢字😀're<s>/1"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_equals_the_library(library, texts):
    s = pieces.segmenter(PATH)
    assert s.by_chunk
    ids, count = s.encode(texts)
    assert split(ids, count) == library.encode(texts)
    assert s.decode(ids, count) == [library.decode(x) for x in library.encode(texts)]


def test_long_and_odd_texts(library):
    s = pieces.Segmenter(PATH)
    texts = ["a" * 20_000, "the " * 30_000, " " * 5000 + "x", "x" + " " * 4999, " ", "", None, "漢" * 9000, "<s></s><unk><0x41>", "▁ ▁a", "word\nword \n"]
    ids, count = s.encode(texts)
    assert split(ids, count) == library.encode([t or "" for t in texts])
    assert all(len(c) <= pieces.MEMO_BYTES for c in s.memo)


def test_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 5)
    s = pieces.Segmenter(PATH)
    for i in range(8):
        texts = [f"w{i} w{i + 1} {'x' * i}", " ".join(f"v{j}" for j in range(i))]
        assert split(*s.encode(texts)) == library.encode(texts)
        assert len(s.memo) <= 5


def test_other_models_take_whole_texts(library):
    s = pieces.Segmenter(PATH)
    s.by_chunk = False
    texts = ["two  words", None, " x"]
    assert split(*s.encode(texts)) == library.encode(["two  words", "", " x"])


def test_frame(spark, library):
    rows = [(1, "some text", 5), (1, "some text", 5), (2, None, 6), (None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int")
    got = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    want = library.encode("some text")
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in got.collect()) == [(0, 0, [], ""), (1, len(want), want, "some text"), (1, len(want), want, "some text"), (2, 0, [], "")]
    assert pieces.round_trip(docs, PATH).select("n_tokens", "ids", "decoded").collect() == got.select("n_tokens", "ids", "decoded").collect()
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).collect()[0].decoded == ""


def test_query_digests(spark, library, tmp_path):
    import hashlib

    from lagsleuth.llm.queries import op11_sentencepiece

    texts = ["Some  text\n▁here 😀", None, "", " ", "a b a b", "a b a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op11_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
