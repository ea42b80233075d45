import public_tokenizers as P
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lagsleuth.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab theЖ\x1c\x85  \n\té漢字😀're"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(library, text):
    assert np.frombuffer(bpe.encoder(PATH, P.PATTERN).encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_long_pieces(library):
    e = bpe.encoder(PATH, P.PATTERN)
    for text in ("a" * 4097, "the" * 3000, "erererther" * 900, " " * 5000 + "x", "漢" * 1500):
        ids = e.encode([text])
        assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text)
        assert e.decode(ids)[0].decode() == text


def test_lower_rank_pairs_come_first():
    """xy xy: once the first is joined, (xy, x) has a lower rank than (x, y) and must go before the second pair."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xyx": 300, b"xy": 301}
    e = object.__new__(bpe.Encoder)
    e.pairs, e.byte_ids = bpe.PairTable(ranks), np.arange(256, dtype=np.int32)
    assert np.frombuffer(e.merge_all([b"xyxy"])[0], "<u4").tolist() == [300, ord("y")]


def test_frame(spark, library):
    rows = [(1, "some text", 5), (1, "some text", 5), (2, None, 6), (None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int")
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    out = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in got.collect())
    n = len(library.encode_ordinary("some text"))
    assert out == [(0, 0, ""), (1, n, "some text"), (1, n, "some text"), (2, 0, "")]
    assert bpe.round_trip(docs, PATH, P.PATTERN).select("n_tokens", "decoded").collect() == got.select("n_tokens", "decoded").collect()
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
