"""The stages after the first against plain Python; the first against its own classifier."""
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lagsleuth.llm import bpe, toxicity
from lagsleuth.llm.queries import toxicity_chain

from . import test_decontaminate, test_line_dups, test_near_dups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    base = docs.limit(1).first()
    more = [(9001, base.text + " " + items[0][1], "en", "src0", 7), (9002, None, "en", "src0", 0), (9003, "clean words that nobody else has said here", None, None, None),
            (9004, " ", "en", "src0", 1)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    columns, state = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in state.select("doc_id", "text").collect()]
        stage(spark, state, D).write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        after = sorted(state.collect())
        if name != "byte_bpe":
            assert state.columns == columns
        if name == "toxicity":
            ids = {r.doc_id for r in after}
            chain = toxicity_chain(spark, D)
            scored = toxicity.predict(docs.select("doc_id", "text"), chain).collect()
            assert ids == {r.doc_id for r in scored if r.p_toxic < chain.thresholds[-1]} and 0 < len(ids) < len(scored)
        elif name == "line_dedup":
            want = [(i, t) for i, n, k, t in test_line_dups.brute(before) if n > k or not k]
            assert [(r.doc_id, r.text or "") for r in after] == want
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None and dict(before)[r.doc_id] != r.text)
        elif name == "near_dedup":
            assert [r.doc_id for r in after] == [i for i, _, _, kept in test_near_dups.brute(before, 5, 80) if kept]
        elif name == "decontamination":
            hit = test_decontaminate.brute([t for _, t in before], items, 10)
            assert [r.doc_id for r in after] == sorted(i for (i, _), (_, n, _) in zip(before, hit, strict=True) if not n)
        else:
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            texts = dict(before)
            assert [r.doc_id for r in after] == sorted(texts)
            for r in after:
                ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4")
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert corpus_pipeline.run(spark, D).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_lines_go_from_rows_that_share_an_id(spark):
    rows = [(1, "one two three four five\nsix seven eight nine"), (5, "one two three four five\nnew words are said here"), (5, "other things stand here\nother things stand here"),
            (5, "one two three four five\nnew words are said here"), (5, "six seven eight nine"), (6, None), (None, "one two three four five")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, D).collect()), key=str)
    want = [(1, rows[0][1]), (5, "new words are said here"), (5, "new words are said here"), (5, "other things stand here"), (None, "one two three four five")]
    assert [x for x in got if x[0] != 6] == sorted(((i, t, len(t)) for i, t in want), key=str)
