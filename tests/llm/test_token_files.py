import glob
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lagsleuth.llm import token_files as tf

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tf.TextEncoder(PATH, 1, True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab İΣς'sé́  \x1c\x85\n\t漢<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_words_one_by_one_equal_the_whole(text):
    assert np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [1]


def test_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Some", "words", "of", "été"]) for _ in range(rng.randint(0, 300))) or None, 7) for i in rng.sample(range(10_000), 400)]
    rows += [(None, "first", 1), (rows[0][0], "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    for part_bytes, cut in ((20_000, True), (1 << 30, False)):
        path = f"{tmp_path}/t{part_bytes}"
        tf.write(docs, path, PATH, 1, cut, part_bytes=part_bytes, layout={"parquet.page.row.count.limit": 20, "parquet.block.size": 1 << 20})
        got = sorted(tf.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, *sorted(i for i, _, _ in rows if i is not None)]
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        by = {}
        for i, t, _ in rows:
            by.setdefault(i, []).append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1])
        assert all(r.ids in by[r.doc_id] for r in got)
        sums = {r.start: r.ids_crc32 for r in tf.with_crc32(tf.read(spark, path)).collect()}
        assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
        assert "ids" not in tf.read(spark, path, ids=False).columns


def test_layout_and_selective_reads(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('word other ', 30) text")
    tf.write(docs, str(tmp_path / "t"), PATH, 1, True, part_bytes=1 << 30, layout={"parquet.page.row.count.limit": 100})
    meta = pq.read_metadata(max(glob.glob(f"{tmp_path}/t/tokens/part-*.parquet")))
    by = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(5)}
    assert all(c.has_offset_index and c.has_column_index and c.compression == "ZSTD" for n, c in by.items() if "ids" not in n)
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "RLE_DICTIONARY" in by["ids.list.element"].encodings
    plan = tf.read(spark, str(tmp_path / "t")).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_empty(spark, tmp_path):
    tf.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), PATH, 1, True)
    assert tf.with_crc32(tf.read(spark, str(tmp_path / "t"))).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("abJKTYIé̱̌̇̈́ʹİßΣſK'\"!?.,;%$-_≠ \n<|endoftext>ENDOFTEXT19ªµ漢"), max_size=30), st.sampled_from(["", "<|EndOfText|>", "<|endoftext|>", "J̌ a,%%%", "It'S", "Te'LL.", "İ!", "a!'s"]))
def test_lowered_and_marked_words_equal_the_whole(text, more):
    text = text + more + text
    assert np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [1]


def test_letters_are_encoded_once_for_all_cases_and_marks():
    encoder, asked = tf.TextEncoder(PATH, 1, True), []
    batch = encoder.library.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, texts, **how):
            asked.extend(w for t in texts for w in t.split())
            return batch(texts, **how)

    encoder.library = Counting()
    got = encoder.encode([b"Thonin thonin, THONIN. thonin,%%% Thonin!!", b"thonin;"])
    assert sorted(asked) == sorted(["thonin", ",", ".", ",%%%", "!!", ";"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids + [1] for t in ("Thonin thonin, THONIN. thonin,%%% Thonin!!", "thonin;")]
