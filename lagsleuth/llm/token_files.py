"""Token ids of a corpus as Parquet list columns, in ascending document order.

Documents are dealt once into id ranges, sorted, encoded and written, one file for each range. A row has doc_id, part (the range),
at (ids of the range before it), n_tokens and ids. The list column is dictionary coded; the numbers beside it are delta coded. Row
groups and pages have set sizes, and page indexes let a reader skip pages: a query of lengths never reads ids, and one of a few
documents reads only their pages. A second, tiny table gives for every part the count of ids before it, so the place of any
document in the whole sequence is base + at. Only one value for each part passes through one task.

Texts are encoded with the tokenizers library. With `cut_at_space`, for tokenizers whose normaliser and pre-tokenizer always cut at
ASCII white space and drop it, each distinct word of a slice is encoded once and remembered (a bounded memory of words); otherwise whole texts.
If the normaliser also lower-cases, A-Z are lowered before the words are told apart, except in texts where that could change a composed letter or
make an added token; a word of Latin letters and then marks is the ids of the letters and those of the marks.

Cases: a null text is empty and has only the end id; null doc_ids come first; repeated ids stand in the order of a text hash and are
all written; further columns are not written; an empty table gives files without rows.
"""
from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import shared_dir

from .common import claim, part_count, range_bounds, slices, store, text_bytes

PART_BYTES = 128 << 20
SLICE_BYTES = 5 << 20
MEMO_WORDS = 400_000
TOGETHER = 256
#: All ASCII marks but the apostrophe, which tokenizers cut in ways of their own.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below are Latin and older than any table of letters that a library may have.
LATIN = "\u0250"
LAYOUT = {"parquet.block.size": 64 << 20, "parquet.page.size": 128 << 10, "parquet.page.row.count.limit": 1000, "parquet.dictionary.page.size": 1 << 20,
          "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd"}


class Memo(dict):
    """Ids of remembered words; `found` has those of the slice at hand that are not kept."""

    found: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.found[word]


class TextEncoder:
    def __init__(self, path: str, end_id: int, cut_at_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end, self.cut_at_space = np.array([end_id], "<u4").tobytes(), cut_at_space
        self.memo = Memo()
        mark = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1 if mark else 0, bool)
        for t, i in vocabulary.items() if mark else ():
            self.is_end[i] = t.endswith(mark)
        described = json.loads(self.library.to_str())
        steps = described["normalizer"] or {}
        steps = steps.get("normalizers", [steps])
        self.lowers = any(x.get("type") == "Lowercase" for x in steps) and all(x.get("type") in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": "\\s+"} for x in steps)
        self.added = [x["content"].encode().lower() for x in described["added_tokens"]]
        # runs of marks are pieces of their own if the library cuts at just these borders, and no added token lies across one
        cutters = [x["pattern"].get("Regex", "") for x in (described["pre_tokenizer"] or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.cuts = cut_at_space and any("|[\\p{L}]+|" in x and x.endswith("|[^\\s\\p{L}\\p{N}]+") for x in cutters) and all(x.lstrip(MARKS) not in (x, b"") for x in self.added)

    def lowered(self, text: bytes) -> bytes:
        """The text with A-Z in lower case, if its ids are the same.

        U+0300 to U+037F (lead bytes CC and CD) compose with some letters in one case only (j with caron), and an added token is found as it is written."""
        if not self.lowers or b"\xcc" in text or b"\xcd" in text:
            return text
        low = text.lower()
        return text if any(x in low for x in self.added) else low

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text and the end id, little-endian unsigned 32 bits."""
        if not self.cut_at_space:
            return [x + self.end for x in self.ids_of([t.decode() for t in texts])]
        words = [self.lowered(t).split() for t in texts]
        distinct = set().union(*words)
        new = [w for w in distinct if w not in self.memo]
        if 2 * len(new) > len(distinct) and len(self.memo) >= MEMO_WORDS:
            self.memo, new = Memo(), list(distinct)  # other texts than before
        found = self.ids_of_words(new)
        if len(self.memo) < MEMO_WORDS:
            self.memo.update(found)
        else:
            self.memo.found = found
        get = self.memo.__getitem__
        return [b"".join(map(get, w)) + self.end for w in words]

    def ids_of_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters and perhaps one last mark are encoded many at a time: their tokens end with one or two word ends.

        A word of Latin letters and then marks takes the ids of both, which are encoded once for all words that have them."""
        out, plain, ends = {}, [], []
        odd, marked, wanted = [], [], dict.fromkeys(words)
        for w in words if self.cuts else ():
            letters = w.rstrip(MARKS)
            if 0 < len(letters) < len(w) and (t := letters.decode().lower()).isalpha() and max(t) < LATIN:
                marked.append((w, letters, w[len(letters) :]))
                del wanted[w]
                wanted.update((x, None) for x in marked[-1][1:] if x not in self.memo)
        for w in wanted:
            t = w.decode()
            n = 1 if t.isalpha() else 2 if t[:-1].isalpha() and t[-1] in ",.;:!?" else 0
            if n:
                plain.append((w, t))
                ends.append(n)
            else:
                odd.append((w, t))
        if len(self.is_end):
            starts = range(0, len(plain), TOGETHER)
            for i, e in zip(starts, self.library.encode_batch_fast([" ".join(t for _, t in plain[i : i + TOGETHER]) for i in starts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(self.is_end[ids]) + 1
                want = np.cumsum(ends[i : i + TOGETHER])
                if len(at) != want[-1]:
                    odd += plain[i : i + TOGETHER]
                    continue
                data, cuts = ids.tobytes(), [0, *(at[want - 1] * 4).tolist()]
                out.update(zip((w for w, _ in plain[i : i + TOGETHER]), (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        else:
            odd += plain
        out.update(zip((w for w, _ in odd), self.ids_of([t for _, t in odd]), strict=True))
        for w, *both in marked:
            out[w] = b"".join(out[x] if x in out else self.memo[x] for x in both)
        return out


_encoders = store()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, cut_at_space: bool, doc_id: str = "doc_id", text: str = "text",
          part_bytes: int = PART_BYTES, layout: dict | None = None) -> None:
    """Write `path`/tokens and `path`/parts. `tokenizer` is read by each worker."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("place"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = range_bounds(rows, "place", part_count(spark, size, part_bytes))

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), "right").astype(np.int32))

    def run(batches):
        claim(__name__)
        key = (tokenizer, end_id, cut_at_space)
        if key not in _encoders:
            _encoders[key] = TextEncoder(*key)
        at = 0
        for whole in batches:
            for b in slices(whole, SLICE_BYTES):
                ids = _encoders[key].encode(text_bytes(b.column("text")))
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(n.sum())

    dealt = rows.withColumn("part", part_of("place")).withColumn("h", F.xxhash64("text")).repartitionById(len(bounds) + 1, "part")
    coded = dealt.sortWithinPartitions("place", "h").select("doc_id", "text", "part").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids array<int>")
    coded.write.options(**{k: str(v) for k, v in (LAYOUT | (layout or {})).items()}).parquet(f"{path}/tokens")
    ends = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"))
    before = F.expr("sum(n) over (order by part rows between unbounded preceding and current row) - n")
    ends.select("part", before.alias("base"), F.col("n").alias("n_tokens"), "n_docs").coalesce(1).write.parquet(f"{path}/parts")


def read(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if wanted, ids."""
    tokens, parts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/parts").select("part", "base")
    return tokens.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *["ids"] * ids)


def new_path(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"


def with_crc32(coded: DataFrame) -> DataFrame:
    """Replaces ids with ids_crc32, over the ids as little-endian unsigned 32-bit integers."""
    keep = [f for f in coded.schema if f.name != "ids"]

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            offsets = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(sums, pa.int64())], names=[f.name for f in keep] + ["ids_crc32"])

    from pyspark.sql import types as T

    return coded.mapInArrow(run, T.StructType([*keep, T.StructField("ids_crc32", T.LongType())]))
