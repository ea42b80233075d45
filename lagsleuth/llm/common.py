"""Small helpers of the operators in this subpackage."""
from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
MEMO_WORDS = 200_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES):
    """Cut a record batch so that a piece holds about `limit` bytes, one row at least."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def add_columns(df: DataFrame, add: str, fn, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`fn(batch) -> list of arrow arrays or lists` for the columns of the DDL string `add`; all other columns pass through.

    An input column with the name of an added one is replaced.
    """
    new = T.StructType.fromDDL(add)
    taken = {f.name.lower() for f in new}
    keep = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in keep] + [f.name for f in new]
    types = arrow_types(new)

    owner = fn.__module__

    def run(batches):
        claim(owner)
        for whole in batches:
            for b in slices(whole, slice_bytes):
                made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, t) for a, t in zip(fn(b), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + made, names=names)

    return df.mapInArrow(run, T.StructType(keep + list(new)))


def arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


_owner: list[str] = []
_stores: list[dict] = []


def store() -> dict:
    """What a worker process remembers from task to task for one operator; let go when another operator's tasks come."""
    _stores.append({})
    return _stores[-1]


def claim(owner: str) -> None:
    if _owner != [owner]:
        _owner[:] = [owner]
        for s in _stores:
            s.clear()
        _memo.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a fixed number of words."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


_memo = WordHashes()


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
TOGETHER = 1 << 18


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:start + size], eight bytes at a time; data has eight bytes more than any span."""
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(start), TOGETHER):
        h, s, n = out[i : i + TOGETHER], start[i : i + TOGETHER], size[i : i + TOGETHER]
        left = np.flatnonzero(n > 0)
        done = 0
        while len(left):
            eight = np.ascontiguousarray(data[(s[left] + done)[:, None] + np.arange(8)]).view("<u8").ravel()
            h[left] = mix(h[left] ^ (eight & KEEP[np.minimum(n[left] - done, 8)]))
            done += 8
            left = left[n[left] > done]
    return out


def digest_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit digests of long spans: the sum of the hashes of their numbered runs of eight bytes."""
    out = mix(size.astype(np.uint64) + np.uint64(1))
    for i in range(0, len(start), TOGETHER >> 5):
        s, n = start[i : i + (TOGETHER >> 5)], size[i : i + (TOGETHER >> 5)]
        runs = np.maximum(1, -(-n // 8))
        first = np.cumsum(runs) - runs
        owner = np.repeat(np.arange(len(n)), runs)
        at = 8 * (np.arange(len(owner)) - first[owner])
        eight = np.ascontiguousarray(data[(s[owner] + at)[:, None] + np.arange(8)]).view("<u8").ravel()
        eight &= KEEP[np.minimum(n[owner] - at, 8)]
        out[i : i + (TOGETHER >> 5)] += np.add.reduceat(mix(eight ^ mix(at.astype(np.uint64) + np.uint64(7))), first)
    return mix(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a line feed, and where each begins."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(b"\n".join([*texts, bytes(8)]), np.uint8), np.cumsum(size) - size


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs without ASCII white space, in data without its last eight bytes."""
    inside = np.zeros(len(data) - 6, np.int8)
    inside[1:-1] = ~SPACE[data[:-8]]
    step = np.diff(inside)
    start = np.flatnonzero(step == 1)
    return start, np.flatnonzero(step == -1) - start


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many each text has."""
    data, begin = joined(texts)
    start, size = word_spans(data)
    return hash_spans(data, start, size), np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def utf8_size(text) -> F.Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def range_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most parts - 1 rising values that cut the integer column `key` into ranges of about equal row counts."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = df.select(F.col(key).cast("long").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts))
    return np.unique(np.array(found, np.float64).astype(np.int64))


def part_count(spark, size: int, part_bytes: int) -> int:
    """Enough partitions for pieces of `part_bytes`, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes), 1)
