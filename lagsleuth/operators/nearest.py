"""The k best stored texts for each query, by TF-IDF cosine alone or with other features.

Queries are a stated set, looked for in all of the store, in tiles: blocks of queries by blocks of the store, one task each and one plan for any
number of either. A tile goes through its queries' terms by inverted lists, rare ones first. What the other terms can still add is bounded by the
query's own share of them (its norm over these terms, by Cauchy and Schwarz), so they are looked at only for documents that can still be among the k best
of some query. A task gives out its best rows alone; no pair is stored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .storage import materialize

C = F.col
NOT_WORD = r"[^\p{L}\p{N}_]+"
QUERY_BLOCK, STORE_BLOCK = 1000, 8000
#: Texts whose words are counted in one task.
TEXTS = 4000
#: A term that more than this share of a tile's queries have is a common one; cells and list entries at once.
COMMON, CELLS, ENTRIES = 0.1, 1 << 20, 1 << 21
#: Scores are compared to nine digits. A stored norm corrected for a query is at least this part of itself: idf falls by ln 1.5 at most, from 1.4 or more.
NEAR, LEAST_NORM = 1e-9, 0.7
#: Rows beyond k that a task gives out, as scores are only compared to nine digits.
SPARE = 4


def term_counts(rows: DataFrame, ident: str, parts: int) -> DataFrame:
    """(id, token, tf) over words of two or more characters of the whole text.

    The texts are shuffled instead of their words, which are counted where the text is; a task has the texts of one of ``parts`` parts alone."""
    tok = F.explode(F.split(F.lower("text"), NOT_WORD)).alias("token")
    return rows.select(ident, "text").repartition(parts, ident).select(ident, tok).where(F.length("token") >= 2).groupBy(ident, "token").agg(F.count(F.lit(1)).alias("tf"))


def parts_of(rows: int, spark) -> int:
    """As many parts as there are tasks in a shuffle, or more, so that a task counts the words of few texts."""
    return max(-(-rows // TEXTS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def vectors(queries: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, qn, terms: number, w, share, fix) and (id, base, terms: number, tf): smooth idf over the store plus the query itself, without the texts.

    Stored norms (base) are those of the store alone; fix is what a shared term changes in them. Only terms of some query are listed."""
    spark, stored = queries.sparkSession, store.count()
    qt = materialize(term_counts(queries, "qid", parts_of(queries.count(), spark)), "query-terms")
    st = materialize(term_counts(store, "id", parts_of(stored, spark)), "terms")
    n1 = F.lit(stored + 2.0)
    idf = lambda c: F.ln(n1 / (c + 1.0)) + 1.0
    asked = qt.groupBy("token").agg(F.lit(True).alias("asked"))
    df = st.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(asked, "token", "full").withColumn("df", F.coalesce("df", F.lit(0)))
    df = materialize(df.withColumn("number", F.monotonically_increasing_id()), "df")
    w = idf(C("df") + 1)
    q = qt.join(df, "token").groupBy("qid").agg(F.sum(F.pow(C("tf") * w, 2)).alias("qn"), F.collect_list(F.struct("number", (C("tf") * w * w).alias("w"), (C("tf") * w).alias("share"), (w * w - F.pow(idf(C("df")), 2)).alias("fix"))).alias("terms"))
    j = st.join(df, "token")
    # Sums and lists apart: partial sums are small, and lists are made in one step from the few rows that need them.
    base = j.groupBy("id").agg(F.sum(F.pow(C("tf") * idf(C("df")), 2)).alias("base"))
    lists = j.where("asked").select("id", "number", C("tf").cast("double").alias("tf")).repartition(parts_of(stored, spark), "id").groupBy("id").agg(F.collect_list(F.struct("number", "tf")).alias("terms"))
    return queries.drop("text").join(q, "qid", "left"), store.drop("text").join(base, "id", "left").join(lists, "id", "left")


class Lists:
    """The terms of a block of queries: posting lists of the rare ones, a matrix of the common ones."""

    def __init__(self, terms: pa.Array, qn: np.ndarray):
        flat, count = flattened(terms)
        number, w, share, fix = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("number", "w", "share", "fix"))
        self.n = len(qn)
        owner = np.repeat(np.arange(self.n), count)
        self.number, first, at = np.unique(number, return_index=True, return_inverse=True)
        self.fix = fix[first]
        having = np.bincount(at, minlength=len(self.number))
        self.common = having > max(1, COMMON * self.n)
        self.column = np.cumsum(self.common) - 1
        self.matrix = np.zeros((int(self.common.sum()), self.n))
        self.has = np.zeros_like(self.matrix)
        far = self.common[at]
        self.matrix[self.column[at[far]], owner[far]] = w[far]
        self.has[self.column[at[far]], owner[far]] = 1.0
        near = np.flatnonzero(~far)
        near = near[np.argsort(at[near], kind="stable")]
        size = np.bincount(at[near], minlength=len(self.number))
        self.begin, self.size, self.list_owner, self.list_w = np.cumsum(size) - size, size, owner[near], w[near]
        self.norm = np.sqrt(np.where(qn > 0, qn, np.inf))
        self.rest = np.minimum(1.0, np.sqrt(np.bincount(owner[far], np.square(share[far]), minlength=self.n)) / self.norm)

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.number, number), max(len(self.number) - 1, 0))
        return at, (self.number[at] == number if len(self.number) else np.zeros(len(number), bool))

    def rare(self, doc: np.ndarray, at: np.ndarray, tf: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Products and norm corrections of docs x queries over the rare terms."""
        keep = self.size[at] > 0
        doc, at, tf = doc[keep], at[keep], tf[keep]
        n = self.size[at]
        entry = np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        cell = np.repeat(doc, n) * self.n + self.list_owner[entry]
        tf_ = np.repeat(tf, n)
        dot = np.bincount(cell, tf_ * self.list_w[entry], minlength=docs * self.n)
        fix = np.bincount(cell, np.square(tf_) * np.repeat(self.fix[at], n), minlength=docs * self.n)
        return dot.reshape(docs, self.n), fix.reshape(docs, self.n)

    def rest_of(self, doc: np.ndarray, at: np.ndarray, tf: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The same over the common terms."""
        keep = self.common[at]
        a, b = np.zeros((2, docs, len(self.matrix)))
        a[doc[keep], self.column[at[keep]]] = tf[keep]
        b[doc[keep], self.column[at[keep]]] = np.square(tf[keep]) * self.fix[at[keep]]
        return a @ self.matrix, b @ self.has


def flattened(lists) -> tuple[pa.StructArray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tile(k: int, w_text: float, other, need_text: bool):
    """Best rows of one tile: (index of query, index of document, score, semantic, what `other` gives for them)."""

    def best(queries: pa.Table, docs: pa.Table):
        lists = Lists(queries["terms"], queries["qn"].to_numpy())
        flat, count = flattened(docs["terms"])
        at, hit = lists.find(flat.field("number").to_numpy(zero_copy_only=False))
        doc, at, tf = np.repeat(np.arange(docs.num_rows), count)[hit], at[hit], flat.field("tf").to_numpy(zero_copy_only=False)[hit]
        begin = np.searchsorted(doc, np.arange(docs.num_rows + 1))
        entries = np.concatenate([[0], np.cumsum(np.bincount(doc, lists.size[at], minlength=docs.num_rows))])
        base = np.nan_to_num(docs["base"].to_numpy().astype(float))
        low = np.sqrt(base) * LEAST_NORM
        features = other(queries, docs)
        by_id = np.empty(docs.num_rows, np.int64)
        by_id[pc.sort_indices(docs["id"]).to_numpy()] = np.arange(docs.num_rows)
        bar, i = np.full(lists.n, -np.inf), 0
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # query, document, score, semantic
        while i < docs.num_rows:
            m = int(np.searchsorted(entries, entries[i] + ENTRIES, "right")) - 1 - i
            m = max(1, min(m, CELLS // max(lists.n, 1), docs.num_rows - i))
            part = slice(begin[i], begin[i + m])
            dot, fix = lists.rare(doc[part] - i, at[part], tf[part], m)
            rest = features(i, m)
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.minimum(1.0, np.nan_to_num(dot / lists.norm / low[i : i + m, None], posinf=1.0) + lists.rest)
            open_ = np.flatnonzero((rest + w_text * most + NEAR >= bar).any(axis=1))
            new = np.full(m, -1)
            new[open_] = np.arange(len(open_))
            row = new[doc[part] - i]
            own = row >= 0
            more, more_fix = lists.rest_of(row[own], at[part][own], tf[part][own], len(open_))
            dot, norm = dot[open_] + more, base[i + open_, None] + fix[open_] + more_fix
            sem = np.where(dot > 0, dot / lists.norm / np.sqrt(np.where(norm > 0, norm, 1.0)), 0.0)
            score = rest[open_] + w_text * sem
            r, q = np.nonzero((score + NEAR >= bar) & ((sem > 0) | (not need_text)))
            found = [np.concatenate(x) for x in zip(found, (q, i + open_[r], score[r, q], sem[r, q]), strict=True)]
            i += m
            if len(found[0]) > 4 * (k + SPARE) * lists.n or i == docs.num_rows:
                order = np.lexsort((by_id[found[1]], -np.round(found[2], 9), found[0]))
                q = found[0][order]
                order = order[np.arange(len(order)) - np.searchsorted(q, q) < k + SPARE]
                found = [x[order] for x in found]
                least = np.full(lists.n, np.inf)
                np.minimum.at(least, found[0], found[2])
                bar = np.where(np.bincount(found[0], minlength=lists.n) >= k + SPARE, least, -np.inf)
        return found

    return best


def k_best(queries: DataFrame, store: DataFrame, k: int, w_text: float, other, need_text: bool = False, query_block: int = QUERY_BLOCK, store_block: int = STORE_BLOCK) -> DataFrame:
    """(qid, id, score, semantic, further columns, rank). `other(queries, docs)` gives a function (first, number) -> scores without the text,
    docs x queries; `other.out(queries, docs, q, d)` the further columns of chosen pairs, of types `other.schema`."""
    q, d = vectors(queries, store)
    spark = queries.sparkSession
    q, d = materialize(q, "query-vectors"), materialize(d, "vectors")
    blocks = -(-q.count() // query_block) or 1
    salts = max(-(-d.count() // store_block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    qs = q.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ds = d.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ds = ds.withColumn("_block", C("_block").cast("long"))
    run = tile(k, w_text, other, need_text)
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *d.schema]}
    schema = f"qid {kinds['qid']}, id {kinds['id']}, score double, semantic double, {other.schema}"

    def one(left, right):
        if not left.num_rows or not right.num_rows:  # a block or a part of the store without rows
            q, doc, score, sem = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        else:
            q, doc, score, sem = run(left, right)
        return pa.table({"qid": left["qid"].take(q), "id": right["id"].take(doc), "score": score, "semantic": sem} | other.out(left, right, q, doc))

    found = qs.groupBy("_block", "_salt").cogroup(ds.groupBy("_block", "_salt")).applyInArrow(one, schema)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


class Nothing:
    """No features beside the text."""

    schema = "none int"

    def __call__(self, queries: pa.Table, docs: pa.Table):
        zero = np.zeros((1, queries.num_rows))
        return lambda first, number: np.broadcast_to(zero, (number, queries.num_rows))

    def out(self, queries, docs, q, doc):
        return {"none": pa.nulls(len(q), pa.int32())}


def topk_similar(queries: DataFrame, store: DataFrame, k: int, query_block: int = QUERY_BLOCK, store_block: int = STORE_BLOCK) -> DataFrame:
    """(qid, id, sim, rank): the k stored texts most like each query's; texts that share no word are none of them. queries: qid, text; store: id, text."""
    found = k_best(queries.select("qid", "text"), store.select("id", "text"), k, 1.0, Nothing(), True, query_block, store_block)
    return found.select("qid", "id", C("semantic").alias("sim"), "rank")
