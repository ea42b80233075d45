"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the words and word beginnings (four to six bytes) that a text
has; a later model also sees the probabilities of the earlier categories. While training, those come from models that have not
seen the row (three folds by a hash of the id), as they will be when new texts are scored. The same out-of-fold probabilities set
each category's threshold (best F1).

Fitted on a bounded sample of labelled rows (`train_rows`, in the order of a hash of the id; a documented parameter); of near
copies in the sample, found by two minima of hashed word runs, one counts. Features: those in at least `least` sample texts, the `features`
best by chi-square over any category. Scoring passes all documents once, whole texts, nothing is shuffled; the model sent to the
tasks has a fixed largest size.

Cases: null texts count as empty; rows with a null id are scored too; labels with a null category, and labels without a document,
are left out; repeated documents are scored each; with no labelled rows, or one class only, the probability is the smoothed share;
further columns are kept, one with an output's name is replaced; empty tables give empty results.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagsleuth.operators.storage import materialize

from .common import add_columns, claim, hashed_words, mix, slices, text_bytes
from .decontaminate import words_of

TRAIN_ROWS = 10_000
FEATURES = 2048
LEAST = 4
FOLDS = 3
BEGINNINGS = (4, 5, 6)


def marks(text: bytes) -> set[bytes]:
    """Distinct words (=word) and word beginnings (^begin) of a text."""
    words = set(words_of(text))
    return {b"=" + w for w in words}.union(*({b"^" + w[:n] for w in words if len(w) >= n} for n in BEGINNINGS))


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str, text: str, train_rows: int) -> DataFrame:
    """id, text, the categories as 0/1, fold: at most train_rows rows, without near copies."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"y_{c}") for c in categories]).dropna()
    known = known.groupBy("id").agg(*[F.max(f"y_{c}").alias(f"y_{c}") for c in categories]).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "id")

    def minima(b: pa.RecordBatch):
        out = []
        for t in text_bytes(b.column("text")):
            h = hashed_words(t.lower().split())
            runs = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else mix(h)
            out.append([int(mix(runs + np.uint64(k)).min().view(np.int64)) if len(runs) else 0 for k in (1, 2)])
        return [[m[0] for m in out], [m[1] for m in out]]

    rows = materialize(add_columns(rows, "m1 long, m2 long", minima), "sample")
    for m in ("m1", "m2"):
        rows = rows.join(rows.groupBy(m).agg(F.min("id").alias("id")).select("id").distinct(), "id", "left_semi")
    return materialize(rows.drop("m1", "m2").dropDuplicates(["id"]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS))), "train")


def choose(rows: DataFrame, categories: list[str], least: int, features: int) -> list[str]:
    """The marks that tell most about any category, as latin-1 strings of their bytes."""
    ys = [f"y_{c}" for c in categories]

    def run(batches):
        claim(__name__)
        for b in (piece for whole in batches for piece in slices(whole)):
            n, hits = Counter(), [Counter() for _ in ys]
            values = [b.column(y).to_pylist() for y in ys]
            for i, t in enumerate(text_bytes(b.column("text"))):
                m = marks(t)
                n.update(m)
                for h, v in zip(hits, values, strict=True):
                    if v[i]:
                        h.update(m)
            yield pa.RecordBatch.from_arrays([pa.array([m.decode("latin-1") for m in n]), pa.array(list(n.values()), pa.int64()), *[pa.array([h[m] for m in n], pa.int64()) for h in hits]],
                                             names=["mark", "n", *ys])

    total, *ones = rows.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
    if not total:
        return []
    count = rows.select("text", *ys).mapInArrow(run, "mark string, n long" + "".join(f", {y} long" for y in ys)).groupBy("mark").agg(*[F.sum(c).alias(c) for c in ("n", *ys)])
    best = F.greatest(*[chi(F.col(y), F.col("n"), k, total) for y, k in zip(ys, ones, strict=True)], F.lit(0.0))
    return [r.mark for r in count.where(F.col("n") >= least).select("mark", best.alias("best")).where("best > 11").orderBy(F.desc("best"), "mark").limit(features).collect()]


def chi(hits, n, ones, total):
    """Chi-square with one degree of freedom of mark against category."""
    top = F.pow(hits * F.lit(float(total)) - n * F.lit(float(ones)), F.lit(2.0)) * F.lit(1.0 / total)
    under = n * (F.lit(float(total)) - n) * F.lit(ones * (total - ones) / total)
    return F.when(under > 0, top * F.lit(float(total)) / under).otherwise(F.lit(0.0))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 score, in the middle (of the logits) between the two probabilities that it parts."""
    order = np.argsort(-p, kind="stable")
    p, hits = np.clip(p[order], 1e-9, 1 - 1e-9), np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(f1.argmax())
    z = np.log(p / (1 - p))
    return float(1 / (1 + np.exp(-(z[k] + z[k + 1]) / 2))) if k + 1 < len(p) else float(p[k]) / 2


class Chain:
    """Intercept, weight of each mark, weight of each earlier category's probability, and threshold, by category."""

    def __init__(self, categories):
        self.categories, self.parts, self.thresholds = categories, [], []

    def add(self, intercept: float, weights: dict[bytes, float], earlier: list[float], threshold: float):
        self.parts.append((intercept, weights, earlier))
        self.thresholds.append(threshold)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, a column for each category."""
        out = np.zeros((len(texts), len(self.parts)))
        known = set().union(*(w for _, w, _ in self.parts))
        for i, t in enumerate(texts):
            found = known & marks(t) if known else ()
            for j, (intercept, weights, earlier) in enumerate(self.parts):
                z = intercept + sum(weights.get(m, 0.0) for m in sorted(found)) + sum(w * p for w, p in zip(earlier, out[i], strict=False))
                out[i, j] = 1 / (1 + np.exp(-z))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, features: int = FEATURES, least: int = LEAST) -> Chain:
    rows = sample(docs, labels, categories, doc_id, text, train_rows)
    names = choose(rows, categories, least, features)
    chain = Chain(categories)
    wanted = {m.encode("latin-1") for m in names}

    def fn(b: pa.RecordBatch):
        return [[[m.decode("latin-1") for m in wanted & marks(t)] for t in text_bytes(b.column("text"))]]

    table = add_columns(rows, "marks array<string>", fn).drop("text")
    if names:
        table = CountVectorizerModel.from_vocabulary(names, "marks", "x").setBinary(True).transform(table)
    table = materialize(table.drop("marks"), "train-matrix").persist()
    earlier: list[str] = []
    for j, c in enumerate(categories):
        y = f"y_{c}"
        n, ones = table.agg(F.count("*"), F.sum(y)).first()
        if not names or not ones or ones == n:
            p = ((ones or 0) + 1) / (n + 2)
            chain.add(float(np.log(p / (1 - p))), {}, [0.0] * j, 0.5)
            table = table.withColumn(f"p_{c}", F.lit(p))
            earlier.append(f"p_{c}")
            continue
        ready = VectorAssembler(inputCols=["x", *earlier], outputCol="all").transform(table)
        learner = LogisticRegression(featuresCol="all", labelCol=y, regParam=1e-3, maxIter=60, rawPredictionCol="raw", probabilityCol="prob", predictionCol="guess")
        model = learner.fit(ready)
        w = model.coefficients.toArray()
        folds = [learner.fit(ready.where(F.col("fold") != k)).transform(ready.where(F.col("fold") == k)).withColumn(f"p_{c}", vector_to_array("prob")[1]) for k in range(FOLDS)]
        out = folds[0]
        for f in folds[1:]:
            out = out.union(f)
        old = table
        table = materialize(out.drop("all", "raw", "prob", "guess"), "train-matrix").persist()
        unseen = np.array(table.select(f"p_{c}", y).collect(), float)
        old.unpersist()
        earlier.append(f"p_{c}")
        chain.add(float(model.intercept), {m.encode("latin-1"): float(v) for m, v in zip(names, w[: len(names)], strict=True) if v}, [float(v) for v in w[len(names) :]], best_threshold(unseen[:, 0], unseen[:, 1]))
    table.unpersist()
    return chain


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> for each category."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def fn(b: pa.RecordBatch):
        p = sent.value.score(text_bytes(b.column(text)))
        return [p[:, j] for j in range(p.shape[1])]

    return add_columns(docs, ", ".join(f"p_{c} double" for c in chain.categories), fn)


def keep_clean(docs: DataFrame, chain: Chain, category: str, threshold: float | None = None, text: str = "text") -> DataFrame:
    """The documents whose probability is below the threshold (by default the chain's own), with their own columns."""
    if threshold is None:
        threshold = chain.thresholds[chain.categories.index(category)]
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return predict(own, chain).where(F.col(f"p_{category}") < threshold).select("row.*")
