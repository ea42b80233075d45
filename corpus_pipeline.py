"""From raw documents to token ids: the stages in order, each over all that its predecessor kept.

Toxic documents go; lines that are like an earlier line go, and with them documents of which no word is left; of each group of
near-duplicates (five-word shingles, similarity 0.8) the first document stays; documents with a benchmark passage go; what is left is encoded.
All stages but the last return the columns of documents; n_chars follows the text.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from lagsleuth.llm import bpe, decontaminate, line_dups, near_dups, toxicity
from lagsleuth.llm.queries import CATEGORIES, RANKS, toxicity_chain
from lagsleuth.operators.storage import shared_dir


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, toxicity_chain(spark, sf_dir), CATEGORIES[-1])


def drop_repeated_lines(spark, docs, sf_dir):
    """Rows that share an id are told apart by their texts."""
    lost = F.col("n_removed") > 0
    cleaned = line_dups.remove_similar_lines(docs, digest=True).select("doc_id", "sha256", F.when(lost, F.col("kept")).alias("kept"), (~lost | (F.col("n_lines") > F.col("n_removed"))).alias("some"))
    once = cleaned.where("kept is not null or not some").groupBy("doc_id", "sha256").agg(F.first("kept").alias("kept"), F.first("some").alias("some"))
    joined = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).join(once, ["doc_id", "sha256"], "left").where(F.coalesce("some", F.lit(True)))
    changed = joined.withColumn("text", F.coalesce("kept", "text")).withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")))
    return changed.select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    return near_dups.drop_near_duplicates(docs)


def drop_benchmark(spark, docs, sf_dir):
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_ids(spark, docs, sf_dir):
    coded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("byte_bpe", encode_ids)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
