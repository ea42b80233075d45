"""Trace documents, profiler tables and run directories to the long span table."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import kernel_short_name, us_to_ns

C = F.col
# Which event categories go where.
CPU_CATEGORIES = ("cpu_op", "cuda_runtime", "cuda_driver")
KERNEL_CATEGORIES = ("kernel",)
COPY_CATEGORIES = ("gpu_memcpy", "gpu_memset")
SYNC_CATEGORIES = ("cuda_sync",)
# Copy kinds by number.
COPY_KINDS = {0: "unknown", 1: "HtoD", 2: "DtoH", 3: "HtoA", 4: "AtoH", 5: "AtoA", 6: "AtoD", 7: "DtoA", 8: "DtoD", 9: "HtoH", 10: "PtoP"}
TRACE_SCHEMA = ("timing_model_version string, traceEvents array<struct<ph:string, ts:string, dur:string, pid:string, tid:string, name:string, cat:string, id:string, "
                "args:struct<`External id`:string, stream:string, bytes:string>>>, _corrupt string")
RUN_KEY = ("run_id", "hardware", "collector_version")
RUN_REQUIRED = ("run_id", "device", "hardware", "driver", "cuda", "collector_version")


def read_trace_json(spark: SparkSession, path: str, run_id: Column | None = None, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(spans, rejects) from trace documents: one per file, or one per line with ``multiline=False`` (splittable).

    All shards of all runs come from one read; ``run_id`` defaults to the file name. Documents that cannot be parsed are rejects."""
    docs = spark.read.schema(TRACE_SCHEMA).option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    docs = docs.withColumn("run_id", F.input_file_name() if run_id is None else run_id)
    spans, rejects = trace_spans(docs.select("run_id", F.explode("traceEvents").alias("e")).select("run_id", "e.*"))
    broken = docs.where("_corrupt is not null or traceEvents is null").select(
        "run_id", *[F.lit(None).cast("string").alias(c) for c in ("name", "ts", "dur")], F.when(C("_corrupt").isNotNull(), "unreadable document").otherwise("no events").alias("reason"))
    return spans, rejects.unionByName(broken)


def trace_spans(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route raw trace events by category; times in (fractional) microseconds, numbers or text. Other categories are dropped."""
    need = F.lit(False)
    for c in ("ph", "ts", "pid", "tid", "name"):
        need = need | C(c).isNull()
    start, dur = us_to_ns(C("ts")), F.when(C("dur").isNull(), 0).otherwise(us_to_ns(C("dur")))
    bad = F.when(need, "missing required field").when(start.isNull() | dur.isNull(), "bad time")
    e = e.withColumn("reason", bad)
    waits = F.contains(F.lower("name"), F.lit("synchronize"))
    cpu = C("cat").isin(*CPU_CATEGORIES)
    kind = (F.when(cpu & ~waits, "cpu_launch").when(C("cat").isin(*KERNEL_CATEGORIES), "gpu_kernel").when(C("cat").isin(*COPY_CATEGORIES), "transfer")
            .when(C("cat").isin(*SYNC_CATEGORIES) | cpu, "sync_edge"))
    ok = e.where("reason is null and ph = 'X'").withColumn("kind", kind).where("kind is not null")
    dev = C("kind").isin("gpu_kernel", "transfer")
    spans = ok.select(
        "run_id", "kind", F.coalesce(C("args")["External id"], C("id"), F.lit("")).alias("cid"), "name",
        F.when(C("kind") == "gpu_kernel", kernel_short_name(C("name"))).alias("kernel_name"), "pid", "tid", F.when(dev, C("pid")).alias("device_id"),
        F.when(dev, C("tid")).otherwise(F.coalesce(C("args.stream"), C("tid"))).alias("stream_id"), start.alias("start_ns"), (start + dur).alias("end_ns"), dur.alias("dur_ns"),
        F.when(C("kind") == "sync_edge", dur).alias("blocked_ns"), C("args.bytes").try_cast("long").alias("bytes"))
    return spans, e.where("reason is not null").select("run_id", "name", "ts", "dur", "reason")


def merge_shards(spans: DataFrame, run_of_shard: Column) -> DataFrame:
    """Shards of a run become one run. Nothing is derived per shard, so overlap across seams is counted like any other."""
    return spans.withColumn("shard", C("run_id")).withColumn("run_id", run_of_shard)


def normalize_cupti(kernel: DataFrame, memcpy: DataFrame, runtime: DataFrame, sync: DataFrame, strings: DataFrame) -> DataFrame:
    """Profiler tables (correlation_id, start, end, name ids or text, copy_kind, bytes, stream_id) to spans.

    Names resolve through ``strings`` (id, value): kernels by name_id, short_name_id, then demangled_id; rows without a
    correlation id are dropped. Unions of several kernel or runtime tables are the caller's ``unionByName``."""
    s = lambda tag: strings.select(C("id").alias(f"{tag}_id"), C("value").alias(f"{tag}_value"))
    def base(df, kind, name):
        extra = {c: (C(c) if c in df.columns else F.lit(None)) for c in ("bytes", "stream_id")}
        return df.where("correlation_id is not null").select(
            "run_id", F.lit(kind).alias("kind"), C("correlation_id").cast("string").alias("cid"), name.alias("name"), C("start").alias("start_ns"), C("end").alias("end_ns"),
            (C("end") - C("start")).alias("dur_ns"), extra["bytes"].cast("long").alias("bytes"), extra["stream_id"].cast("long").alias("stream_id"))
    k = kernel.join(s("name"), "name_id", "left").join(s("short_name"), "short_name_id", "left").join(s("demangled"), "demangled_id", "left")
    r = runtime.join(s("name"), "name_id", "left")
    copy = F.coalesce(F.create_map(*[F.lit(x) for kv in COPY_KINDS.items() for x in kv])[C("copy_kind")], F.concat(F.lit("kind_"), C("copy_kind").cast("string")))
    return (base(k, "gpu_kernel", F.coalesce("name_value", "short_name_value", "demangled_value", F.lit("")))
            .unionByName(base(memcpy, "transfer", copy)).unionByName(base(r, "cpu_launch", F.coalesce("name_value", F.lit("")))).unionByName(base(sync, "sync_edge", F.lit("synchronize"))))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, length) of every file below root; each file is hashed where it is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", F.sha2("content", 256).alias("sha256"), "length"))


def done_flags(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the DONE flags below root. Flags may be empty and readers skip empty files, so the file listing itself is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "DONE").load(root).inputFiles()
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", p),) for p in found], "path string")


def verify_checksums(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing file, or not in the inventory (path, expected)."""
    j = files.select("path", "sha256").join(inventory, "path", "full")
    return j.select("path", F.when(C("sha256").isNull(), "missing").when(C("expected").isNull(), "unlisted").when(C("sha256") == C("expected"), "ok").otherwise("changed").alias("status"))


def scan_runs(files: DataFrame, manifests: DataFrame, done: DataFrame) -> DataFrame:
    """Manifests with ``verified``: a DONE flag exists and every listed artifact has its digest.
    files: path, sha256; manifests: run_id, dir, sha256 map<name, digest>, and more; done: path."""
    want = manifests.select("run_id", "dir", F.explode_outer("sha256").alias("name", "expected"))
    f = files.select(C("path"), C("sha256").alias("digest"))
    got = want.withColumn("path", F.concat_ws("/", "dir", "name")).join(f, "path", "left").groupBy("run_id", "dir").agg(
        F.bool_and(C("name").isNull() | F.coalesce(C("digest") == C("expected"), F.lit(False))).alias("whole"))
    done = done.select(C("path").alias("done_path")).distinct()
    j = manifests.join(got, ["run_id", "dir"], "left").withColumn("done_path", F.concat_ws("/", "dir", F.lit("DONE"))).join(done.withColumn("has_done", F.lit(True)), "done_path", "left")
    return j.withColumn("verified", F.coalesce("has_done", F.lit(False)) & F.coalesce("whole", F.lit(False))).drop("done_path", "has_done", "whole")


def ingest_runs(new: DataFrame, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejects with reason). Idempotent by (run_id, hardware, collector_version); incomplete identities are
    rejected and never pooled. Copies inside the batch count once (the first seq)."""
    why = F.array_compact(F.array(*[F.when(F.coalesce(C(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in RUN_REQUIRED]))
    r = new.withColumn("missing", why)
    ok = r.where(F.size("missing") == 0).drop("missing").join(dataset.select(*RUN_KEY).distinct(), list(RUN_KEY), "left_anti")
    cols = [c for c in ok.columns if c not in RUN_KEY]
    first = ok.groupBy(*RUN_KEY).agg(F.min_by(F.struct(*cols), "seq").alias("r")).select(*RUN_KEY, "r.*")
    return first, r.where(F.size("missing") > 0).withColumn("reason", F.concat(F.lit("manifest missing "), F.concat_ws(",", "missing"))).drop("missing")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only sink for datasets, summaries and logs."""
    df.write.mode("append").format(fmt).save(path)
