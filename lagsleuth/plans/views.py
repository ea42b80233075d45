"""The given tables seen as spans, requests, progress events and so on; each view also as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str) -> str:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    return (f"(datediff(cast({c} as date), date'1970-01-01') * 86400000000L + hour({c}) * 3600000000L"
            f" + minute({c}) * 60000000L + cast(extract(second from {c}) * 1000000 as bigint))")


def spans(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    e = (table(spark, d, "events") if events is None else events).selectExpr(
        "event_id", "cast(cast(ts as date) as string) run_id",
        "case when cast(ts as date) < date'2024-01-16' then 'reference' else 'current' end arm",
        "case event_type when 'click' then 'cpu' when 'view' then 'preprocess' when 'signup' then 'transport' "
        "when 'error' then 'scheduler' else 'gpu' end stage",
        "case event_type when 'signup' then 'transfer' when 'error' then 'sync_edge' "
        "when 'purchase' then 'gpu_kernel' else 'cpu_launch' end kind",
        "user_id", "cast(user_id as string) cid", "concat('k', user_id % 10) name", "user_id % 4 stream_id",
        f"{micros('ts')} * 1000 start_ns", "cast(round(value * 60) as bigint) * 1000000000L dur_ns",
        "value dur_ms", "cast(get_json_object(props, '$.k') as bigint) k")
    return e.withColumn("end_ns", F.col("start_ns") + F.col("dur_ns"))


SPANS = """spans AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
  CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 'reference' ELSE 'current' END AS arm,
  CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'preprocess' WHEN 'signup' THEN 'transport'
    WHEN 'error' THEN 'scheduler' ELSE 'gpu' END AS stage,
  CASE event_type WHEN 'signup' THEN 'transfer' WHEN 'error' THEN 'sync_edge' WHEN 'purchase' THEN 'gpu_kernel'
    ELSE 'cpu_launch' END AS kind,
  user_id, CAST(user_id AS VARCHAR) AS cid, 'k' || (user_id % 10) AS name, user_id % 4 AS stream_id,
  epoch_us(ts) * 1000 AS start_ns, CAST(round(value * 60) AS BIGINT) * 1000000000 AS dur_ns, value AS dur_ms,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  epoch_us(ts) * 1000 + CAST(round(value * 60) AS BIGINT) * 1000000000 AS end_ns FROM events)"""


DAY_NS = 86400 * 10**9


def requests(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    l = table(spark, d, "lineitem")
    j = l.join(o, l.l_orderkey == o.o_orderkey).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) request_id", "l_orderkey delivery_id",
        "l_linenumber lineno", "date_format(o_orderdate, 'yyyy-MM') block",
        "case when year(o_orderdate) < 1998 then 'reference' else 'current' end arm",
        "case o_orderstatus when 'F' then 'ok' when 'O' then 'timeout' else 'error' end status",
        f"{micros('o_orderdate')} * 1000 start_ns", f"cast(l_quantity as bigint) * {DAY_NS}L total_ns",
        "l_quantity total", "l_returnflag", "l_linestatus clock_domain", "o_orderpriority priority",
        "l_discount server", "l_tax cuda", "o_custkey client", "l_suppkey server_id", "l_extendedprice price")
    return j.selectExpr(
        "*", "case when status = 'error' and l_returnflag = 'N' then null else start_ns + total_ns end finish_ns",
        f"case when priority = '4-NOT SPECIFIED' then null else start_ns + 30 * {DAY_NS}L end deadline_ns")


REQUESTS = f"""req0 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id,
  l_orderkey AS delivery_id, l_linenumber AS lineno, strftime(o_orderdate, '%Y-%m') AS block,
  CASE WHEN year(o_orderdate) < 1998 THEN 'reference' ELSE 'current' END AS arm,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'timeout' ELSE 'error' END AS status,
  epoch_us(o_orderdate) * 1000 AS start_ns, CAST(l_quantity AS BIGINT) * {DAY_NS} AS total_ns, l_quantity AS total,
  l_returnflag, l_linestatus AS clock_domain, o_orderpriority AS priority, l_discount AS server, l_tax AS cuda,
  o_custkey AS client, l_suppkey AS server_id, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
requests AS (SELECT *, CASE WHEN status = 'error' AND l_returnflag = 'N' THEN NULL ELSE start_ns + total_ns END AS finish_ns,
  CASE WHEN priority = '4-NOT SPECIFIED' THEN NULL ELSE start_ns + 30 * {DAY_NS} END AS deadline_ns FROM req0)"""


def progress(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    return (table(spark, d, "events") if events is None else events).selectExpr(
        "event_id rid", "concat('s', user_id % 7) source", "event_id sequence", "concat('c', user_id % 2) clock",
        f"{micros('ts')} time", "cast(value as bigint) * 1000000 uncertainty",
        "case event_type when 'click' then 'queue_enqueue' when 'view' then 'queue_dequeue' when 'signup' then 'release' "
        "when 'purchase' then 'submit' else 'recovery' end boundary",
        "cast(user_id as string) identity", "event_id % 3 token", "event_id % 17 <> 0 complete", "value",
        "cast(get_json_object(props, '$.k') as bigint) k")


PROGRESS = """progress AS (SELECT event_id AS rid, 's' || (user_id % 7) AS source, event_id AS sequence,
  'c' || (user_id % 2) AS clock, epoch_us(ts) AS time, CAST(trunc(value) AS BIGINT) * 1000000 AS uncertainty,
  CASE event_type WHEN 'click' THEN 'queue_enqueue' WHEN 'view' THEN 'queue_dequeue' WHEN 'signup' THEN 'release'
    WHEN 'purchase' THEN 'submit' ELSE 'recovery' END AS boundary,
  CAST(user_id AS VARCHAR) AS identity, event_id % 3 AS token, event_id % 17 <> 0 AS complete, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def population(spark: SparkSession, d: str) -> DataFrame:
    """Screening rows: the text is the record's identity, so exact copies are natural duplicates."""
    doc = table(spark, d, "documents")
    return doc.join(table(spark, d, "labels"), "doc_id", "left").selectExpr(
        "doc_id idx", "md5(text) id", "lang lane", "source owner", "n_chars",
        "case quality when 1 then ' high' when 0 then 'MEDIUM ' end label", "toxic",
        "case when toxic = 1 then 'DROP' when quality = 1 then 'KEEP' when quality = 0 then 'RETRIEVAL_FAILED' end outcome")


POPULATION = """population AS (SELECT d.doc_id AS idx, md5(d.text) AS id, lang AS lane, source AS owner, n_chars,
  CASE quality WHEN 1 THEN ' high' WHEN 0 THEN 'MEDIUM ' END AS label, toxic,
  CASE WHEN toxic = 1 THEN 'DROP' WHEN quality = 1 THEN 'KEEP' WHEN quality = 0 THEN 'RETRIEVAL_FAILED' END AS outcome
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
