"""Sampling, sharding, screening, audit and mining queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stamp
from ..operators import audit as A, validate as V
from ..operators.storage import materialize
from .q_compare import NAMED_Z, named_z
from .registry import query
from .views import POPULATION, SPANS, population, spans, table

C = F.col


@query("D4", "first_wins", f"WITH {POPULATION}, f AS (SELECT id, min(idx) AS f FROM population GROUP BY id) SELECT idx, id, idx = f AS kept FROM population JOIN f USING (id)")
def _(spark, d):
    p = population(spark, d).withColumn("alt", F.lit("")).select("alt", "id", "idx")
    k, dup, _n = A.first_wins(p, "idx", ["alt", "id"])
    return k.select("idx", "id", F.lit(True).alias("kept")).unionByName(dup.select("idx", "id", F.lit(False).alias("kept")))


@query("P10", "screen_rows", f"""WITH {POPULATION}, o AS (SELECT * FROM population WHERE upper(trim(label)) IN ('HIGH', 'MEDIUM') AND NOT coalesce(toxic = 1, false)) SELECT id, min(idx) AS idx FROM o GROUP BY id""")
def _(spark, d):
    p = population(spark, d).withColumn("result", F.when(C("toxic") == 1, "[{}]").otherwise(" "))
    return A.screen_rows(p, "idx").select("id", "idx")


@query("P10", "screen_rows_allowed", f"WITH {POPULATION} SELECT id, min(idx) AS idx FROM population WHERE id IN (SELECT id FROM population WHERE lane = 'fr') GROUP BY id")
def _(spark, d):
    p = population(spark, d).withColumn("result", F.lit(None).cast("string"))
    return A.screen_rows(p, "idx", p.where("lane = 'fr'").select("id").distinct()).select("id", "idx")


SHARD = f"""{POPULATION}, k AS (SELECT id, min(idx) AS idx FROM population GROUP BY id), sh AS (SELECT id, row_number() OVER (ORDER BY idx) - 1 AS pos, (row_number() OVER (ORDER BY idx) - 1) % 5 + 1 AS shard FROM k)"""


def sharded(spark, d):
    p = A.first_wins(population(spark, d), "idx", ["id"])[0]
    return A.shard_round_robin(materialize(p.select("id", C("idx").alias("src"), "owner", "lane"), "kept"), "src", 5)


@query("T6", "shard_round_robin", f"WITH {SHARD} SELECT id, pos AS idx, shard FROM sh")
def _(spark, d):
    return sharded(spark, d).select("id", "idx", "shard")


@query("T6", "shard_checks", f"WITH {SHARD} SELECT 'ids unique' AS rule, count(*) - count(DISTINCT id) AS violations FROM sh UNION ALL SELECT 'shards disjoint', count(*) - count(DISTINCT (id, shard)) FROM sh UNION ALL SELECT 'shard sizes', CASE WHEN max(c) - min(c) > 1 OR count(*) < 5 THEN 1 ELSE 0 END FROM (SELECT count(*) AS c FROM sh GROUP BY shard)")
def _(spark, d):
    return A.shard_checks(sharded(spark, d), "id", 5)


@query("T4", "systematic_sample", """WITH p AS (SELECT l_suppkey AS g, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS o FROM lineitem WHERE NOT (l_linenumber = 1 AND l_returnflag = 'A')), u AS (SELECT DISTINCT g, o FROM p),
r AS (SELECT g, o, row_number() OVER (PARTITION BY g ORDER BY o) AS pos, count(*) OVER (PARTITION BY g) AS n FROM u), w AS (SELECT g, k, round_even(k * (n - 1) / 19.0, 0)::BIGINT + 1 AS pos FROM (SELECT DISTINCT g, n FROM r WHERE n >= 20) CROSS JOIN (SELECT unnest(range(20)) AS k)),
j AS (SELECT w.g, k, o FROM w JOIN r USING (g, pos)) SELECT g, k::INT AS k, o, (row_number() OVER (ORDER BY g, k) - 1) % 4 = 0 AS smoke FROM j""")
def _(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_suppkey g", "l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 o", "l_linenumber = 1 and l_returnflag = 'A' held")
    hold = l.where("held").select("g", "o")
    return A.systematic_sample(materialize(l.select("g", "o").distinct(), "frames"), "g", "o", 20, hold.distinct())[0].select("g", "k", "o", "smoke")


@query("P12", "validate_corpus", """WITH f AS (SELECT conv_id AS ep, turn AS fr, row_number() OVER (ORDER BY conv_id, turn) AS r0 FROM conversations),
g AS (SELECT *, CASE WHEN ep % 13 = 0 THEN 'ep' || ep || '_fr0' ELSE 'ep' || ep || '_fr' || fr END AS id, CASE WHEN fr = 2 THEN r0 + 1.5 ELSE r0 END AS row FROM f), n AS (SELECT *, row_number() OVER (ORDER BY row) AS i, lag((ep, fr)) OVER (ORDER BY row) AS p FROM g)
SELECT 'ids unique' AS rule, count(*) AS violations FROM (SELECT id FROM g GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'id matches position', count(*) FILTER (id <> 'ep' || ep || '_fr' || fr) FROM g
UNION ALL SELECT 'sorted', count(*) FILTER (p > (ep, fr)) FROM n UNION ALL SELECT 'rows per group', count(*) FROM (SELECT ep FROM g GROUP BY ep HAVING count(*) <> 4)
UNION ALL SELECT 'disjoint from holdout', count(*) FILTER (fr = 0 AND ep % 10 = 0) FROM g
UNION ALL SELECT 'sample every m-th', (SELECT count(*) FROM (SELECT id FROM n WHERE (i - 1) % 4 = 0) a FULL JOIN (SELECT id FROM g WHERE (r0 - 1) % 4 = 0) b USING (id) WHERE a.id IS NULL OR b.id IS NULL)""")
def _(spark, d):
    from ..operators.ordered import scan
    c = table(spark, d, "conversations").selectExpr("conv_id ep", "turn fr")
    r = scan(c, [], ["ep", "fr"], r0=("sum", F.lit(1)))
    true_id = F.concat(F.lit("ep"), C("ep").cast("string"), F.lit("_fr"), C("fr").cast("string"))
    g = materialize(r.withColumns({"id": F.when(C("ep") % 13 == 0, F.concat(F.lit("ep"), C("ep").cast("string"), F.lit("_fr0"))).otherwise(true_id),
                                   "row": F.when(C("fr") == 2, C("r0") + 1.5).otherwise(C("r0"))}), "corpus")
    return A.validate_corpus(g, "ep", "fr", "id", true_id, 4, g.where("fr = 0 and ep % 10 = 0").select("ep", "fr"), g.where("(r0 - 1) % 4 = 0"))


@query("J9", "resolve_ids", r"""WITH m AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS clean, '10.' || (1000 + page_id % 120) || '/p' || page_id % 150 || '.' AS doi, CASE WHEN page_id % 5 = 0 THEN '' ELSE '19' || lpad(CAST(page_id % 90 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id % 170 AS VARCHAR), 5, '0') END AS ax FROM pages),
mk AS (SELECT page_id, unnest([lower(trim(clean)), 'doi:' || lower(trim(doi, '.')), lower(doi), CASE WHEN ax <> '' THEN 'arxiv:' || ax END, CASE WHEN ax <> '' THEN ax END]) AS k FROM m),
i AS (SELECT 'https://arxiv.org/abs/' || ax || 'v1 see ' || doi AS id, [lower('https://arxiv.org/abs/' || ax || 'v1 see ' || doi), 'doi:' || lower(trim(doi, '.')), CASE WHEN ax <> '' THEN 'arxiv:' || ax END] AS ks FROM m WHERE page_id % 2 = 0 UNION SELECT clean, [lower(clean)] FROM m WHERE page_id % 2 = 1),
j AS (SELECT DISTINCT id, page_id FROM (SELECT id, unnest(ks) AS k FROM i) JOIN mk USING (k)) SELECT id, min(page_id) AS master FROM j GROUP BY id HAVING count(*) = 1""")
def _(spark, d):
    m = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("clean"), F.expr("concat('10.', 1000 + page_id % 120, '/p', page_id % 150, '.')").alias("doi"),
                                        F.expr("case when page_id % 5 = 0 then '' else concat('19', lpad(cast(page_id % 90 as string), 2, '0'), '.', lpad(cast(page_id % 170 as string), 5, '0')) end").alias("ax"))
    ids = m.where("page_id % 2 = 0").select(F.concat(F.lit("https://arxiv.org/abs/"), "ax", F.lit("v1 see "), "doi").alias("id")).union(m.where("page_id % 2 = 1").select("clean"))
    return A.resolve_ids(ids, m, ["clean", "doi", "ax"], "page_id", "id")


@query("J10", "upsert_if_blank", f"""WITH {POPULATION}, m AS (SELECT idx, id, CASE WHEN toxic = 1 THEN 'old' ELSE ' ' END AS result FROM population), r AS (SELECT id, arg_min(owner, idx) AS new FROM population WHERE n_chars > 300 AND lane <> 'de' GROUP BY id)
SELECT idx, CASE WHEN trim(result) = '' AND new IS NOT NULL THEN new ELSE result END AS result, trim(result) = '' AND new IS NOT NULL AS written FROM m LEFT JOIN r USING (id)""")
def _(spark, d):
    p = population(spark, d)
    m = p.select("idx", "id", F.when(C("toxic") == 1, "old").otherwise(" ").alias("result"))
    r = p.where("n_chars > 300 and lane <> 'de'").select("id", C("owner").alias("result"), C("idx").alias("seq"))
    return A.upsert_if_blank(m, r, p.where("lane <> 'de'").select("id"), "id").select("idx", "result", "written")


AUD = f"""{SHARD}, mf AS (SELECT id, shard AS agent FROM sh), lg AS (SELECT id, CASE WHEN n_chars % 50 = 0 THEN 9 ELSE coalesce(agent, 1) END AS worker FROM population LEFT JOIN mf USING (id) WHERE n_chars % 40 <> 0),
ob AS (SELECT id, CASE WHEN n_chars % 60 = 0 THEN 9 ELSE coalesce(agent, 1) END AS worker, outcome FROM population LEFT JOIN mf USING (id) WHERE outcome IS NOT NULL)"""


def audit_tables(spark, d):
    m = materialize(sharded(spark, d).select("id", C("shard").alias("agent")), "manifest")
    # Logs and objects are read four times: what they are made of is stored, so that texts and labels are read and joined once.
    p = materialize(population(spark, d).join(m, "id", "left").select("id", "n_chars", "outcome", "agent"), "records")
    lg = p.where("n_chars % 40 <> 0").select("id", F.when(C("n_chars") % 50 == 0, 9).otherwise(F.coalesce("agent", F.lit(1))).alias("worker"))
    ob = p.where("outcome is not null").select("id", F.when(C("n_chars") % 60 == 0, 9).otherwise(F.coalesce("agent", F.lit(1))).alias("worker"), "outcome")
    return m, lg, ob


@query("D5", "audit_population", f"""WITH {AUD}, o AS (SELECT mf.id, count(outcome) AS n, count(*) FILTER (outcome = 'KEEP') AS kept, count(*) FILTER (outcome IN ('DROP', 'RETRIEVAL_FAILED')) AS term FROM mf LEFT JOIN ob USING (id) GROUP BY mf.id)
SELECT id, 'log outside population' AS violation, count(*) AS n FROM lg ANTI JOIN mf USING (id) GROUP BY id UNION ALL SELECT id, 'log ownership', count(*) FROM lg JOIN mf USING (id) WHERE worker <> agent GROUP BY id
UNION ALL SELECT id, 'object outside population', count(*) FROM ob ANTI JOIN mf USING (id) GROUP BY id UNION ALL SELECT id, 'object ownership', count(*) FROM ob JOIN mf USING (id) WHERE worker <> agent GROUP BY id
UNION ALL SELECT mf.id, CASE WHEN count(worker) = 0 THEN 'never processed' ELSE 'processed more than once' END, count(worker) FROM mf LEFT JOIN lg USING (id) GROUP BY mf.id HAVING count(worker) <> 1
UNION ALL SELECT id, 'not exactly one terminal outcome', n FROM o WHERE NOT ((kept > 0) <> (term = 1) AND NOT (term > 0 AND n <> 1))""")
def _(spark, d):
    return A.audit_population(*audit_tables(spark, d))


@query("A17", "screening_counts", f"""WITH {POPULATION} SELECT lane, count(*) FILTER (outcome = 'KEEP') AS mechanisms, 0 AS "GEM", count(*) FILTER (outcome = 'KEEP') AS "KEEP", 0 AS "RESERVE", 0 AS "NEEDS_DEEP_REVIEW", count(*) FILTER (outcome = 'DROP') AS "DROP",
 count(*) FILTER (outcome = 'RETRIEVAL_FAILED') AS "RETRIEVAL_FAILED" FROM population GROUP BY lane""")
def _(spark, d):
    return A.screening_counts(population(spark, d), ["lane"])


@query("P11", "validate_records", f"""WITH {POPULATION} SELECT idx, concat_ws(';', CASE WHEN n_chars % 11 = 0 THEN 'wrong id' END, CASE WHEN outcome = 'DROP' AND n_chars % 5 = 0 THEN 'terminal fields' END, CASE WHEN outcome IS DISTINCT FROM 'DROP' AND n_chars % 7 = 0 THEN 'classification' END,
 CASE WHEN outcome IS DISTINCT FROM 'DROP' AND lane = 'de' THEN 'lanes' END, CASE WHEN outcome IS DISTINCT FROM 'DROP' AND n_chars % 5 NOT IN (1, 2, 3) THEN 'passages' END,
 CASE WHEN coalesce(outcome, 'RETRIEVAL_FAILED') = 'RETRIEVAL_FAILED' AND n_chars % 7 > 0 AND n_chars % 3 = 0 THEN 'question missing' END, CASE WHEN outcome = 'KEEP' AND n_chars % 7 > 0 AND n_chars % 3 > 0 THEN 'question not null' WHEN outcome IS DISTINCT FROM 'DROP' AND n_chars % 7 = 0 AND n_chars % 3 > 0 THEN 'question not null' END) AS reasons
FROM population""")
def _(spark, d):
    p = population(spark, d).selectExpr(
        "idx", "id paper_id", "if(n_chars % 11 = 0, 'x', id) expected_id", "if(outcome = 'DROP', 'DROP', null) terminal_outcome",
        "if(n_chars % 5 = 0, array('paper_id', 'note'), array('terminal_outcome', 'paper_title', 'paper_id', 'reason')) fields",
        "if(n_chars % 7 = 0, 'GREAT', if(outcome = 'KEEP', 'KEEP', 'NEEDS_DEEP_REVIEW')) classification", "if(lane = 'de', 'B3', 'A7') primary_lane", "array('A1', 'A15') supporting_lanes",
        "array_repeat(named_struct('text', 't', 'source_location', 'p1'), cast(n_chars % 5 as int)) passages", "if(n_chars % 3 = 0, null, 'why') unresolved_question")
    return V.with_reasons(p, A.RECORD_RULES).select("idx", F.concat_ws(";", "reasons").alias("reasons"))


CAND = """c AS (SELECT p_partkey AS id, p_brand AS coverage, p_type AS preserve, p_size & 7 AS mask, p_retailprice AS seconds, (p_size * 10)::DOUBLE AS bytes, (p_partkey % 97)::DOUBLE AS pert FROM part)"""


@query("T8", "pareto_actions", f"""WITH {CAND} SELECT id, seconds, bytes FROM c a WHERE NOT EXISTS (FROM c b WHERE b.coverage = a.coverage AND b.preserve = a.preserve AND (b.mask & a.mask) = a.mask AND b.seconds <= a.seconds AND b.bytes <= a.bytes AND b.pert <= a.pert
 AND (b.mask <> a.mask OR b.seconds < a.seconds OR b.bytes < a.bytes OR b.pert < a.pert))""")
def _(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey id", "p_brand coverage", "p_type preserve", "cast(p_size & 7 as bigint) mask", "p_retailprice seconds", "cast(p_size * 10 as double) bytes", "cast(p_partkey % 97 as double) pert")
    return A.pareto_actions(p, ["seconds", "bytes", "pert"], ["coverage", "preserve"], "mask").select("id", "seconds", "bytes")


@query("D1", "coverage_gaps", """SELECT DISTINCT p_brand AS fault, n_name AS hardware FROM (SELECT DISTINCT p_brand FROM part), (SELECT n_name FROM nation) EXCEPT SELECT p_brand, n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 47""")
def _(spark, d):
    n = table(spark, d, "nation")
    names = n.agg(F.collect_set("n_name").alias("a")).scalar()
    target = table(spark, d, "part").select("p_brand").distinct().select(C("p_brand").alias("fault"), F.explode(names).alias("hardware"))
    r = (table(spark, d, "lineitem").where("l_quantity > 47").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
         .join(n, F.expr("s_nationkey = n_nationkey")).select(C("p_brand").alias("fault"), C("n_name").alias("hardware")))
    return A.coverage_gaps(target, r, ["fault", "hardware"])


@query("D2", "todo", """WITH r AS (SELECT o_custkey % 40 AS cell, o_orderpriority AS fault, o_orderstatus = 'F' AND o_totalprice > 250000 AND o_custkey % 3 = 0 AS verified FROM orders)
SELECT cell, fault FROM (SELECT DISTINCT cell FROM r) CROSS JOIN (SELECT DISTINCT fault FROM r) EXCEPT SELECT cell, fault FROM r WHERE verified""")
def _(spark, d):
    r = table(spark, d, "orders").selectExpr("o_custkey % 40 cell", "o_orderpriority fault", "o_orderstatus = 'F' and o_totalprice > 250000 and o_custkey % 3 = 0 verified")
    faults = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    m = r.select("cell").distinct().select("cell", F.explode(F.array(*[F.lit(f) for f in faults])).alias("fault"))
    return A.todo(m, r, ["cell", "fault"])


RUN = """rn AS (SELECT o_orderkey AS run_id, o_custkey AS workload, month(o_orderdate) % 3 AS seed, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS hardware, CASE WHEN o_orderstatus = 'F' THEN 'healthy' ELSE o_orderstatus END AS fault FROM orders)"""


def run_rows(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey run_id", "o_custkey workload", "month(o_orderdate) % 3 seed", "case when o_orderpriority = '5-LOW' then 'unknown' when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderpriority end hardware",
                                                "case when o_orderstatus = 'F' then 'healthy' else o_orderstatus end fault")


@query("J2", "pair_runs", f"""WITH {RUN}, l AS (SELECT workload, seed, hardware, fault, max(run_id) AS run_id FROM rn WHERE coalesce(hardware, 'unknown') <> 'unknown' GROUP BY ALL)
SELECT f.run_id, h.run_id AS healthy_id FROM l f JOIN l h ON f.workload = h.workload AND f.seed = h.seed AND f.hardware = h.hardware AND h.fault = 'healthy' AND f.fault <> 'healthy'""")
def _(spark, d):
    return A.pair_runs(run_rows(spark, d), ["workload", "seed"], "hardware", "run_id").select("run_id", "healthy_id")


@query("J3", "match_baseline", f"""WITH {RUN}, h AS (SELECT * FROM rn WHERE fault = 'healthy'), f AS (SELECT * FROM rn WHERE fault <> 'healthy')
SELECT f.run_id, h.run_id AS baseline, CASE WHEN h.run_id IS NULL THEN 'all' ELSE 'cell' END AS pool FROM f LEFT JOIN h ON f.workload = h.workload AND f.seed = h.seed AND f.hardware = h.hardware""")
def _(spark, d):
    r = run_rows(spark, d)
    return A.match_baseline(r.where("fault <> 'healthy'"), r.where("fault = 'healthy'"), ["workload", "seed", "hardware"]).select("run_id", "baseline", "pool")


@query("J4", "join_client_server", """WITH s AS (SELECT l_orderkey AS k, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS dg FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'F' AND k IS NOT NULL AND dg = CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END) AS joined_ok, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS cuda_covered_ok
FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY o_orderpriority""")
def _(spark, d):
    c = table(spark, d, "orders").selectExpr("o_orderkey k", "o_orderpriority", "if(o_orderstatus = 'F', 'ok', 'x') status", "case o_custkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end dg", "if(o_totalprice > 100000, 1, null) cuda")
    s = table(spark, d, "lineitem").where("l_quantity > 10").selectExpr("l_orderkey k", "l_returnflag dg", "struct(l_linenumber, l_partkey, l_suppkey) seq")
    return A.join_client_server(c, s, "k", "dg", "cuda", ["o_orderpriority"])


RM = """rm AS (SELECT o_orderkey AS run_id, o_custkey, avg(l_quantity) AS host_gap_us, avg(l_discount) * 200 AS blocked_us, bool_or(l_returnflag = 'R' AND l_linenumber = 7) AS serialized, avg(l_extendedprice) / 300 AS kernel_us, avg(l_tax) * 1000 AS bw, 100 - avg(l_discount) * 500 AS sm, avg(l_quantity) * 2 AS tensor, sum(l_linenumber * 10) AS stalls
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
oc AS (SELECT *, CASE WHEN host_gap_us > 20 THEN 'host_hot' ELSE 'host_ok' END AS timeline, CASE WHEN blocked_us > 10 OR serialized THEN 'sched_hot' ELSE 'sched_ok' END AS scheduler_trace, CASE WHEN kernel_us > 130 THEN 'kernel_slow' ELSE 'kernel_ok' END AS kernel_timeline,
 CASE WHEN bw > 50 OR sm < 65 OR tensor < 45 THEN 'pressured' ELSE 'ok' END AS counters, CASE WHEN tensor < 45 THEN 'degraded' ELSE 'ok' END AS tensor_analysis, CASE WHEN stalls > 100 THEN 'stall_hot' ELSE 'stall_ok' END AS deep_profile FROM rm)"""


def run_metrics(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return j.groupBy(C("o_orderkey").alias("run_id"), "o_custkey").agg(
        F.avg("l_quantity").alias("host_gap_us"), (F.avg("l_discount") * 200).alias("blocked_us"), F.bool_or(F.expr("l_returnflag = 'R' and l_linenumber = 7")).alias("serialized"), (F.avg("l_extendedprice") / 300).alias("kernel_us"),
        (F.avg("l_tax") * 1000).alias("bw"), (100 - F.avg("l_discount") * 500).alias("sm"), (F.avg("l_quantity") * 2).alias("tensor"), F.sum(C("l_linenumber") * 10).alias("stalls"))


@query("F13", "outcome_of", f"WITH {RM} SELECT run_id, timeline, scheduler_trace, kernel_timeline, tensor_analysis, deep_profile, counters FROM oc")
def _(spark, d):
    return A.outcome_of(run_metrics(spark, d)).select("run_id", *A.OUTCOME_LABELS)


CNT = f"""{RM}, cz AS (SELECT c_mktsegment AS cause, timeline, scheduler_trace, kernel_timeline, counters, tensor_analysis, deep_profile FROM oc JOIN customer ON o_custkey = c_custkey), u AS (UNPIVOT cz ON timeline, scheduler_trace, kernel_timeline, counters, tensor_analysis, deep_profile INTO NAME action VALUE outcome),
lab AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{o}')" for a, os in {"timeline": ("host_hot", "host_ok"), "scheduler_trace": ("sched_hot", "sched_ok"), "kernel_timeline": ("kernel_slow", "kernel_ok"), "counters": ("pressured", "ok"), "tensor_analysis": ("degraded", "ok"), "deep_profile": ("stall_hot", "stall_ok")}.items() for o in os)}) t(action, outcome)),
cnt AS (SELECT cs.cause, lab.action, lab.outcome, count(u.cause) AS n FROM (SELECT DISTINCT cause FROM u) cs CROSS JOIN lab LEFT JOIN u ON u.cause = cs.cause AND u.action = lab.action AND u.outcome = lab.outcome GROUP BY ALL)"""


def counts(spark, d):
    r = A.outcome_of(run_metrics(spark, d)).join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).withColumn("cause", C("c_mktsegment"))
    return A.outcome_counts(r.select("cause", *A.OUTCOME_LABELS), A.OUTCOME_LABELS)


@query("A18", "outcome_counts", f"WITH {CNT} SELECT * FROM cnt")
def _(spark, d):
    return counts(spark, d)


@query("D8", "report_oracle", f"""WITH {POPULATION}, ln AS (SELECT lane || '/' || owner AS report, idx AS line, CASE WHEN toxic = 1 THEN 'VERIFIED claim ev:' || id WHEN toxic = 0 THEN 'note ev:' || CASE WHEN n_chars % 9 = 0 THEN md5('no' || id) ELSE id END WHEN lane = 'es' THEN 'ABSTAIN' ELSE 'text' END AS text FROM population),
ex AS (SELECT DISTINCT id FROM population WHERE n_chars % 4 > 0), ok AS (SELECT DISTINCT id FROM population WHERE n_chars % 2 = 0 AND n_chars > 500),
i AS (SELECT report, line, regexp_extract(text, 'ev:([0-9a-f]{{32}})', 1) AS id, text FROM ln WHERE text LIKE '%ev:%')
SELECT report, line, 'unknown evidence' AS violation FROM i WHERE id NOT IN (SELECT id FROM ex) UNION SELECT report, line, 'unsupported VERIFIED' FROM i WHERE text LIKE '%VERIFIED%' AND id NOT IN (SELECT id FROM ok)
UNION SELECT report, line, 'claim in abstention' FROM ln WHERE text LIKE '%VERIFIED%' AND report IN (SELECT report FROM ln WHERE text LIKE '%ABSTAIN%')""")
def _(spark, d):
    p = population(spark, d)
    text = (F.when(C("toxic") == 1, F.concat(F.lit("VERIFIED claim ev:"), "id")).when(C("toxic") == 0, F.concat(F.lit("note ev:"), F.when(C("n_chars") % 9 == 0, F.md5(F.concat(F.lit("no"), "id"))).otherwise(C("id"))))
            .when(C("lane") == "es", "ABSTAIN").otherwise("text"))
    lines = p.select(F.concat_ws("/", "lane", "owner").alias("report"), C("idx").alias("line"), text.alias("text"))
    cl = p.select("id", F.lit("VERIFIED").alias("status"), F.when((C("n_chars") % 2 == 0) & (C("n_chars") > 500), 1.0).otherwise(0.0).alias("measured"))
    return A.report_oracle(lines, p.where("n_chars % 4 > 0").select("id").distinct(), cl)


STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g'))"""


@query("F16", "mine_sentences", rf"""WITH t AS (SELECT page_id, {STRIP} AS text FROM pages), s AS (SELECT page_id, text, [trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(trim(x)) > 40] AS ss FROM t)
SELECT page_id, length(text) AS text_length, len(ss) AS n_sentences, [x FOR x IN ss IF regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])(the|le|der|el)($|[^\p{{L}}\p{{N}}_])')][1] AS method, [x FOR x IN ss IF regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])(and|et|und|con)($|[^\p{{L}}\p{{N}}_])')][1] AS result,
 CASE WHEN lower(text) LIKE '%uncertaint%' THEN 'uncertainty-calibrated action or data selection' WHEN lower(text) LIKE '%offline%' THEN 'offline trajectory-value optimization' WHEN regexp_matches(lower(text), 'imitation|demonstration') THEN 'demonstration-conditioned policy learning'
 WHEN regexp_matches(lower(text), 'hierarch|skill|option') THEN 'temporal skill abstraction and composition' WHEN regexp_matches(lower(text), 'explor|active') THEN 'information-directed exploration' WHEN regexp_matches(lower(text), 'temporal|trajectory|video') THEN 'temporal representation or alignment'
 WHEN regexp_matches(lower(text), 'reward|reinforcement') THEN 'outcome-conditioned policy optimization' ELSE 'learned representation or optimization mechanism' END AS primitive FROM s""")
def _(spark, d):
    m = A.mine_sentences(table(spark, d, "pages"), "html", r"\b(the|le|der|el)\b", r"\b(and|et|und|con)\b")
    return m.select("page_id", F.length("text").cast("long").alias("text_length"), F.size("sentences").cast("long").alias("n_sentences"), "method", "result", "primitive")


@query("T2", "topk_hits", NAMED_Z + """, r AS (SELECT name, stage, row_number() OVER (PARTITION BY name ORDER BY z DESC, delta DESC, stage) AS rank FROM g), t AS (SELECT DISTINCT 'k' || user_id % 10 AS name, ['cpu', 'gpu', 'transport', 'scheduler', 'preprocess'][1 + user_id % 10 % 5] AS cause, user_id % 10 % 2 AS seed FROM events)
SELECT seed, count(DISTINCT name) AS cases, count(*) FILTER (rank <= 1 AND stage = cause) AS top1, count(*) FILTER (rank <= 3 AND stage = cause) AS top3 FROM t LEFT JOIN r USING (name) GROUP BY seed""")
def _(spark, d):
    from ..operators.compare import rank_stages
    r = rank_stages(named_z(spark, d), ["name"]).select(C("name").alias("case"), "stage", "rank")
    t = table(spark, d, "events").selectExpr("concat('k', user_id % 10) case", "element_at(array('cpu', 'gpu', 'transport', 'scheduler', 'preprocess'), cast(1 + user_id % 10 % 5 as int)) cause", "user_id % 10 % 2 seed").distinct()
    return A.topk_hits(r, t, ["seed"])


@query("F15", "stamp", f"WITH {SPANS} SELECT event_id, 'abc' AS \"commit\", stage AS fault, 'unknown' AS seed, 'T4' AS hardware, name AS sig_name FROM spans")
def _(spark, d):
    s = spans(spark, d)
    st = stamp("abc", C("stage"), None, {"hardware": "T4"}, F.struct("name"))
    return s.select("event_id", st.alias("envelope")).select("event_id", "envelope.commit", "envelope.fault", "envelope.seed", C("envelope.env")["hardware"].alias("hardware"), C("envelope.failure_signature.name").alias("sig_name"))

