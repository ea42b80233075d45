"""Evidence-log folds over orders and lineitem seen as a log."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .registry import query
from .views import table

C = F.col


@query("L1", "replay", "SELECT o_orderpriority AS type, o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS data, max(o_orderkey) AS \"offset\" FROM orders GROUP BY ALL")
def _(spark, d):
    return L.replay(table(spark, d, "orders").selectExpr("o_orderpriority type", "o_custkey id", "o_totalprice data", "o_orderkey offset"))


LOG = """lo AS (SELECT o_custkey AS id, o_orderkey AS off, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'TESTED' ELSE 'INFERRED' END AS ts, o_totalprice AS p FROM orders), lp AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY id ORDER BY off), 'INFERRED') AS prior FROM lo)"""


def log_rows(spark, d):
    from ..operators.ordered import scan
    o = table(spark, d, "orders").selectExpr("o_custkey id", "o_orderkey offset", "case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'TESTED' else 'INFERRED' end to_status", "o_totalprice p")
    s = scan(o, ["id"], ["offset"], b=("lag", C("to_status")))
    return s.withColumn("from_status", F.when(C("offset") % 13 == 0, "TESTED").otherwise(F.coalesce("b", F.lit("INFERRED")))).withColumn("experiment", F.when(C("p") > 50000, C("offset"))).drop("b")


@query("L2", "illegal_transitions", f"""WITH {LOG}, x AS (SELECT *, CASE WHEN off % 13 = 0 THEN 'TESTED' ELSE prior END AS fs, p > 50000 AND off % 5 > 0 AS linked, p > 200000 AS measured, prior || '>' || ts AS step FROM lp),
y AS (SELECT *, CASE WHEN fs <> prior THEN 'base mismatch' WHEN step = 'INFERRED>TESTED' AND NOT linked THEN 'no linked experiment' WHEN step = 'TESTED>VERIFIED' AND NOT (linked AND measured) THEN 'not measured'
 WHEN step NOT IN ('INFERRED>TESTED', 'TESTED>VERIFIED', 'TESTED>INFERRED') THEN 'illegal step' END AS reason FROM x) SELECT id, off AS "offset", prior, ts AS to_status, reason FROM y WHERE reason IS NOT NULL""")
def _(spark, d):
    t = log_rows(spark, d)
    e = table(spark, d, "orders").selectExpr("o_orderkey experiment", "if(o_orderkey % 5 > 0, o_custkey, -1) hypothesis", "if(o_totalprice > 200000, 1.0d, null) measured")
    return L.illegal_transitions(t.drop("p"), e)


@query("L3", "claims_view")
def _(spark, d):
    o = table(spark, d, "orders")
    c = o.selectExpr("o_orderkey id", "o_custkey incident", "case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'TESTED' else 'INFERRED' end level", "o_orderpriority mechanism")
    l = table(spark, d, "lineitem")
    support = l.selectExpr("l_orderkey id", "l_orderkey * 10 + l_linenumber ref").distinct()
    inputs = support.selectExpr("ref item", "-ref needs")
    ev = support.join(o.selectExpr("o_orderkey id", "if(o_orderkey % 31 = 0, -1, o_custkey) inc"), "id").selectExpr("-ref id", "inc incident")
    mech = o.selectExpr("o_custkey incident", "o_orderpriority mechanism", "if(o_totalprice > 150000, 'supports', 'unresolved') result")
    gates = l.selectExpr("l_orderkey id", "l_linenumber gate", "l_discount < 0.1 passed")
    return L.claims_view(c, o.where("o_orderkey % 17 = 0").selectExpr("o_orderkey id"), support, inputs, ev, mech, gates)


@query("L4", "prior_advice", """WITH s AS (SELECT p_partkey AS incident, p_type || p_size % 5 AS ctx, [p_brand, 'base'] AS caps, p_name AS mech FROM part), c AS (SELECT s_suppkey AS ask, ['ECONOMY', 'PROMO', 'STANDARD', 'SMALL', 'LARGE', 'MEDIUM'][1 + s_suppkey % 6] || s_nationkey % 5 AS ctx, 'Brand#' || s_nationkey % 25 AS b FROM supplier)
SELECT ask, incident, mech AS mechanisms FROM s JOIN c USING (ctx) WHERE caps[1] = b""")
def _(spark, d):
    s = table(spark, d, "part").selectExpr("p_partkey incident", "map('type', p_type, 'bin', cast(p_size % 5 as string)) context", "array(p_brand, 'base') capabilities", "array(p_name) mechanisms")
    c = table(spark, d, "supplier").selectExpr("s_suppkey ask", "map('bin', cast(s_nationkey % 5 as string), 'type', element_at(array('ECONOMY', 'PROMO', 'STANDARD', 'SMALL', 'LARGE', 'MEDIUM'), cast(1 + s_suppkey % 6 as int))) context",
                                               "array('base', concat('Brand#', s_nationkey % 25)) capabilities")
    return L.prior_advice(s, c).select("ask", "incident", F.concat_ws(",", "mechanisms").alias("mechanisms"))


@query("L5", "budget_left", """WITH r AS (SELECT l_orderkey AS a, sum(l_quantity) AS actual FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT c_custkey AS incident, round(c_acctbal - coalesce(sum(CASE WHEN a IS NOT NULL THEN actual WHEN o_orderkey IS NOT NULL THEN o_totalprice / 100 END), 0), 4) AS "left",
 count(*) FILTER (o_orderkey IS NOT NULL AND a IS NULL) AS unfinished FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN r ON a = o_orderkey GROUP BY c_custkey, c_acctbal""")
def _(spark, d):
    b = table(spark, d, "customer").selectExpr("c_custkey incident", "c_acctbal budget")
    p = table(spark, d, "orders").selectExpr("o_custkey incident", "o_orderkey acquisition", "o_totalprice / 100 bound")
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey acquisition", "l_quantity actual")
    return L.budget_left(b, p, r).withColumn("left", F.round("left", 4))


ACT = """ac AS (SELECT o_custkey AS id, o_orderkey AS off, CASE o_orderstatus WHEN 'F' THEN 'propose' WHEN 'O' THEN 'suppress' ELSE 'reopen' END AS action, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS reason FROM orders),
av AS (SELECT *, last_value(CASE WHEN action <> 'propose' AND trim(reason) <> '' THEN action END IGNORE NULLS) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ac),
ar AS (SELECT *, CASE WHEN action <> 'propose' AND trim(reason) = '' THEN 'no reason' WHEN action = 'suppress' AND last = 'suppress' THEN 'already suppressed' WHEN action = 'reopen' AND coalesce(last, 'reopen') = 'reopen' THEN 'already open' END AS rejected FROM av)"""


def actions(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey id", "o_orderkey offset", "case o_orderstatus when 'F' then 'propose' when 'O' then 'suppress' else 'reopen' end action", "if(o_orderpriority = '5-LOW', ' ', o_orderpriority) reason", "o_orderkey evidence")


@query("L6", "registry_view", f"""WITH {ACT} SELECT id, coalesce(arg_max(action, off) FILTER (rejected IS NULL AND action <> 'propose') = 'suppress', false) AS suppressed, arg_max(reason, off) FILTER (rejected IS NULL AND action <> 'propose') AS reason, count(*) FILTER (rejected IS NULL AND action <> 'propose') AS turns,
 count(*) FILTER (rejected IS NULL AND action <> 'suppress') AS support FROM ar GROUP BY id""")
def _(spark, d):
    return L.registry_view(actions(spark, d))[0]


@query("L6", "registry_rejects", f"WITH {ACT} SELECT id, off AS \"offset\", action, rejected FROM ar WHERE rejected IS NOT NULL")
def _(spark, d):
    return L.registry_view(actions(spark, d))[1]
