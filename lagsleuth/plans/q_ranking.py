"""Calibration, memory, measurement choice and model queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import STAGES, cosine, entropy_bits, jaccard, softmax
from ..operators import graph as G, nearest, ranking as R, voices as M
from ..operators.audit import OUTCOME_LABELS
from ..operators.storage import materialize
from .q_audit import CNT, counts
from .q_graph import M6, structural
from .registry import query
from .views import SPANS, spans, table

C = F.col


def r6(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


FOLD = "transform(sequence(0, 7), s -> aggregate(filter(embedding, (x, i) -> i % 8 = s), 0d, (a, x) -> a + x) * 20)"
INC = """inc AS (SELECT vec_id, label % 8 AS y, [list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(CAST(s AS INT) + 1, len(embedding) + 1, 8)]) * 20 FOR s IN range(8)] AS z, CASE WHEN vec_id % 4 = 0 THEN .5 ELSE 0 END::DOUBLE AS tail FROM embeddings)"""
W = [[1.2 if i == j else -0.1 for j in range(8)] for i in range(8)]
B, T0, SH = [0.1 * i for i in range(8)], 1.5, [0.05 * i for i in range(8)]
LOGIT = f"""{INC}, lg AS (SELECT vec_id, y, z, tail, i, (.1 * i + 1.3 * asinh(z[i + 1]) - .1 * list_sum([asinh(x) FOR x IN z]) + CASE WHEN i = 3 THEN tail ELSE 0 END) / 1.5 + .05 * i AS l FROM inc CROSS JOIN (SELECT unnest(range(8)) AS i)),
mx AS (SELECT vec_id, max(l) AS mx FROM lg GROUP BY ALL), ex AS (SELECT vec_id, y, z, i, l, exp(l - mx) AS e FROM lg JOIN mx USING (vec_id)), tt AS (SELECT vec_id, sum(e) AS t FROM ex GROUP BY ALL),
pr AS (SELECT vec_id, y, i, l, z[i + 1] AS z, e / t AS p, {repr(list(STAGES))}[i + 1] AS stage FROM ex JOIN tt USING (vec_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, stage) AS rank FROM pr)"""


def incidents(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (C("label") % 8).alias("y"), F.expr(FOLD).alias("z"), F.when(C("vec_id") % 4 == 0, 0.5).otherwise(0.0).alias("tail"))


def scored(spark, d):
    return R.score_stages(incidents(spark, d), "vec_id", W, B, T0, SH)


def probs(spark, d):
    idx = F.array_position(F.array(*[F.lit(s) for s in STAGES]), C("stage"))
    p = scored(spark, d).groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(idx.alias("i"), "p"))), lambda x: x["p"]).alias("p"))
    return p.join(incidents(spark, d).select("vec_id", "y"), "vec_id")


@query("M10", "score_stages", f"WITH {LOGIT} SELECT vec_id, stage, round(p, 9) AS p, rank FROM rk")
def _(spark, d):
    return r6(scored(spark, d), "p", digits=9)


GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def logits(spark, d):
    z = incidents(spark, d)
    return z.select("y", F.transform("z", lambda x: F.asinh(x)).alias("l"))


@query("M9", "temperature_curve", f"""WITH {INC}, g AS (SELECT unnest({GRID}) AS t), s AS (SELECT t, asinh(z[y + 1]) / t AS ly, list_max([asinh(x) / t FOR x IN z]) AS mx, z FROM inc, g)
SELECT t::DOUBLE AS t, round(avg(-ln(greatest(exp(ly - mx) / list_sum([exp(asinh(x) / t - mx) FOR x IN z]), 1e-12))), 6) AS nll, count(*) AS n FROM s GROUP BY t""")
def _(spark, d):
    return r6(R.temperature_curve(logits(spark, d), GRID), "nll")


@query("M9", "fit_temperature")
def _(spark, d):
    return r6(R.fit_temperature(logits(spark, d)), "temperature", "nll", digits=4)


REL = f"""{LOGIT}, tp AS (SELECT vec_id, y, max(p) AS top, arg_max(i, p) AS arg, sum(power(p - CASE WHEN i = y THEN 1 ELSE 0 END, 2)) AS br FROM pr GROUP BY vec_id, y), bn AS (SELECT greatest(0, ceil(top * 5)::INT - 1) AS bin, (arg = y)::INT AS hit, top, br FROM tp),
bs AS (SELECT bin, count(*) AS n, avg(hit) AS acc, avg(top) AS conf, sum(br) AS br FROM bn GROUP BY bin)"""


@query("M11", "reliability_bins", f"WITH {REL} SELECT bin, n, round(acc, 6) AS acc, round(conf, 6) AS conf FROM bs")
def _(spark, d):
    return r6(R.reliability(probs(spark, d), 5)[0], "acc", "conf")


@query("M11", "reliability", f"WITH {REL} SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(sum(br) / sum(n), 6) AS brier FROM bs")
def _(spark, d):
    return r6(R.reliability(probs(spark, d), 5)[1], "ece", "brier")


@query("M13", "conformal_sets", f"""WITH {LOGIT}, s AS (SELECT 1 - p AS s, row_number() OVER (ORDER BY 1 - p) AS r, count(*) OVER () AS n FROM pr WHERE i = y), q AS (SELECT max(s) AS q FROM s WHERE r = ceil((n + 1) * .8))
SELECT vec_id, i::INT AS member FROM pr, q WHERE q IS NULL OR round(p, 12) >= round(1 - q, 12)""")
def _(spark, d):
    p = materialize(probs(spark, d), "probs")
    return R.conformal_sets(p, "vec_id", p, 0.8).select("vec_id", "member")


PL = f"""{LOGIT}, s0 AS (SELECT *, z * 3 AS zz, vec_id % 3 > 0 AS trusted, max(CASE WHEN rank = 1 THEN p END) OVER (PARTITION BY vec_id) AS top, max(z * 3) OVER (PARTITION BY vec_id) AS mz FROM rk), s1 AS (SELECT *, mz >= 5 AND zz <= .15 * mz AS veto FROM s0)"""


def plausible(spark, d):
    z = incidents(spark, d).select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", F.element_at(F.array(*[F.lit(s) for s in STAGES]), C("i") + 1).alias("stage"), (C("z") * 3).alias("z"))
    s = scored(spark, d).join(z, ["vec_id", "stage"]).withColumns({"score": C("p"), "trusted": C("vec_id") % 3 > 0})
    return R.plausible(s, "vec_id")


@query("M20", "plausible", f"WITH {PL} SELECT vec_id, stage, CASE WHEN rank > 1 AND veto THEN 'vetoed' ELSE 'member' END AS status FROM s1 WHERE top - p <= .15")
def _(spark, d):
    return plausible(spark, d)[0]


@query("M20", "commit_decision", f"""WITH {PL}, g AS (SELECT vec_id, max(stage) FILTER (rank = 1) AS top1, max(stage) FILTER (rank = 2) AS top2, max(p) FILTER (rank = 1) AS s1, max(p) FILTER (rank = 2) AS s2, bool_or(veto) FILTER (rank = 1) AS v1, bool_or(veto) FILTER (rank = 2) AS v2, bool_and(trusted) AS tr FROM s1 GROUP BY ALL)
SELECT vec_id, top1, round(s1 - s2, 6) AS margin, CASE WHEN s1 - s2 < .15 AND NOT v1 AND NOT v2 THEN top1 || '+' || top2 END AS composite, tr AND s1 >= .99 AND s1 - s2 >= .05 AS commit FROM g""")
def _(spark, d):
    return r6(plausible(spark, d)[1], "margin")


ACC = [("matched", 0.62), ("structural", 0.55), ("gls", 0.4), ("enet", 0.45), ("perm", 0.42), ("xcorr", 0.2)]


@query("M23", "measurement_value", f"""WITH {LOGIT}, q AS (SELECT vec_id, max(p) AS q FROM pr GROUP BY ALL), v AS (SELECT * FROM (VALUES ('matched', .62, 1), ('structural', .55, 1), ('gls', .4, 2), ('enet', .45, 2), ('perm', .42, 2), ('xcorr', .2, 1)) t(voice, acc, cost)),
m AS (SELECT vec_id, voice, cost, acc::DOUBLE * (1 - q) * 10 - cost AS value FROM q, v WHERE NOT (voice = ['matched', 'structural', 'gls', 'enet', 'perm', 'xcorr'][1 + vec_id % 6] OR voice = 'matched'))
SELECT vec_id, voice, round(value, 6) AS value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, cost, voice) AS rank FROM m""")
def _(spark, d):
    q = scored(spark, d).groupBy("vec_id").agg(F.max("p").alias("q"))
    names = F.array(*[F.lit(v) for v, _a in ACC])
    taken = q.select("vec_id", F.explode(F.array_distinct(F.array(F.element_at(names, (C("vec_id") % 6 + 1).cast("int")), F.lit("matched")))).alias("voice"))
    m = R.measurement_value(spark.createDataFrame(ACC, "voice string, acc double"), q, taken, "vec_id")
    return r6(m.select("vec_id", "voice", "value", "rank"), "value")


@query("F12", "array_functions", f"""WITH {INC}, e AS (SELECT vec_id, z, [exp(x - list_max(z)) FOR x IN z] AS e FROM inc), p AS (SELECT vec_id, z, [x / list_sum(e) FOR x IN e] AS p FROM e)
SELECT vec_id, round(list_max(p), 9) AS top, round(list_sum([CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END FOR x IN p]), 6) AS entropy, round(list_cosine_similarity(z, p), 6) AS cos,
 round(len(list_intersect([CAST(floor(x) AS BIGINT) FOR x IN z], [0, 1, -1])) / len(list_distinct(list_concat([CAST(floor(x) AS BIGINT) FOR x IN z], [0, 1, -1]))), 6) AS jac FROM p""")
def _(spark, d):
    p = incidents(spark, d).withColumn("p", softmax(C("z")))
    k = F.transform("z", lambda x: F.floor(x))
    out = p.select("vec_id", F.array_max("p").alias("top"), entropy_bits(C("p")).alias("entropy"), cosine(C("z"), C("p")).alias("cos"), jaccard(k, F.array(*[F.lit(v).cast("long") for v in (0, 1, -1)])).alias("jac"))
    return r6(r6(out, "entropy", "cos", "jac"), "top", digits=9)


BEL = """bel AS (SELECT c_nationkey AS k, c_mktsegment AS cause, .8 * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS mass FROM customer GROUP BY c_nationkey, c_mktsegment), cs AS (SELECT DISTINCT cause FROM cnt),
pri AS (SELECT k, cs.cause, coalesce(mass, 0) + .2 / (SELECT count(*) FROM cs) AS prior FROM (SELECT DISTINCT k FROM bel) CROSS JOIN cs LEFT JOIN bel USING (k, cause)),
lk AS (SELECT *, (n + 1.0) / (sum(n) OVER (PARTITION BY action, cause) + count(*) OVER (PARTITION BY action, cause)) AS lk FROM cnt),
po AS (SELECT k, action, outcome, sum(prior * lk) AS po FROM pri JOIN lk USING (cause) GROUP BY ALL), h0 AS (SELECT k, -sum(prior * log2(prior)) AS h0 FROM pri GROUP BY ALL),
ph AS (SELECT k, action, sum(po * hp) AS hp FROM (SELECT k, action, outcome, po, -sum(CASE WHEN prior * lk > 0 THEN prior * lk / po * log2(prior * lk / po) ELSE 0 END) AS hp FROM pri JOIN lk USING (cause) JOIN po USING (k, action, outcome) GROUP BY ALL) GROUP BY ALL),
rl AS (SELECT action, avg(m) AS reliability FROM (SELECT action, cause, max(lk) AS m FROM lk GROUP BY ALL) GROUP BY ALL), eg AS (SELECT k, action, greatest(0, h0 - hp) AS eig, reliability FROM ph JOIN h0 USING (k) JOIN rl USING (action))"""


def beliefs(spark, d):
    from pyspark.sql import Window
    c = table(spark, d, "customer").groupBy(C("c_nationkey").alias("k"), C("c_mktsegment").alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    b = c.select("k", "cause", (0.8 * C("n") / F.sum("n").over(Window.partitionBy("k"))).alias("mass"))
    return b.unionByName(b.select("k").distinct().select("k", F.lit("UNKNOWN").alias("cause"), F.lit(0.2).alias("mass")))


COSTS = {"timeline": 1.0, "scheduler_trace": 1.5, "kernel_timeline": 2.0, "counters": 2.5, "tensor_analysis": 4.0, "deep_profile": 6.0}
SETUP = {"host": 0.5, "device": 1.0, "deep": 3.0}


@query("M17", "eig", f"""WITH {CNT}, {BEL}, tk AS (SELECT k, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['counters'] ELSE ['kernel_timeline', 'timeline'] END AS t FROM (SELECT DISTINCT k FROM bel)),
m AS (SELECT * FROM (VALUES ('timeline', 1.0, .5, 'host', '', ''), ('scheduler_trace', 1.5, .5, 'host', '', ''), ('kernel_timeline', 2.0, 1.0, 'device', '', ''), ('counters', 2.5, 1.0, 'device', '', 'tensor_analysis'), ('tensor_analysis', 4.0, 3.0, 'deep', 'counters', 'counters'), ('deep_profile', 6.0, 3.0, 'deep', 'kernel_timeline', '')) t(action, c, setup, grp, need, ov)),
x AS (SELECT eg.*, CASE WHEN list_contains(t, action) THEN 0 WHEN list_contains(t, ov) THEN .5 ELSE 1 END::DOUBLE AS redundancy, c + CASE WHEN list_has_any(t, (SELECT list(action) FROM m z WHERE z.grp = m.grp)) THEN 0 ELSE setup END AS cost, need = '' OR list_contains(t, need) AS admissible FROM eg JOIN m USING (action) JOIN tk USING (k)),
s AS (SELECT *, CASE WHEN admissible THEN eig * reliability * redundancy / cost ELSE 0 END AS score FROM x)
SELECT k, action, round(eig, 9) AS eig, round(reliability, 6) AS reliability, redundancy, cost::DOUBLE AS cost, admissible, round(score, 9) AS score, row_number() OVER (PARTITION BY k ORDER BY round(score, 12) DESC, cost, action) AS rank FROM s""")
def _(spark, d):
    b = beliefs(spark, d)
    g = R.information_gain(b, materialize(counts(spark, d), "counts"), "k")
    none = F.array().cast("array<string>")
    t = b.select("k").distinct().withColumn("actions", F.when(C("k") % 3 == 0, none).when(C("k") % 3 == 1, F.array(F.lit("counters"))).otherwise(F.array(F.lit("kernel_timeline"), F.lit("timeline"))))
    return r6(r6(R.rank_measurements(g, t, COSTS, SETUP, "k"), "reliability"), "eig", "score", digits=9)


ACTIONS = list(OUTCOME_LABELS)
SEEN = """sn AS (SELECT k, action, CASE WHEN (k + i) % 2 = 0 THEN hot ELSE cold END AS outcome, i FROM (SELECT DISTINCT k FROM bel) CROSS JOIN (SELECT * FROM (VALUES ('timeline', 'host_hot', 'host_ok', 0), ('scheduler_trace', 'sched_hot', 'sched_ok', 1), ('kernel_timeline', 'kernel_slow', 'kernel_ok', 2), ('counters', 'pressured', 'ok', 3), ('tensor_analysis', 'degraded', 'ok', 4), ('deep_profile', 'stall_hot', 'stall_ok', 5)) t(action, hot, cold, i))),
pk AS (SELECT k, cause, coalesce(mass, 0) / sum(coalesce(mass, 0)) OVER (PARTITION BY k) AS prior FROM (SELECT DISTINCT k FROM bel) CROSS JOIN cs LEFT JOIN bel USING (k, cause)),
ps AS (SELECT k, action, cause, i, prior * lk / sum(prior * lk) OVER (PARTITION BY k, action) AS post FROM pk JOIN sn USING (k) JOIN lk USING (action, outcome, cause)),
ub AS (SELECT k, action, i, cause, post * .8 AS mass FROM ps UNION ALL SELECT DISTINCT k, action, i, 'UNKNOWN', .2 FROM ps)"""


def seen(spark, d):
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("hot"), F.lit(c).alias("cold"), F.lit(i).alias("i")) for i, (a, (h, c)) in enumerate(OUTCOME_LABELS.items())])
    s = beliefs(spark, d).select("k").distinct().select("k", F.explode(rows).alias("r")).select("k", "r.*")
    return s.select("k", "action", F.when((C("k") + C("i")) % 2 == 0, C("hot")).otherwise(C("cold")).alias("outcome"))


@query("M18", "update_beliefs", f"WITH {CNT}, {BEL}, {SEEN} SELECT k, action, cause, round(mass, 9)::DOUBLE AS mass FROM ub")
def _(spark, d):
    return r6(R.update_beliefs(beliefs(spark, d), materialize(counts(spark, d), "counts"), seen(spark, d), "k"), "mass", digits=9)


@query("M19", "eig_backtest", f"""WITH {CNT}, {BEL}, {SEEN}, h1 AS (SELECT k, action, -sum((post * .8 + .2 / 5) * log2(post * .8 + .2 / 5)) AS h1 FROM ps GROUP BY ALL)
SELECT k, action, round(eig, 9) AS predicted, round(greatest(0, h0 - h1), 9) AS realised FROM eg JOIN h1 USING (k, action) JOIN h0 USING (k)""")
def _(spark, d):
    return r6(R.eig_backtest(beliefs(spark, d), materialize(counts(spark, d), "counts"), seen(spark, d), "k")[0], "predicted", "realised", digits=9)


@query("M19", "eig_spearman", f"""WITH {CNT}, {BEL}, {SEEN}, h1 AS (SELECT k, action, -sum((post * .8 + .2 / 5) * log2(post * .8 + .2 / 5)) AS h1 FROM ps GROUP BY ALL), r AS (SELECT k, action, round(eig, 12) AS p, round(greatest(0, h0 - h1), 12) AS g FROM eg JOIN h1 USING (k, action) JOIN h0 USING (k)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, action) AS pos FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, pos) AS rx, row_number() OVER (PARTITION BY k ORDER BY g, pos) AS ry FROM o)
SELECT k, round(corr(rx, ry), 6) AS spearman, arg_min(action, pos) AS pred_best, arg_max(action, (g, action)) AS real_best FROM z GROUP BY k""")
def _(spark, d):
    return r6(R.eig_backtest(beliefs(spark, d), materialize(counts(spark, d), "counts"), seen(spark, d), "k")[1], "spearman")


def store(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").join(table(spark, d, "embeddings").select(C("vec_id").alias("doc_id"), F.expr(FOLD).alias("e")), "doc_id", "left")
    return doc.select(C("doc_id").alias("id"), "text", C("lang").alias("version"), F.array("lang", "source").alias("kernels"), F.coalesce("e", F.array(*[F.lit(0.0)] * 8)).alias("z"),
                      F.element_at(F.array(*[F.lit(s) for s in STAGES]), (C("n_chars") % 8 + 1).cast("int")).alias("stage"), F.when(C("quality") == 1, "VERIFIED").when(C("quality") == 0, "TESTED").otherwise("INFERRED").alias("tier"),
                      C("source").alias("cause"), C("lang").alias("fix"), F.coalesce(C("toxic") == 1, F.lit(False)).alias("retracted"))


def asked(spark, d):
    b = table(spark, d, "benchmark").join(table(spark, d, "embeddings").select(C("vec_id").alias("item_id"), F.expr(FOLD).alias("e")), "item_id", "left")
    v = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (C("item_id") % 4 + 1).cast("int"))
    return b.select(C("item_id").alias("qid"), "text", v.alias("version"), F.array(v, F.concat(F.lit("src"), (C("item_id") % 20).cast("string"))).alias("kernels"), F.coalesce("e", F.array(*[F.lit(0.0)] * 8)).alias("z"),
                    F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.length("text") % 8 + 1).cast("int")).alias("stage"), (C("item_id") % 3 == 0).alias("serialized"), F.transform(F.coalesce("e", F.array(*[F.lit(0.0)] * 8)), lambda x: x / 2).alias("d"))


ZF = "[list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(CAST(s AS INT) + 1, len(embedding) + 1, 8)]) * 20 FOR s IN range(8)]"
SIMS = r"""sq AS (SELECT doc_id AS id, d.text, lang AS version, [lang, source] AS kernels, n_chars % 8 AS st, quality, source AS cause, e.z FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN em e ON e.vec_id = doc_id WHERE NOT coalesce(toxic = 1, false)),
qq AS (SELECT item_id AS qid, text, ['en', 'fr', 'de', 'es'][1 + item_id % 4] AS version, length(text) % 8 AS st, e.z FROM benchmark LEFT JOIN em e ON e.vec_id = item_id),
tk AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t FROM sq) GROUP BY ALL), qt AS (SELECT qid, t, count(*) AS tf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t FROM qq) GROUP BY ALL),
dfs AS (SELECT t, count(*) AS df FROM tk GROUP BY t), nn AS (SELECT count(*) + 2 AS n1 FROM sq), qw AS (SELECT qid, t, tf, ln(n1 / (coalesce(df, 0) + 2)) + 1 AS w FROM qt LEFT JOIN dfs USING (t), nn), qn AS (SELECT qid, sqrt(sum(tf * tf * w * w)) AS qn FROM qw GROUP BY ALL),
dn AS (SELECT id, sum(power(tf * (ln(n1 / (df + 1)) + 1), 2)) AS b FROM tk JOIN dfs USING (t), nn GROUP BY id),
sm AS (SELECT qid, id, sum(qw.tf * tk.tf * w * w) AS dot, sum(tk.tf * tk.tf * (w * w - power(ln(n1 / (df + 1)) + 1, 2))) AS fx FROM qw JOIN tk USING (t) JOIN dfs USING (t), nn GROUP BY ALL), sims AS (SELECT qid, id, dot / qn / sqrt(b + fx) AS sim FROM sm JOIN dn USING (id) JOIN qn USING (qid)),
sc AS (SELECT qq.qid, sq.id, sq.cause, sq.quality, .4 * (qq.version = sq.version)::INT + .3 * len(list_intersect([qq.version, 'src' || qq.qid % 20], sq.kernels)) / len(list_distinct(list_concat([qq.version, 'src' || qq.qid % 20], sq.kernels)))
 + .3 * greatest(0, coalesce(list_dot_product(qq.z, sq.z) / nullif(sqrt(list_dot_product(qq.z, qq.z)) * sqrt(list_dot_product(sq.z, sq.z)), 0), 0)) AS structured, (qq.st = sq.st)::INT::DOUBLE AS graph FROM qq, sq),
fs AS (SELECT qid, id, structured, coalesce(sim, 0) AS semantic, graph, .5 * structured + .3 * coalesce(sim, 0) + .2 * graph AS score, CASE WHEN quality = 1 THEN cause END AS cause FROM sc LEFT JOIN sims USING (qid, id)), hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM fs)"""
RET = f"em AS (SELECT vec_id, {ZF} AS z FROM embeddings), {SIMS}"


@query("M14", "retrieve", f"WITH {RET} SELECT qid, id, round(score, 6) AS score, round(structured, 6)::DOUBLE AS structured, round(semantic, 6) AS semantic, graph, cause, rank FROM hits WHERE rank <= 3")
def _(spark, d):
    return r6(R.retrieve(asked(spark, d), store(spark, d)), "score", "structured", "semantic")


@query("T7", "topk_similar", f"WITH {RET}, k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank, round(sim, 6) AS sim FROM sims) SELECT * FROM k WHERE rank <= 5")
def _(spark, d):
    return r6(nearest.topk_similar(asked(spark, d), store(spark, d).where("not retracted"), 5), "sim")


@query("M15", "difference_card", f"""WITH {RET}, em2 AS (SELECT qid, id, coalesce(q.z, [0,0,0,0,0,0,0,0]) AS qz, coalesce(s.z, [0,0,0,0,0,0,0,0]) AS sz, q.version AS qv, s.version AS sv, s.kernels AS sk, q.st AS qs, s.st AS ss, s.quality FROM (SELECT * FROM hits WHERE rank <= 3) h JOIN qq q USING (qid) JOIN sq s USING (id)),
x AS (SELECT *, {repr(list(STAGES))} AS nm, [i FOR i IN range(1, 9) IF abs(qz[i] - sz[i]) <= greatest(1, .25 * greatest(abs(qz[i]), abs(sz[i])))] AS cl FROM em2),
y AS (SELECT *, list_concat([nm[i] FOR i IN range(1, 9) IF NOT list_contains(cl, i)], CASE WHEN list_sort(sk) <> list_sort([qv, 'src' || qid % 20]) THEN ['kernels'] ELSE [] END, CASE WHEN qv <> sv THEN ['timing'] ELSE [] END) AS mm FROM x)
SELECT qid, id, array_to_string([nm[i] FOR i IN range(1, 9) IF list_contains(cl, i) AND abs(sz[i]) > 2], ',') AS matches, array_to_string(mm, ',') AS mismatches, array_to_string([nm[i] FOR i IN range(1, 9) IF abs(qz[i]) <= 2 AND abs(sz[i]) <= 2], ',') AS unknowns,
 CASE WHEN quality = 1 AND len(mm) = 0 AND qs = ss THEN 'low' ELSE 'high' END AS risk FROM y""")
def _(spark, d):
    s = store(spark, d)
    q = asked(spark, d)
    c = R.difference_card(R.retrieve(q, s), q, s)
    return c.select("qid", "id", *[F.concat_ws(",", x).alias(x) for x in ("matches", "mismatches", "unknowns")], "risk")


@query("M16", "shrunk_priors", f"""WITH {RET}, i AS (SELECT l_orderkey % (SELECT count(*) FROM documents) AS id, l_returnflag AS intervention, avg(l_quantity) AS measured, count(*) AS support FROM lineitem GROUP BY ALL)
SELECT qid, id, intervention, round(support / (support + 2) * (.5 + .5 * structured), 6)::DOUBLE AS factor, round(measured * support / (support + 2) * (.5 + .5 * structured), 5)::DOUBLE AS shrunk FROM (SELECT * FROM hits WHERE rank <= 3) JOIN i USING (id)""")
def _(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()
    i = table(spark, d, "lineitem").groupBy((C("l_orderkey") % n).alias("id"), C("l_returnflag").alias("intervention")).agg(F.avg("l_quantity").alias("measured"), F.count(F.lit(1)).alias("support"))
    h = R.retrieve(asked(spark, d), store(spark, d))
    return r6(r6(R.shrunk_priors(h, i).select("qid", "id", "intervention", "factor", "shrunk"), "factor"), "shrunk", digits=5)


@query("M21", "recall_rules", f"""WITH {RET}, t AS (SELECT * FROM hits WHERE rank = 1), g AS (SELECT qid, version, qid % 3 = 0 AS ser, z, list_position(z, list_max(z)) AS top FROM qq),
j AS (SELECT g.*, score, t.cause, s.version AS fix, s.quality FROM g LEFT JOIN t USING (qid) LEFT JOIN sq s USING (id))
SELECT qid, CASE WHEN version = 'en' AND ser AND z[5] > 2 THEN 'rule:serialized-sync-v1' WHEN version = 'en' AND NOT ser AND top = 6 AND z[6] > 2 THEN 'rule:kernel-regression-v1' WHEN score >= .2 THEN 'retrieval' ELSE 'fallthrough' END AS path,
 CASE WHEN version = 'en' AND ser AND z[5] > 2 THEN 'sync_serialization' WHEN version = 'en' AND NOT ser AND top = 6 AND z[6] > 2 THEN 'kernel_regression' WHEN score >= .2 THEN cause ELSE 'UNKNOWN' END AS cause,
 CASE WHEN version = 'en' AND ser AND z[5] > 2 THEN 'remove_competing' WHEN version = 'en' AND NOT ser AND top = 6 AND z[6] > 2 THEN 'revert_kernel_config' WHEN score >= .2 AND quality = 1 THEN fix ELSE '' END AS fix FROM j""")
def _(spark, d):
    s = store(spark, d)
    q = asked(spark, d)
    return R.recall_rules(q, R.retrieve(q, s), "en", s)


@query("M24", "incident_records", f"""WITH s AS (SELECT o_custkey AS k, {repr(list(STAGES))}[1 + o_orderkey % 8] AS stage, max(o_totalprice) / 1000 AS z, min(o_totalprice) AS delta FROM orders GROUP BY ALL),
h AS (SELECT o_custkey AS k, arg_max(o_orderpriority, (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END, o_orderkey)) AS cause, arg_max(CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'TESTED' ELSE 'INFERRED' END, (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END, o_orderkey)) AS tier FROM orders GROUP BY ALL),
e AS (SELECT o_custkey AS k, o_orderpriority AS iv, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_totalprice / 1000 - 50 END AS p, o_totalprice / 500 - 300 AS m FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT k, count(*) AS n, arg_max(iv, (m, iv)) AS iv, arg_max(m, (m, iv)) AS m, arg_max(p, (m, iv)) AS p FROM e GROUP BY ALL)
SELECT h.k, cause, tier, (SELECT count(*) FROM s WHERE s.k = h.k) AS n_symptoms, (SELECT round(max(z), 6) FROM s WHERE s.k = h.k) AS top_z, (SELECT arg_min(stage, (-z, -delta, stage)) FROM s WHERE s.k = h.k) AS top_stage, CASE WHEN m > 0 THEN iv ELSE '' END AS fix,
 round(CASE WHEN abs(p) > 1e-9 THEN m / p WHEN m IS NOT NULL THEN 0 END, 6) AS recovery, coalesce(n, 0) AS n_interventions, h.k % 11 = 0 AS retracted FROM h LEFT JOIN b USING (k)""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("k", C("o_custkey"))
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (C("o_orderkey") % 8 + 1).cast("int"))
    s = o.groupBy("k", stage.alias("stage")).agg((F.max("o_totalprice") / 1000).alias("z"), F.min("o_totalprice").alias("delta"))
    h = o.select("k", C("o_orderkey").alias("seq"), C("o_orderpriority").alias("cause"), F.expr("case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'TESTED' else 'INFERRED' end status"))
    e = o.selectExpr("k", "o_orderpriority intervention", "case when k % 7 = 0 then 0 else o_totalprice / 1000 - 50 end predicted", "case when o_orderstatus = 'P' then null else o_totalprice / 500 - 300 end measured")
    r = R.incident_records(s, h, e, o.where("k % 11 = 0").select("k"), "k")
    top = F.array_max(F.transform(F.map_values("symptoms"), lambda v: v["z"]))
    return r6(r.select("k", "cause", "tier", F.size("symptoms").cast("long").alias("n_symptoms"), top.alias("top_z"), "top_stage", "fix", "recovery", "n_interventions", "retracted"), "top_z", "recovery")


@query("M7", "fuse_voices", f"""WITH {M6}, nz AS (SELECT run_id, 'structural' AS voice, stage, CASE WHEN sum(excess_ms) OVER (PARTITION BY run_id) > 0 THEN excess_ms / sum(excess_ms) OVER (PARTITION BY run_id) ELSE .125 END AS score FROM sc),
mt AS (SELECT run_id, 'matched' AS voice, CASE stage WHEN 'cpu' THEN 'cpu' WHEN 'gpu' THEN 'gpu' ELSE stage END AS stage, avg(dur_ms) / sum(avg(dur_ms)) OVER (PARTITION BY run_id) AS score FROM spans WHERE arm = 'current' GROUP BY run_id, stage),
xv AS (SELECT run_id, 'xcorr' AS voice, stage, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS score FROM spans WHERE arm = 'current' GROUP BY run_id, stage),
f AS (SELECT run_id, stage, sum(CASE voice WHEN 'xcorr' THEN 1 ELSE 3 END * score) / sum(CASE voice WHEN 'xcorr' THEN 1 ELSE 3 END) AS s FROM (FROM nz UNION ALL FROM mt UNION ALL FROM xv) GROUP BY ALL), g AS (SELECT run_id, stage, s * coalesce(multiplier, 1) AS score FROM f LEFT JOIN sc USING (run_id, stage))
SELECT run_id, stage, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, stage) AS rank FROM g""")
def _(spark, d):
    st = materialize(structural(spark, d), "structural")
    a = R.normalise_scores(st.select("run_id", F.lit("structural").alias("voice"), "stage", C("excess_ms").alias("score")), ["run_id"])
    s = spans(spark, d).where("arm = 'current'").groupBy("run_id", "stage").agg(F.avg("dur_ms").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    b = R.normalise_scores(s.select("run_id", F.lit("matched").alias("voice"), "stage", C("m").alias("score")), ["run_id"])
    x = R.normalise_scores(s.select("run_id", F.lit("xcorr").alias("voice"), "stage", C("n").alias("score")), ["run_id"])
    return r6(R.fuse_voices(a.unionByName(b).unionByName(x), st.select("run_id", "stage", "multiplier"), "run_id"), "score")


OPF = ["cpu_dur", "gpu_dur", "launch_gap", "queue_wait", "sm"]
OPS = f"""{SPANS}, rc AS (SELECT run_id, cid, kind, arg_max({{'s': start_ns, 'e': end_ns, 'd': dur_ns, 'k': k, 'id': event_id}}, event_id) AS r FROM spans GROUP BY ALL),
ops AS (SELECT g.r.id AS ts, c.run_id, c.cid, (c.r.e - c.r.s) / 1e6 AS cpu_dur, g.r.d / 1e6 AS gpu_dur, greatest(0, g.r.s - c.r.e) / 1e6 AS launch_gap, g.r.k::DOUBLE AS queue_wait, 1.0 AS sm, (c.run_id >= '2024-01-16')::INT AS y FROM (SELECT * FROM rc WHERE kind = 'cpu_launch') c JOIN (SELECT * FROM rc WHERE kind = 'gpu_kernel') g ON g.run_id = c.run_id AND g.cid = c.cid)"""


def ops(spark, d):
    w = G.last_records(spans(spark, d)).where("cpu is not null and gpu is not null")
    return w.select(C("gpu.event_id").alias("ts"), "run_id", "cid", ((C("cpu.end_ns") - C("cpu.start_ns")) / 1e6).alias("cpu_dur"), (C("gpu.dur_ns") / 1e6).alias("gpu_dur"), (F.greatest(F.lit(0), C("gpu.start_ns") - C("cpu.end_ns")) / 1e6).alias("launch_gap"),
                    C("gpu.k").cast("double").alias("queue_wait"), F.lit(1.0).alias("sm"), F.when(C("run_id") >= "2024-01-16", 1).otherwise(0).alias("y"))


@query("M1", "feature_table", f"""WITH {OPS}, m AS (SELECT avg(cpu_dur) AS a, stddev_pop(cpu_dur) AS b, avg(gpu_dur) AS c, stddev_pop(gpu_dur) AS d, avg(launch_gap) AS e, stddev_pop(launch_gap) AS f, avg(queue_wait) AS g, stddev_pop(queue_wait) AS h FROM ops)
SELECT ts, run_id, cid, y, round((cpu_dur - a) / b, 6) AS cpu_dur, round((gpu_dur - c) / d, 6) AS gpu_dur, round((launch_gap - e) / f, 6) AS launch_gap, round((queue_wait - g) / h, 6) AS queue_wait FROM ops, m""")
def _(spark, d):
    t, kept = M.feature_table(ops(spark, d), OPF)
    return r6(t, *kept)


def _voice(fn, *a):
    def run(spark, d):
        t, kept = M.feature_table(ops(spark, d), OPF)
        return r6(fn(t, kept, *a), "score", digits=4)
    return run


query("M2", "enet_scores")(_voice(M.enet_scores))
query("M3", "gls_scores")(_voice(M.gls_scores))
query("M4", "perm_importance")(_voice(M.perm_scores))
query("M5", "additive_tree_scores")(_voice(M.tree_scores, 1))
query("M5", "boosted_tree_scores")(_voice(M.tree_scores, 3))


@query("M8", "train_stage_model")
def _(spark, d):
    i = incidents(spark, d)
    m = M.train_stage_model(i.select("y", "z"))
    rows = [(int(c), float(m.interceptVector[c]), *[float(m.coefficientMatrix[c, j]) for j in range(8)]) for c in range(m.numClasses)]
    return r6(spark.createDataFrame(rows, "cls int, intercept double, " + ", ".join(f"w{j} double" for j in range(8))), "intercept", *[f"w{j}" for j in range(8)], digits=3)


@query("M12", "platt_isotonic")
def _(spark, d):
    p = materialize(probs(spark, d), "probs").select(F.array_max("p").alias("x"), (F.array_position("p", F.array_max("p")) - 1 == C("y")).cast("int").alias("y"))
    return r6(M.platt_isotonic(materialize(p, "tops")).groupBy(F.round("x", 2).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.avg("platt").alias("platt"), F.avg("isotonic").alias("isotonic")), "platt", "isotonic", digits=4)


@query("M22", "loo_folds")
def _(spark, d):
    i = materialize(incidents(spark, d).withColumn("seed", C("vec_id") % 3), "incidents")

    def score(t, test):
        s = R.score_stages(test.withColumn("fold_t", F.lit(t)), "vec_id", W, B, t, SH).where("rank = 1").select("vec_id", C("stage").alias("s1"))
        raw = test.select("vec_id", "y", (F.array_position("z", F.array_max("z")) - 1).alias("r"))
        idx = F.array_position(F.array(*[F.lit(x) for x in STAGES]), C("s1")) - 1
        return raw.join(s, "vec_id").select((C("r") == C("y")).alias("hit_before"), (idx == C("y")).alias("hit_after"))
    return M.loo_folds(i, "seed", lambda tr: R.fit_temperature(tr.select("y", F.transform("z", lambda x: F.asinh(x)).alias("l"))).first()["temperature"], score)

