"""Partial pooling of per-context means. Cells: metric, ctx, y (mean), v (sampling variance of the mean)."""
from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .storage import materialize

# Executors need not have this package installed: its small quantile helpers travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

C = F.col
SALTS = 32


def cells_of(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Means, sampling variances and squared deviations of raw observations per cell."""
    g = obs.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("y"), F.var_samp("value").alias("s2"))
    return g.withColumn("v", F.coalesce(C("s2") / C("n"), F.lit(0.0))).withColumn("m2", F.coalesce(C("s2") * (C("n") - 1), F.lit(0.0)))


def _dl(cells: DataFrame, key: list[str]) -> DataFrame:
    """Method-of-moments between-cell variance and the sums it needs, one row per metric."""
    w = 1.0 / C("v")
    ok = F.when(C("v") > 0, w)
    s = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("j"), F.min("v").alias("v_min"), F.avg("v").alias("v_mean"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
                                F.avg("y").alias("grand"), F.sum(ok).alias("sw"), F.sum(ok * ok).alias("sw2"), F.sum(ok * C("y")).alias("swy"))
    mu = C("swy") / C("sw")
    q = cells.join(s.select(*key, mu.alias("mu_fe")), key).groupBy(*key).agg(
        F.max("mu_fe").alias("mu_fe"), F.sum(ok * F.pow(C("y") - C("mu_fe"), 2)).alias("q"))
    c = C("sw") - C("sw2") / C("sw")
    why = (F.when(C("j") < 2, "single cell").when(C("v_min") <= 0, "zero sampling variance").when(C("y_max") - C("y_min") <= 0, "identical values").when(c <= 0, "degenerate weights"))
    return s.join(q, key).withColumn("c", c).withColumn("why", why).withColumn(
        "tau2", F.when(C("why").isNull(), F.greatest(F.lit(0.0), (C("q") - (C("j") - 1)) / C("c"))).otherwise(0.0))


def partial_pool(cells: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shrunk cells, one summary per metric). Degenerate metrics keep raw means and say why."""
    d = _dl(cells, key)
    ws = 1.0 / (C("v") + C("tau2"))
    applied = C("why").isNull()
    re = cells.join(d.select(*key, "tau2", "why"), key).where(applied).groupBy(*key).agg(
        (F.sum(ws * C("y")) / F.sum(ws)).alias("mu_re"), (F.pow(F.sum(ws), 2) / F.sum(ws * ws)).alias("ess_re"))
    ess = F.when(applied, C("ess_re")).when(C("why") == "identical values", C("j").cast("double")).otherwise(1.0)
    summary = d.join(re, key, "left").select(*key, "j", "tau2", F.when(applied, C("mu_re")).otherwise(C("grand")).alias("mu"), ess.alias("ess"),
                                             F.coalesce("why", F.lit("applied")).alias("method"), "q", "v_min", "v_mean", "sw", "mu_fe", "y_min", "y_max")
    lam = F.when(C("method") == "applied", C("v") / (C("v") + C("tau2"))).when(C("method") == "identical values", 1.0).otherwise(0.0)
    shrunk = cells.join(summary.select(*key, "tau2", "mu", "method"), key).withColumn("lambda", lam).withColumn(
        "shrunk", F.when(C("method") == "applied", C("lambda") * C("mu") + (1 - C("lambda")) * C("y")).otherwise(C("y")))
    return shrunk, summary


def grid_curves(cells: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Q, RE mean and log-likelihoods of every (metric, tau²) point; ``grid``: metric, tau2. Aggregated as joined."""
    w = 1.0 / (C("v") + C("tau2"))
    g = cells.join(grid, key).groupBy(*key, "tau2").agg(
        F.sum(w).alias("sw"), F.sum(w * C("y")).alias("swy"), F.sum(w * (C("y") - C("y0")) * (C("y") - C("y0"))).alias("syy"),
        F.sum(w * (C("y") - C("y0"))).alias("sy"), F.sum(F.ln(C("v") + C("tau2"))).alias("slog"))
    q = C("syy") - C("sy") * C("sy") / C("sw")
    return g.select(*key, "tau2", q.alias("q"), (C("swy") / C("sw")).alias("mu"), C("sw").alias("sw"),
                    (-0.5 * (C("slog") + q + F.ln("sw"))).alias("reml"), (-0.5 * (C("slog") + q)).alias("ml"))


POINTS = 33


def _refine(cells: DataFrame, key: list[str], bracket: DataFrame, method: str, rounds: int) -> DataFrame:
    """Shrink (metric, lo, hi) brackets: evaluate 33 points, keep the neighbours of the best or of the sign change."""
    step = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i")
    extra = [c for c in bracket.columns if c not in (*key, "lo", "hi")]
    for _ in range(rounds):
        pts = bracket.select(*key, "lo", "hi", *extra, step).withColumn("t", C("lo") + (C("hi") - C("lo")) * C("i") / F.lit(float(POINTS - 1)))
        tau2 = F.exp(2 * C("t")) if method == "pc" else C("t")
        curves = grid_curves(cells, pts.select(*key, tau2.alias("tau2")).distinct(), key)
        e = pts.withColumn("tau2", tau2).join(curves, [*key, "tau2"])
        h = (C("hi") - C("lo")) / F.lit(float(POINTS - 1))
        if method in ("reml", "pc"):
            score = C("reml") if method == "reml" else C("ml") - C("lam") * F.exp("t") + C("t")
            best = F.max_by(F.struct("t", h.alias("h")), F.struct(score, -C("i")))
        else:  # the last point where Q is still above the target
            best = F.max_by(F.struct("t", h.alias("h")), F.when(C("q") >= C("target"), C("i")))
        g = e.groupBy(*key).agg(best.alias("b"), *[F.max(x).alias(x) for x in extra])
        lo = C("b.t") - (C("b.h") if method in ("reml", "pc") else 0)
        bracket = materialize(g.select(*key, (lo if method == "pc" else F.greatest(lo, F.lit(0.0))).alias("lo"), (C("b.t") + C("b.h")).alias("hi"), *extra), "bracket")
    return bracket


def tau2_grid(cells: DataFrame, key: list[str], method: str = "reml", rounds: int = 8, upper: float = 0.05) -> DataFrame:
    """tau² per metric by REML, Paule–Mandel (``pm``) or the PC-prior mode (``pc``): fixed rounds of grid refinement.

    Degenerate metrics give 0 (the small floor 1e-8 for ``pc``) with the reason. The relative width left is 16^-rounds."""
    d = _dl(cells, key)
    g = cells.groupBy(*key).agg(F.var_pop("y").alias("pv"), F.max("v").alias("vm"), F.stddev_samp("y").alias("sd"))
    base = materialize(d.join(g, key), "pool")
    cells = materialize(cells.join(base.select(*key, C("grand").alias("y0"), C("why").alias("__w")), key).where("__w is null or __w = 'degenerate weights'").drop("__w"), "cells")
    live = base.where("why is null or why = 'degenerate weights'")
    span = F.greatest(F.lit(1.0), 10.0 * C("pv") + C("vm"))
    if method == "reml":
        b = live.select(*key, F.lit(0.0).alias("lo"), span.alias("hi"))
    elif method == "pm":
        b = live.where(C("q") > C("j") - 1).select(*key, F.lit(0.0).alias("lo"), (4 * C("pv") + span).alias("hi"), (C("j") - 1).cast("double").alias("target"))
    else:
        lam = -F.ln(F.lit(upper)) / C("sd")
        b = live.select(*key, (F.ln("sd") - 16).alias("lo"), (F.ln("sd") + 8).alias("hi"), lam.alias("lam"))
    b = _refine(cells, key, b, method, rounds)
    mid = (C("lo") + C("hi")) / 2
    t2 = b.select(*key, (F.exp(2 * mid) if method == "pc" else mid).alias("tau2"))
    mu = grid_curves(cells, t2, key).select(*key, "tau2", "mu", "sw")
    floor = 1e-8 if method == "pc" else 0.0
    note = F.when(C("why").isNotNull() & (C("why") != "degenerate weights"), C("why"))
    if method == "pm":
        note = F.coalesce(note, F.when(C("q") <= C("j") - 1, "truncated"))
    return base.drop("sw").join(mu.select(*key, C("tau2").alias("t2"), C("mu").alias("mt"), "sw"), key, "left").select(
        *key, "j", F.coalesce("t2", F.lit(floor)).alias("tau2"), F.coalesce("mt", "grand").alias("mu"), F.coalesce(note, F.lit("applied")).alias("method"), "sw")


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * lead
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return 1.0 - lead * h
    raise ArithmeticError(f"the continued fraction did not settle for a={a}, x={x}")


def _bisect(f, lo: float, hi: float) -> float:
    while f(hi) < 0:
        hi *= 2
        if hi > 1e12:
            return math.nan
    while lo < (mid := (lo + hi) / 2) < hi:
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _each(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """One evaluation for each distinct pair of arguments."""
    known = {k: f(*k) for k in set(zip(a, b))}
    return pd.Series([known[k] for k in zip(a, b)])


def chi2_ppf(p: float, df: float) -> float:
    return _bisect(lambda x: _gamma_p(df / 2, x / 2) - p, 0.0, df + 10.0)


def t_ppf(p: float, df: int) -> float:
    """Student quantile for p > 1/2, from the distribution integrated with Simpson's rule in the angle."""
    n = 2000
    def cdf(x):
        th = math.atan(x / math.sqrt(df))
        g = np.cos(np.linspace(0.0, th, n + 1)) ** (df - 1)
        area = th / n / 3 * (g[0] + g[-1] + 4 * g[1:-1:2].sum() + 2 * g[2:-1:2].sum())
        return 0.5 + area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return _bisect(lambda x: cdf(x) - p, 0.0, 10.0)


@pandas_udf(DoubleType())
def chi2_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_ppf, p, df)


@pandas_udf(DoubleType())
def chi2_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: 1.0 - _gamma_p(b / 2, a / 2), q, df)


@pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: t_ppf(a, int(b)), p, df)


def q_profile(cells: DataFrame, key: list[str], level: float = 0.95, rounds: int = 10) -> DataFrame:
    """Interval of tau per metric: where Q(tau²) meets the two chi-square quantiles. Refuses fewer than two cells and zero
    variances (no row); identical values give [0, inf)."""
    base = _dl(cells, key)
    pv = cells.groupBy(*key).agg(F.var_pop("y").alias("pv"), F.max("v").alias("vm"))
    ok = base.where("j >= 2 and v_min > 0").join(pv, key)
    a = (1 - level) / 2
    ok = materialize(ok.withColumn("df", (C("j") - 1).cast("double")).withColumn("c_lo", chi2_quantile(F.lit(a), C("df"))).withColumn("c_hi", chi2_quantile(F.lit(1 - a), C("df"))), "qprofile")
    live = ok.where("y_max > y_min")
    cc = materialize(cells.join(live.select(*key, C("grand").alias("y0")), key), "cells")
    out = ok
    for name, target in (("lo", "c_hi"), ("hi", "c_lo")):
        hi = C("j") * C("pv") / C(target) * 2 + C("vm")
        b = live.where(C("q") > C(target)).select(*key, F.lit(0.0).alias("lo"), hi.alias("hi"), C(target).alias("target"))
        b = _refine(cc, key, b, "root", rounds)
        out = out.join(b.select(*key, ((C("lo") + C("hi")) / 2).alias(f"t_{name}")), key, "left")
    flat = C("y_max") <= C("y_min")
    return out.select(*key, "j", F.sqrt(F.coalesce("t_lo", F.lit(0.0))).alias("lo"),
                      F.when(flat, F.lit(float("inf"))).otherwise(F.sqrt(F.coalesce("t_hi", F.lit(0.0)))).alias("hi"))


def prediction_interval(cells: DataFrame, key: list[str], level: float = 0.95, rounds: int = 8) -> DataFrame:
    """mu ± t(k−2)·sqrt(tau² + 1/Σw) for a new context, tau² by REML; no row for fewer than three cells or zero variances."""
    r = tau2_grid(cells, key, "reml", rounds).where("j >= 3 and method in ('applied', 'identical values')")
    flat = cells.groupBy(*key).agg(F.sum(F.when(C("v") > 0, 1.0 / C("v"))).alias("sw0"), F.min("v").alias("v_min"))
    r = r.join(flat, key).where("v_min > 0").withColumn("sw", F.coalesce("sw", "sw0"))
    half = t_quantile(F.lit(1 - (1 - level) / 2), (C("j") - 2).cast("double")) * F.sqrt(C("tau2") + 1.0 / C("sw"))
    return r.withColumn("half", half).select(*key, "j", "mu", "tau2", (C("mu") - C("half")).alias("lo"), (C("mu") + C("half")).alias("hi"))


def map_prior(cells: DataFrame, key: list[str], weight: float = 0.5, vague_var: float = 1.0) -> DataFrame:
    """Informative mean and variance of the history with its effective weight; zero variance leaves only the vague part."""
    d = _dl(cells, key)
    zero, one = C("v_min") <= 0, C("j") < 2
    h = F.when(zero, 1.0).when(one, 0.0).otherwise(C("tau2m") / (C("tau2m") + C("v_mean")))
    t = F.when(zero | one, 0.0).otherwise(F.when(C("c") > 0, F.greatest(F.lit(0.0), (C("q") - (C("j") - 1)) / C("c"))).otherwise(0.0))
    return d.withColumn("tau2m", t).withColumn("conflict", h).select(
        *key, F.when(zero, C("grand")).otherwise(C("mu_fe")).alias("mean"), F.when(zero, F.lit(float("inf"))).otherwise(1.0 / C("sw")).alias("var"),
        F.lit(vague_var).alias("vague_var"), F.when(zero, 0.0).otherwise(weight * (1 - C("conflict"))).alias("weight"), C("tau2m").alias("tau2"), "conflict")


def james_stein(cells: DataFrame, key: list[str]) -> DataFrame:
    """Positive-part shrinkage toward the grand mean; raw means for fewer than three groups, no spread or no noise."""
    s = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("p"), F.avg("y").alias("grand"), (F.var_pop("y") * F.count(F.lit(1))).alias("spread"), F.avg("v").alias("s2"))
    c = F.when((C("p") < 3) | (C("spread") <= 0) | (C("s2") <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - (C("p") - 2) * C("s2") / C("spread"))))
    return cells.join(s.withColumn("factor", c).select(*key, "grand", "factor"), key).withColumn("shrunk", C("grand") + C("factor") * (C("y") - C("grand")))


def loo_mse(obs: DataFrame, key: list[str], ctx: str) -> DataFrame:
    """Leave-one-observation-out error of pooled, unpooled and partial predictors per metric.

    Equal observations of a cell share one held-out row. Moments without the held-out value come from the cell's moments;
    the held-out rows are joined with the metric's cells (contexts), salted so that one metric does not fill one task."""
    cells = materialize(cells_of(obs, [*key, ctx]), "loo-cells")
    held = obs.groupBy(*key, ctx, C("value").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")).withColumn("salt", F.pmod(F.xxhash64("x", ctx), F.lit(SALTS)).cast("int"))
    own = cells.select(*key, ctx, C("n").alias("n0"), C("y").alias("y0"), C("m2").alias("m0"))
    tot = cells.groupBy(*key).agg(F.sum("n").alias("n_all"), F.sum(C("n") * C("y")).alias("s_all"), F.count(F.lit(1)).alias("cells"))
    h = materialize(held.join(own, [*key, ctx]).join(tot, key).where("cells >= 2").withColumnRenamed(ctx, "hc"), "held")
    wide = cells.select(*key, C(ctx).alias("oc"), "n", "y", "m2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    j = h.join(wide, [*key, "salt"])
    mine = C("oc") == C("hc")
    n1 = C("n") - 1
    y1 = F.when(n1 > 0, C("y") - (C("x") - C("y")) / n1)
    m1 = C("m2") - (C("x") - C("y")) * (C("x") - y1)
    j = j.where(~mine | (C("n") > 1)).select(*key, "hc", "x", "c", "n_all", "s_all", mine.alias("mine"), F.when(mine, y1).otherwise(C("y")).alias("y"),
                                             F.when(mine, n1).otherwise(C("n")).alias("nn"), F.when(mine, F.greatest(m1, F.lit(0.0))).otherwise(C("m2")).alias("m2"))
    v = F.when((C("nn") >= 2) & (C("m2") > 1e-12), C("m2") / (C("nn") - 1) / C("nn")).otherwise(0.0)
    j = materialize(j.withColumn("v", v), "loo")
    hk = [*key, "hc", "x"]
    mine_y = j.where("mine").select(*hk, C("y").alias("own_y"), C("v").alias("own_v"))
    summ = partial_pool(j.select(*hk, "y", "v"), hk)[1]
    n = h.select(*hk, "c", "n_all", "s_all").join(summ.select(*hk, "mu", "tau2", "method"), hk).join(mine_y, hk, "left")
    pooled = (C("s_all") - C("x")) / (C("n_all") - 1)
    lam = C("own_v") / (C("own_v") + C("tau2"))
    part = F.when(C("own_y").isNull(), C("mu")).when(C("method") == "applied", lam * C("mu") + (1 - lam) * C("own_y")).otherwise(C("own_y"))
    def mse(p):
        return F.sum(C("c") * F.pow(p - C("x"), 2)) / F.sum("c")
    return n.groupBy(*key).agg(F.sum("c").alias("n"), mse(pooled).alias("pooled"), mse(F.coalesce("own_y", pooled)).alias("unpooled"), mse(part).alias("partial"))


CELL_BLOCK, TARGET_BLOCK, AT_ONCE = 8192, 8192, 1 << 20


def re_sums(targets: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, own, s0, s1): sums of 1 / (v + tau2) and of y / (v + tau2) over the other cells of the metric, for each target (key, own, tau2).

    Targets and cells (key, own, y, v) meet in tiles; a tile gives one row for each of its targets, no pair is stored."""
    parts = lambda df, size: -(-(df.groupBy(*key).count().agg(F.max("count")).first()[0] or 1) // size)
    tp, cp = parts(targets, TARGET_BLOCK), parts(cells, CELL_BLOCK)
    t = targets.select(*key, "own", "tau2", F.pmod("own", F.lit(tp)).alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cp - 1).cast("long"))).alias("_c"))
    c = cells.select(*key, "own", "y", "v", F.pmod("own", F.lit(cp)).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tp - 1).cast("long"))).alias("_t"))

    def tile(left, right):
        own, tau2 = left["own"].to_numpy(), left["tau2"].to_numpy()
        other, y, v = (right[x].to_numpy() for x in ("own", "y", "v"))
        s0, s1 = np.zeros(len(own)), np.zeros(len(own))
        step = max(1, AT_ONCE // max(len(other), 1))
        for i in range(0, len(own), step):
            at = slice(i, i + step)
            with np.errstate(divide="ignore"):
                w = np.where(own[at, None] == other, 0.0, 1.0 / (v + tau2[at, None]))
            s0[at], s1[at] = w.sum(axis=1), w @ y
        return left.select([*key, "own"]).append_column("s0", pa.array(s0)).append_column("s1", pa.array(s1))

    head = ", ".join(f"`{k}` {targets.schema[k].dataType.simpleString()}" for k in key)
    both = t.groupBy(*key, "_t", "_c").cogroup(c.groupBy(*key, "_t", "_c")).applyInArrow(tile, f"{head}, own bigint, s0 double, s1 double")
    return both.groupBy(*key, "own").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


def loo_context_mse(obs: DataFrame, key: list[str], ctx: str) -> DataFrame:
    """Leave-one-context-out error: pooled grand mean and RE mean of the other cells; there is nothing unpooled to predict from.

    The sums of a metric without one context are those of the metric less the context's own; only the RE mean, whose weights depend on that
    variance, is summed again, in tiles. A metric with one context has no row."""
    cells = materialize(cells_of(obs, [*key, ctx]).withColumn("own", F.xxhash64(ctx)), "loc-cells")
    ends = cells.groupBy(*key).agg(F.avg("y").alias("y0"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    w = F.when(C("v") > 0, 1.0 / C("v"))
    zero = F.lit(0.0)
    own_w, dy = F.coalesce(w, zero), C("y") - C("y0")
    one = cells.join(ends, key).withColumns({"w": own_w, "dy": dy, "bare": (C("v") <= 0).cast("long"), "low": (C("y") == C("y_min")).cast("long"), "high": (C("y") == C("y_max")).cast("long")})
    one = one.withColumns({"w2": C("w") * C("w"), "wy": C("w") * C("dy"), "wyy": C("w") * C("dy") * C("dy"), "ny": C("n") * C("y")})
    summed = ("w", "w2", "wy", "wyy", "bare", "low", "high", "n", "ny", "y")
    tot = one.groupBy(*key).agg(F.count(F.lit(1)).alias("cells"), *[F.sum(x).alias(f"all_{x}") for x in summed])
    h = one.join(tot, key).where("cells >= 2").withColumns({f"r_{x}": C(f"all_{x}") - C(x) for x in summed}).withColumn("j", C("cells") - 1)
    same = (C("y_max") <= C("y_min")) | (C("r_low") == 0) & (C("r_high") == C("j")) | (C("r_high") == 0) & (C("r_low") == C("j"))
    c = C("r_w") - F.try_divide("r_w2", "r_w")
    q = C("r_wyy") - F.try_divide(C("r_wy") * C("r_wy"), "r_w")
    applied = (C("j") >= 2) & (C("r_bare") == 0) & ~same & F.coalesce(C("c") > 0, F.lit(False))
    h = h.withColumn("c", c).withColumn("q", q).withColumn("applied", applied)
    h = materialize(h.select(*key, "own", "n", "y", "m2", "applied", F.when(C("applied"), F.greatest(zero, (C("q") - (C("j") - 1)) / C("c"))).alias("tau2"),
                             (C("r_y") / C("j")).alias("grand"), (C("r_ny") / C("r_n")).alias("pooled")), "held-contexts")
    sums = re_sums(h.where("applied").select(*key, "own", "tau2"), cells.select(*key, "own", "y", "v"), key)
    e = h.join(sums, [*key, "own"], "left").withColumn("mu", F.when(C("applied"), C("s1") / C("s0")).otherwise(C("grand")))
    def mse(p):
        return F.sum(C("m2") + C("n") * F.pow(C(p) - C("y"), 2)) / F.sum("n")
    return e.groupBy(*key).agg(F.sum("n").alias("n"), mse("pooled").alias("pooled"), mse("mu").alias("partial"), F.lit(None).cast("double").alias("unpooled"))


def borrow_gate(cells: DataFrame, key: list[str], box_alpha: float = 0.05, z_cap: float = 2.0, ess_cap: float | None = None, threshold: float | None = None, level: float = 0.95) -> DataFrame:
    """Pool only if heterogeneity, conflict, effective size and the new-context interval all pass and at least three contexts
    are measured and not synthetic (cells carry ``measured``); else raw means with the first failing check."""
    _, s = partial_pool(cells, key)
    bad = (C("j") < 2) | (C("v_min") <= 0)
    s = s.withColumn("p", F.when(~bad, chi2_tail(F.greatest(C("q"), F.lit(0.0)), (F.greatest(C("j"), F.lit(2)) - 1).cast("double"))))
    z = cells.join(s.select(*key, "mu", "tau2"), key).groupBy(*key).agg(F.max(F.try_divide(F.abs(C("y") - C("mu")), F.sqrt(C("v") + C("tau2")))).alias("zmax"), F.count_if("measured").alias("measured"))
    s = s.join(z, key)
    if threshold is not None:
        s = s.join(prediction_interval(cells, key, level).select(*key, C("lo").alias("pi_lo")), key, "left")
        pi = F.coalesce(C("pi_lo") > threshold, F.lit(False))
    else:
        pi = F.lit(True)
    box = F.coalesce(C("p") >= box_alpha, F.lit(False))
    conflict = ~bad & F.coalesce(C("zmax") <= z_cap, F.lit(False))
    ess = F.lit(True) if ess_cap is None else C("ess") <= ess_cap
    first = F.when(C("measured") < 3, "provenance").when(~box, "box").when(~conflict, "conflict").when(~ess, "ess").when(~pi, "pi").otherwise("borrow")
    return s.withColumn("reason", first).select(*key, "j", "tau2", "ess", "mu", "p", "zmax", "measured", (C("reason") == "borrow").alias("borrow"), "reason")
