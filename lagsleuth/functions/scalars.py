"""Column helpers; all stay inside generated code."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stage order, used for tie-breaks and feature order.
STAGES = ("transport", "preprocess", "queue", "cpu", "scheduler", "gpu", "postprocess", "action")
# Floors and scale tolerance of the robust score.
Z_FLOOR_MS, Z_FLOOR_COUNT, Z_CANDIDATE, REL_TOL, MAD_SCALE = 0.001, 0.25, 2.0, 0.05, 1.4826


def stage_index(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def robust_z(stage: Column, inc_med: Column, base_med: Column, base_mad: Column) -> Column:
    floor = F.when(stage == "queue", F.lit(Z_FLOOR_COUNT)).otherwise(
        F.lit(Z_FLOOR_MS) + F.lit(REL_TOL) * F.abs(base_med))
    return (inc_med - base_med) / (F.lit(MAD_SCALE) * base_mad + floor)


def kernel_short_name(c: Column) -> Column:
    """First identifier containing ``kernel``, else the bare function name; UNKNOWN when nothing is left."""
    s = F.trim(c)
    hit = F.regexp_extract(s, "[A-Za-z_][A-Za-z0-9_]*kernel[A-Za-z0-9_]*", 0)
    head = F.trim(F.regexp_replace(s, r"\(.*$", ""))
    tail = F.trim(F.regexp_replace(head, "^.*::", ""))
    base = F.trim(F.regexp_replace(F.regexp_replace(tail, r"^.*\s", ""), "<.*$", ""))
    plain = F.when(s.rlike(r"[( ]|::"), base).otherwise(s)
    word = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(hit != "", hit).when(word != "", word).otherwise(F.lit("UNKNOWN"))


def us_to_ns(c: Column) -> Column:
    """Microseconds as number or text to whole nanoseconds, in decimals (times since 1970 are beyond a double's whole numbers); null when not a number."""
    return (c.try_cast("decimal(30,6)") * 1000).try_cast("long")


def bounds(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def local_interval(t0: Column, u0: Column, t1: Column, u1: Column, same: Column) -> Column:
    """Duration bounds widened by both uncertainties; null for unlike clocks or an impossible order."""
    d, u = t1 - t0, F.coalesce(u0, F.lit(0)) + F.coalesce(u1, F.lit(0))
    return F.when(same & (d + u >= 0), bounds(d - u, d + u))


def mapped_interval(t0: Column, u0: Column, t1: Column, u1: Column, m: Column) -> Column:
    """Bounds across clocks; ``m`` is a struct (valid_lo, valid_hi, rate_lo, rate_hi, off_lo, off_hi), null if unknown."""
    lo, hi = t0 - u0, t0 + u0
    inside = (lo >= m["valid_lo"]) & (hi <= m["valid_hi"])
    corners = [at * rate + off for at in (lo, hi) for rate in (m["rate_lo"], m["rate_hi"])
               for off in (m["off_lo"], m["off_hi"])]
    a, b = t1 - u1 - F.greatest(*corners), t1 + u1 - F.least(*corners)
    return F.when(m.isNotNull() & inside & (b >= 0), bounds(a, b))


def residual(c_lo, c_hi, s_lo, s_hi, k_lo, k_hi, nested: Column) -> Column:
    """Round trip minus server bounds; struct (raw, kept), kept null when it could be negative."""
    bad = ~nested | (F.least(c_lo, c_hi, s_lo, s_hi) < 0) | (F.least(k_lo, k_hi) <= 0)
    raw = bounds(c_lo - s_hi * k_hi, c_hi - s_lo * k_lo)
    return F.when(~bad, F.struct(raw.alias("raw"), F.when(raw["lo"] >= 0, raw).alias("kept")))


def unwrap_seq(v: Column, checkpoint: Column) -> Column:
    """The 64-bit value nearest to the checkpoint whose low 32 bits are ``v``; null at 2^31 or more away."""
    wrap = F.lit(2**32)
    base = F.floor(checkpoint / wrap).cast("long") * wrap
    near = base + v
    best = (F.when(near - checkpoint >= F.lit(2**31), near - wrap)
            .when(checkpoint - near > F.lit(2**31), near + wrap).otherwise(near))
    return F.when(F.abs(best - checkpoint) < F.lit(2**31), best)


def numeric_bin(v: Column, edges: list) -> Column:
    """How many edges are at or below v (null stays null)."""
    n = F.lit(0)
    for e in edges:
        n = n + F.when(v >= F.lit(e), 1).otherwise(0)
    return F.when(v.isNotNull(), n)


def context_id(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)


def canonical_hash(*names: str) -> Column:
    """sha256 of the named columns as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def tail_llr(k1: Column, n1: Column, k0: Column, n0: Column) -> Column:
    return F.ln((k1 + 1) / (n1 + 2)) - F.ln((k0 + 1) / (n0 + 2))


def entropy_bits(p: Column) -> Column:
    """Shannon entropy of an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den > 0, dot(a, b) / den).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def stamp(commit, fault, seed, env: dict[str, str], signature: Column | None = None) -> Column:
    """Provenance struct put on every row; what is not known is said to be unknown."""
    env_map = F.create_map(*[x for k, v in sorted(env.items()) for x in (F.lit(k), F.lit(v))])
    unknown = F.lit("unknown")
    text = lambda v: unknown if v is None else (v if isinstance(v, Column) else F.lit(str(v)))
    return F.struct(text(commit).alias("commit"), text(fault).alias("fault"), text(seed).alias("seed"),
                    env_map.alias("env"), (signature if signature is not None else F.lit(None)).alias("failure_signature"))
