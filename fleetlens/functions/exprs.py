"""Scalar column functions. All are built-in expressions unless noted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

U32 = 0xFFFFFFFF

# Hash multipliers and the 64-bit finaliser constants.
PCG_MUL = 747796405
PCG_ADD = 2891336453
PCG_OUT = 277803737
HIGH_WORD_MUL = 2654435769
SPLITMIX_ADD = 0x9E3779B97F4A7C15
SPLITMIX_MUL1 = 0xBF58476D1CE4E5B9
SPLITMIX_MUL2 = 0x94D049BB133111EB

# Sizing, correction, trust and tone-map limits.
LEASE_HEADROOM = 0.5
PROBE_DIVISOR = 8.0
MAX_UNITS_PER_TASK = 4294967295
MIN_CORRECTION = 0.1
MAX_CORRECTION = 1000.0
MAX_BENCHMARK_SCORE = 1e15
TRUSTED_AT = 0.90
REQUIRED_AGREEMENT = 2
MAX_REPLICAS = 4
PRIOR_ALPHA = 2.0
PRIOR_BETA = 2.0
SEARCH_MASK = 0xFFF
SEARCH_ROUNDS = 8

# Task states in their stored order, and the legal transitions.
STATES = ["Queued", "Leased", "Validating", "NeedsReplica", "Accepted", "Rejected", "Cancelled"]
TERMINAL = ["Accepted", "Rejected", "Cancelled"]
EVENTS = ["Grant", "Renew", "Submit", "LeaseExpired", "Release",
          "Accept", "Reject", "Disagreement", "IssueReplica", "Cancel"]
TRANSITIONS = {
    ("Queued", "Grant"): "Leased",
    ("Leased", "Renew"): "Leased",
    ("Leased", "Submit"): "Validating",
    ("Leased", "LeaseExpired"): "Queued",
    ("Leased", "Release"): "Queued",
    ("Leased", "Cancel"): "Cancelled",
    ("Validating", "Accept"): "Accepted",
    ("Validating", "Reject"): "Rejected",
    ("Validating", "Disagreement"): "NeedsReplica",
    ("Validating", "Cancel"): "Cancelled",
    ("NeedsReplica", "IssueReplica"): "Queued",
    ("NeedsReplica", "Cancel"): "Cancelled",
}


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def is_finite(v: Column) -> Column:
    d = v.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


# ---- integer hashing -------------------------------------------------------

def _shr(v: Column, bits: Column) -> Column:
    return F.call_function("shiftright", v, bits.cast("int"))


def pcg_state(v: Column) -> Column:
    return (v.bitwiseAND(F.lit(U32)) * F.lit(PCG_MUL) + F.lit(PCG_ADD)).bitwiseAND(F.lit(U32))


def pcg_word(state: Column) -> Column:
    mixed = _shr(state, F.shiftright(state, 28) + F.lit(4)).bitwiseXOR(state)
    return (mixed * F.lit(PCG_OUT)).bitwiseAND(F.lit(U32))


def pcg_fold(word: Column) -> Column:
    return F.shiftright(word, 22).bitwiseXOR(word)


def pcg_hash(v) -> Column:
    """One hash round of a bigint's low 32 bits."""
    return pcg_fold(pcg_word(pcg_state(_c(v).cast("long"))))


def with_pcg_rounds(df: DataFrame, column: str, rounds: int) -> DataFrame:
    """Replace ``column`` by ``rounds`` applications of :func:`pcg_hash`.

    Each step is its own projection. A step refers to the one before it more
    than once, so the optimiser keeps the projections apart and the whole chain
    compiles into one generated stage; nesting the expressions instead would
    double their size with every round. Do not filter on the result directly:
    a pushed-down filter would inline the chain. Aggregate conditionally.
    """
    rest = [c for c in df.columns if c != column]
    for _ in range(rounds):
        df = df.select(*rest, pcg_state(F.col(column)).alias(column))
        df = df.select(*rest, pcg_word(F.col(column)).alias(column))
        df = df.select(*rest, pcg_fold(F.col(column)).alias(column))
    return df


@pandas_udf(LongType())
def _mix32(v: pd.Series) -> pd.Series:
    x = v.to_numpy(dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(SPLITMIX_ADD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(SPLITMIX_MUL1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(SPLITMIX_MUL2)
        x = (x ^ (x >> np.uint64(31))) >> np.uint64(32)
    return pd.Series(x.astype(np.int64))


def mix32(v) -> Column:
    """High 32 bits of the 64-bit finaliser; Arrow-batched because the
    multiply must wrap, which bigint arithmetic in ANSI mode refuses to do."""
    return _mix32(F.coalesce(_c(v).cast("long"), F.lit(0)))


def range_params(df: DataFrame, start="start_unit", count="unit_count", seed="seed") -> DataFrame:
    """Search parameters of a range; a range too long for 32 bits is flagged
    in ``param_error`` rather than narrowed."""
    s, n, j = F.col(start), F.col(count), F.col(seed)
    return (
        df.withColumn("start_lo", s.bitwiseAND(F.lit(U32)))
        .withColumn("base_hi", F.shiftrightunsigned(s, 32))
        .withColumn("range_seed", mix32(j.bitwiseXOR(s)))
        .withColumn("mask", F.lit(SEARCH_MASK).cast("long"))
        .withColumn("target", mix32(j).bitwiseAND(F.lit(SEARCH_MASK)))
        .withColumn("rounds", F.lit(SEARCH_ROUNDS).cast("long"))
        .withColumn("param_error", F.when(n > F.lit(U32), F.lit("unit_count exceeds 32 bits")))
    )


# ---- float comparison ------------------------------------------------------

def ordered_bits(bits) -> Column:
    """Signed rank of a float32 bit pattern. Negative values count down from
    zero, so the smallest values of either sign are two steps apart."""
    b = _c(bits)
    return F.when(b >= F.lit(0x80000000), -b.bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(b)


def _bits_not_finite(b: Column) -> Column:
    return b.bitwiseAND(F.lit(0x7F800000)) == F.lit(0x7F800000)


def is_nan_bits(bits) -> Column:
    b = _c(bits)
    return _bits_not_finite(b) & (b.bitwiseAND(F.lit(0x007FFFFF)) != 0)


def ulp_distance_bits(a, b) -> Column:
    a, b = _c(a), _c(b)
    zero = (a.bitwiseAND(F.lit(0x7FFFFFFF)) == 0) & (b.bitwiseAND(F.lit(0x7FFFFFFF)) == 0)
    return (
        F.when(((a == b) & ~is_nan_bits(a)) | zero, F.lit(0).cast("long"))
        .when(_bits_not_finite(a) | _bits_not_finite(b), F.lit(U32).cast("long"))
        .otherwise(F.least(F.abs(ordered_bits(a) - ordered_bits(b)), F.lit(U32)))
    )


def float_rank(v) -> Column:
    """Signed rank of a finite float32 held as a number: the arithmetic twin of
    :func:`ordered_bits`. All scaling is by powers of two and therefore exact.
    The logarithm can only miss its floor at an exact power of two, where both
    exponents give the same rank; the logarithm of zero is null and skipped."""
    d = _c(v).cast("double")
    mag = F.abs(d)
    exp = F.greatest(F.floor(F.log2(mag)), F.lit(-126).cast("long"))
    rank = (exp + F.lit(126)) * F.lit(8388608.0) + mag * F.pow(F.lit(2.0), F.lit(23) - exp)
    return (F.signum(d) * rank).cast("long")


def ulp_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    fa, fb = is_finite(a), is_finite(b)
    # Spark treats NaN as equal to itself, so equality is tested on non-NaN only.
    same = (a == b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
    return (
        F.when(same, F.lit(0).cast("long"))
        .when(~fa | ~fb, F.lit(U32).cast("long"))
        .otherwise(F.least(F.abs(float_rank(a) - float_rank(b)), F.lit(U32)))
    )


def deviation(a, b, abs_eps: float, rel_eps: float) -> dict[str, Column]:
    """abs, rel and allowed difference of ``a`` against ``b`` (asymmetric)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    diff, denom = F.abs(a - b), F.abs(b)
    return {
        "abs_diff": diff,
        "rel_diff": F.when(denom > 0, diff / denom).otherwise(F.lit(0.0)),
        "allowed": F.lit(float(abs_eps)) + F.lit(float(rel_eps)) * denom,
    }


def severity(max_ulp, max_rel) -> Column:
    u, r = _c(max_ulp), _c(max_rel).cast("double")
    graded = F.lit(0.5) + (F.log10(F.greatest(r, F.lit(1e-9))) + F.lit(9.0)) * F.lit(0.4)
    return (
        F.when(u <= 16, F.lit(0.25))
        .when(~is_finite(r), F.lit(4.0))
        .otherwise(F.least(F.greatest(graded, F.lit(0.5)), F.lit(4.0)))
    )


# ---- trust, sizing, correction --------------------------------------------

def beta_score(alpha, beta) -> Column:
    """Share of good evidence; an unknown worker (null) scores the prior."""
    a = F.coalesce(_c(alpha), F.lit(PRIOR_ALPHA))
    b = F.coalesce(_c(beta), F.lit(PRIOR_BETA))
    return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))


def required_agreement(policy, score, probation, blacklisted) -> Column:
    p = _c(policy)
    return (
        F.when(p == "none", F.lit(1))
        .when(p == "fixed2x", F.lit(REQUIRED_AGREEMENT))
        .when(_c(probation) | _c(blacklisted), F.lit(MAX_REPLICAS))
        .when(_c(score) >= TRUSTED_AT, F.lit(1))
        .otherwise(F.lit(REQUIRED_AGREEMENT))
        .cast("long")
    )


def throttle_clamp(level) -> Column:
    return F.least(F.greatest(_c(level).cast("double"), F.lit(0.0)), F.lit(1.0))


def score_sanitise(score, flop_per_unit=1.0) -> Column:
    """Usable units/s, or null when the reported score is not a positive number."""
    s = _c(score).cast("double")
    flop = _c(flop_per_unit).cast("double")
    flop = F.when(flop > 0, flop).otherwise(F.lit(1.0))
    return F.when(is_finite(s) & (s > 0), F.least(s, F.lit(MAX_BENCHMARK_SCORE)) / flop)


def task_size(score, correction, throttle, target_ms, lease_ms, floor, remaining, cold_start) -> Column:
    """Units to grant; the order of the limits is part of the rule."""
    s, c = _c(score).cast("double"), _c(correction).cast("double")
    t = throttle_clamp(throttle)
    remaining = _c(remaining).cast("long")
    corr = F.when(is_finite(c) & (c > 0), c).otherwise(F.lit(1.0))
    probe = F.when(_c(cold_start), F.lit(PROBE_DIVISOR)).otherwise(F.lit(1.0))
    wanted = _c(target_ms).cast("double") / 1000.0 * s * t / (corr * probe)
    cap = _c(lease_ms).cast("double") / 1000.0 * LEASE_HEADROOM * s * t / (corr * probe)
    units = F.least(wanted, cap)
    units = F.when(is_finite(units) & (units >= 1.0), units).otherwise(F.lit(1.0))
    # Anything above the ceiling is cut to it below, so cutting before the cast is the same.
    whole = F.floor(F.least(units, F.lit(float(MAX_UNITS_PER_TASK)))).cast("long")
    sized = F.least(F.greatest(whole, _c(floor).cast("long")), F.lit(MAX_UNITS_PER_TASK), remaining)
    return (
        F.when(remaining == 0, F.lit(0).cast("long"))
        .when(~is_finite(s) | (s <= 0), F.lit(0).cast("long"))
        .when(t == 0, F.lit(0).cast("long"))
        .otherwise(sized)
    )


def correction_step(current, predicted, actual, alpha: float = 0.3) -> Column:
    cur, p, a = _c(current).cast("double"), _c(predicted).cast("double"), _c(actual).cast("double")
    ok = is_finite(p) & is_finite(a) & (p > 0) & (a > 0)
    w = min(max(float(alpha), 0.0), 1.0)

    def clamp(v):
        return F.least(F.greatest(v, F.lit(MIN_CORRECTION)), F.lit(MAX_CORRECTION))

    ratio = clamp(a / F.when(ok, p))
    return F.when(ok, clamp(F.lit(1.0 - w) * cur + F.lit(w) * ratio)).otherwise(cur)


# ---- geometry and display --------------------------------------------------

def tile_at(index, image_w, image_h, tile_w, tile_h) -> Column:
    """Origin and clipped size of a row-major tile; null outside the grid."""
    i = _c(index).cast("long")
    iw, ih, tw, th = (_c(v).cast("long") for v in (image_w, image_h, tile_w, tile_h))
    usable = (tw > 0) & (th > 0)
    tw1, th1 = F.greatest(tw, F.lit(1)), F.greatest(th, F.lit(1))
    nx, ny = F.ceil(iw / tw1), F.ceil(ih / th1)
    nx1 = F.greatest(nx, F.lit(1))
    x = (i % nx1) * tw1
    y = F.floor(i / nx1) * th1
    return F.when(
        usable & (i >= 0) & (i < nx * ny),
        F.struct(x.alias("x"), y.alias("y"),
                 F.least(tw1, iw - x).alias("w"), F.least(th1, ih - y).alias("h")),
    )


def tone_map(mean, exposure=1.0) -> Column:
    m = _c(mean).cast("double") * F.lit(float(exposure))
    shown = F.pow(F.least(m, F.lit(1.0)), F.lit(1.0 / 2.2)) * 255.0
    return F.when(F.isnan(m) | (m <= 0) | m.isNull(), F.lit(0).cast("long")).otherwise(
        F.floor(shown + 0.5).cast("long"))


def transition(state, event) -> Column:
    """Next state, or null for an illegal pair."""
    s, e = _c(state), _c(event)
    out = F.lit(None).cast("string")
    for (frm, ev), to in TRANSITIONS.items():
        out = F.when((s == frm) & (e == ev), F.lit(to)).otherwise(out)
    return out


def finite_or_null(v) -> Column:
    return F.when(is_finite(_c(v)), _c(v).cast("double"))


def printable_ascii(s) -> Column:
    return F.regexp_replace(_c(s), "[^\\x20-\\x7E]", "")


def well_formed_address(s) -> Column:
    return F.coalesce(_c(s).rlike("^[0-9a-f]{64}$") & (F.length(_c(s)) == 64), F.lit(False))


def candidate_flags(mask) -> dict[str, Column]:
    m = _c(mask).cast("long")
    return {name: m.bitwiseAND(F.lit(bit)) != 0
            for name, bit in (("host", 1), ("srflx", 2), ("relay", 4))}


def worker_rates(df: DataFrame) -> DataFrame:
    """Rates of a worker row; 0 in an input column means "never happened"."""
    score = F.col("score_ops_per_sec") / F.greatest(F.col("flop_per_unit"), F.lit(1.0))

    def since_join(c):
        return F.when(F.col(c) != 0, (F.col(c) - F.col("joined_ms")).cast("double")).otherwise(F.lit(-1.0))

    return (
        df.withColumn("predicted_ms",
                      F.when(score > 0, F.lit(1000.0) * F.col("unit_count") / score).otherwise(F.lit(0.0)))
        .withColumn("ms_to_first_grant", since_join("first_grant_ms"))
        .withColumn("ms_to_first_result", since_join("first_result_ms"))
        .withColumn("observed_units_per_sec",
                    F.when(F.col("observed_ms_total") > 0,
                           F.lit(1000.0) * F.col("units_completed") / F.col("observed_ms_total"))
                    .otherwise(F.lit(0.0)))
    )
