"""Comparing two results element by element.

Inputs are the two sides either as long tables (id columns, pos, value), joined
on the position, or with whole payloads as arrays (id columns, value array),
joined on the id and opened in place, which shuffles each payload once. All
verdicts are aggregates, so elements combine before they are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fleetlens.functions.exprs import U32, is_nan_bits, ulp_distance, ulp_distance_bits
from fleetlens.operators.ordered import is_hot, nearest_ranks, rank_of, running

# Fixed values of the statistical comparison.
SIGMA_CUTOFF = 6.0
MAX_OUTLIER_FRACTION = 0.03
AGGREGATE_CUTOFF = 12.0
SCALE_FLOOR = 1e-3
SCALE_QUANTILE = 0.99
HALF_NORMAL = 2.5758


def pair_up(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per position in either payload: va, vb, in_a, in_b."""
    if isinstance(a.schema[value].dataType, ArrayType):
        j = (a.select(*keys, F.col(value).alias("pa"))
             .join(b.select(*keys, F.col(value).alias("pb")), keys, "full")
             .select(*keys, F.coalesce("pa", F.array()).alias("va"), F.coalesce("pb", F.array()).alias("vb")))
        sizes = [F.size("va").alias("na"), F.size("vb").alias("nb")]
        opened = j.select(*keys, *sizes, F.posexplode_outer(F.arrays_zip("va", "vb")).alias("pos", "e"))
        # Two empty payloads keep one row that is in neither side.
        return opened.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("e.va").alias("va"),
                             F.col("e.vb").alias("vb"), F.coalesce(F.col("pos") < F.col("na"), F.lit(False)).alias("in_a"),
                             F.coalesce(F.col("pos") < F.col("nb"), F.lit(False)).alias("in_b"))
    left = a.select(*keys, "pos", F.col(value).alias("va"), F.lit(True).alias("in_a"))
    right = b.select(*keys, "pos", F.col(value).alias("vb"), F.lit(True).alias("in_b"))
    j = left.join(right, [*keys, "pos"], "full")
    return j.withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))


def _verdict(pairs: DataFrame, keys: list[str], differs: Column, extra: list[Column]) -> DataFrame:
    """Counts and first difference; payloads of unequal length differ everywhere."""
    bad = F.coalesce(differs, F.lit(False))
    g = pairs.groupBy(*keys).agg(
        F.count_if("in_a").alias("na"), F.count_if("in_b").alias("nb"),
        F.count_if(bad).alias("nbad"), F.min(F.when(bad, F.col("pos"))).alias("first"), *extra)
    same_len = F.col("na") == F.col("nb")
    n = F.greatest("na", "nb")
    g = (g.withColumn("elements", n)
         .withColumn("differing", F.when(same_len, F.col("nbad")).otherwise(n))
         .withColumn("first_diff", F.when(same_len, F.coalesce("first", n)).otherwise(F.lit(0)).cast("long")))
    return g.withColumn("verdict", F.when(F.col("differing") == 0, "Match").otherwise("Mismatch")) \
        .drop("na", "nb", "nbad", "first")


def compare_exact(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return _verdict(pair_up(a, b, keys, value), keys, F.col("va") != F.col("vb"), [])


def tolerant_columns(pairs: DataFrame, abs_eps: float, rel_eps: float) -> DataFrame:
    """Per position: abs_diff, rel_diff, ulp and whether it is out of tolerance.
    Two NaN agree; one NaN differs by infinity and leaves the relative part out."""
    va, vb = F.col("va").cast("double"), F.col("vb").cast("double")
    na, nb = F.isnan(va), F.isnan(vb)
    both = F.col("in_a") & F.col("in_b")
    denom = F.abs(vb)
    diff = F.abs(va - vb)
    numbers = both & ~na & ~nb
    one_nan = both & (na != nb)
    # inf - inf is NaN, and a maximum skips NaN the way max(x, NaN) does.
    safe = F.when(numbers & ~F.isnan(diff), diff)
    rel = F.when(numbers & (denom > 0), diff / denom).when(numbers, F.lit(0.0))
    return pairs.select(
        "*", F.when(one_nan, F.lit(float("inf"))).otherwise(safe).alias("abs_diff"),
        F.when(~F.isnan(rel), rel).alias("rel_diff"),
        F.when(one_nan, F.lit(U32).cast("long")).when(numbers, ulp_distance("va", "vb")).alias("ulp"),
        F.coalesce(one_nan | (numbers & ~F.isnan(diff) & (diff > F.lit(abs_eps) + F.lit(rel_eps) * denom)),
                   F.lit(False)).alias("out"))


def compare_tolerant(a: DataFrame, b: DataFrame, keys: list[str], abs_eps: float, rel_eps: float,
                     value: str = "value") -> DataFrame:
    p = tolerant_columns(pair_up(a, b, keys, value), abs_eps, rel_eps)
    got = _verdict(p, keys, F.col("out"), [
        F.coalesce(F.max("abs_diff"), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max("rel_diff"), F.lit(0.0)).alias("max_rel"),
        F.coalesce(F.max("ulp"), F.lit(0)).alias("max_ulp")])
    return got


def compare_statistical(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two Monte Carlo estimates of the same pixels: sides are (keys, pixel, r,
    g, b, samples), sums and the count behind them. The scale is a high
    quantile of the standardised differences; a tile fails on too many
    outliers or on means further apart than sampling allows."""
    chans = ("r", "g", "b")
    right = b.select(*keys, "pixel", *[F.col(c).alias("b_" + c) for c in (*chans, "samples")])
    both = (a.withColumn("in_a", F.lit(True))
            .join(right.withColumn("in_b", F.lit(True)), [*keys, "pixel"], "full"))
    sizes = both.groupBy(*keys).agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"))
    j = both.where("in_a and in_b")
    na, nb = F.col("samples").cast("double"), F.col("b_samples").cast("double")

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    counted = finite(na) & finite(nb) & (na > 0) & (nb > 0)
    radiant = F.lit(True)
    for c in chans:
        radiant = radiant & finite(F.col(c).cast("double")) & finite(F.col("b_" + c).cast("double"))
    first_bad = F.lit(None).cast("long")
    for k in reversed(range(3)):
        ok = finite(F.col(chans[k]).cast("double")) & finite(F.col("b_" + chans[k]).cast("double"))
        first_bad = F.when(~ok, F.lit(k).cast("long")).otherwise(first_bad)
    j = j.withColumn("problem", F.when(~counted, "Unsupported").when(~radiant, "Mismatch")) \
        .withColumn("bad_channel", F.coalesce(first_bad, F.lit(0).cast("long")))
    problems = (j.where(F.col("problem").isNotNull()).groupBy(*keys)
                .agg(F.min_by(F.struct("problem", "pixel", "bad_channel"), "pixel").alias("p")))
    good = j.where(F.col("problem").isNull())
    pooled_sq = F.lit(1.0) / na + F.lit(1.0) / nb
    ch = good.select(
        *keys, "pixel", pooled_sq.alias("pooled_sq"),
        F.posexplode(F.array(*[F.struct((F.col(c) / na).alias("ma"), (F.col("b_" + c) / nb).alias("mb"))
                               for c in chans])).alias("k", "m"))
    ch = ch.select(*keys, "pooled_sq", (F.col("pixel") * 3 + F.col("k")).alias("at"),
                   F.col("m.ma").alias("ma"), F.col("m.mb").alias("mb"),
                   F.abs((F.col("m.ma") - F.col("m.mb")) / F.sqrt("pooled_sq")).alias("d"),
                   F.abs("m.mb").alias("mag"))

    def quantile(q):
        return lambda n: F.floor(F.lit(q) * (n - 1)).cast("long")

    hot = is_hot(a.select(*keys), keys)  # pixels of one side: measured once, before the joins
    dq = nearest_ranks(ch.select(*keys, "d"), keys, "d", {"dq": quantile(SCALE_QUANTILE)}, hot).drop("n")
    mq = nearest_ranks(ch.select(*keys, "mag"), keys, "mag", {"mq": quantile(0.5)}, hot).drop("n")
    scale = F.greatest(F.col("dq") / HALF_NORMAL, F.lit(SCALE_FLOOR) * F.greatest("mq", F.lit(1e-9)))
    scales = dq.join(mq, keys).select(*keys, scale.alias("scale"))
    z = F.col("d") / F.col("scale")
    agg = ch.join(scales, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("channels"), F.max("scale").alias("scale"),
        F.count_if(z > SIGMA_CUTOFF).alias("outliers"), F.max(z).alias("worst"),
        F.sum(F.col("ma") - F.col("mb")).alias("sum_diff"),
        # once per pixel, divided by the number of channels: part of the rule
        F.sum(F.when(F.col("at") % 3 == 0, F.col("pooled_sq"))).alias("pooled"))
    m = F.col("channels").cast("double")
    se = F.col("scale") * F.sqrt(F.col("pooled") / m) / F.sqrt(m)
    agg = agg.withColumn("z_aggregate", F.when(se > 0, F.abs(F.col("sum_diff") / m) / se).otherwise(F.lit(0.0)))
    sizes = sizes.withColumn("elements", F.greatest("n_a", "n_b") * 3)
    out = sizes.join(agg, keys, "left").join(problems, keys, "left")
    # Payloads of different sizes never match; they have no z-scores either.
    uneven = F.col("n_a") != F.col("n_b")
    verdict = (F.when(uneven, "Mismatch")
               .when(F.col("p").isNotNull(), F.col("p.problem"))
               .when(F.col("outliers") / m > MAX_OUTLIER_FRACTION, "Mismatch")
               .when(F.col("z_aggregate") > AGGREGATE_CUTOFF, "Mismatch").otherwise("Match"))
    clean = F.col("p").isNull()
    return out.select(
        *keys, "elements", verdict.alias("verdict"),
        F.when(clean & ~uneven, F.col("outliers")).otherwise(F.lit(0)).alias("outliers"),
        F.when(uneven, F.lit(None)).when(clean, F.col("worst")).otherwise(F.lit(0.0)).alias("worst"),
        F.when(uneven, F.lit(None)).when(clean, F.col("z_aggregate")).otherwise(F.lit(0.0)).alias("z_aggregate"),
        F.when(clean | uneven, F.lit(-1).cast("long"))
        .otherwise(F.col("p.pixel") * 3 + F.col("p.bad_channel")).alias("bad_channel"))


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` standing for ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistical_pair(a: Column, b: Column) -> Column:
    """(match, z_aggregate) of two payloads, arrays of (r, g, b, samples), by the rule of :func:`compare_statistical`.

    One expression over the two arrays, so that payloads can be members of a fold. Payloads of unequal size, with a
    sample count that is not positive or a radiance that is not finite do not match; their z is 0. Two empty ones match."""
    def number(v):
        return F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))

    def sound(p):
        ok = F.lit(True)
        for side in ("a", "b"):
            counts = p[side]["samples"].cast("double")
            ok = ok & number(counts) & F.coalesce(counts > 0, F.lit(False))
            for c in ("r", "g", "b"):
                ok = ok & number(p[side][c].cast("double"))
        return ok

    def square(p):
        return F.lit(1.0) / p["a"]["samples"].cast("double") + F.lit(1.0) / p["b"]["samples"].cast("double")

    def channels(p):
        means = [(p["a"][c].cast("double") / p["a"]["samples"].cast("double"),
                  p["b"][c].cast("double") / p["b"]["samples"].cast("double")) for c in ("r", "g", "b")]
        return F.array(*[F.struct((ma - mb).alias("diff"), F.abs((ma - mb) / F.sqrt(square(p))).alias("d"), F.abs(mb).alias("mag"))
                         for ma, mb in means])

    def ranked(values, q):
        return F.element_at(values, F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)

    def total(values, part):
        return F.aggregate(values, F.lit(0.0), lambda t, v: t + part(v))

    def judged(pairs, ch, ds):
        mags = F.sort_array(F.transform(ch, lambda c: c["mag"]))
        m = F.size(ch).cast("double")
        scale = F.greatest(ranked(ds, SCALE_QUANTILE) / HALF_NORMAL, F.lit(SCALE_FLOOR) * F.greatest(ranked(mags, 0.5), F.lit(1e-9)))

        def verdict(scale):
            se = scale * F.sqrt(total(pairs, square) / m) / F.sqrt(m)
            z = F.when(se > 0, F.abs(total(ch, lambda c: c["diff"]) / m) / se).otherwise(F.lit(0.0))
            outliers = F.size(F.filter(ds, lambda d: d / scale > SIGMA_CUTOFF)) / m
            return _let(z, lambda z: F.struct(((outliers <= MAX_OUTLIER_FRACTION) & (z <= AGGREGATE_CUTOFF)).alias("match"),
                                              z.alias("z_aggregate")))
        return _let(scale, verdict)

    def compared(pairs):
        return _let(F.flatten(F.transform(pairs, channels)), lambda ch: _let(
            F.sort_array(F.transform(ch, lambda c: c["d"])), lambda ds: judged(pairs, ch, ds)))

    def known(match):
        return F.struct(F.lit(match).alias("match"), F.lit(0.0).alias("z_aggregate"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    alike = F.coalesce(F.size(a) == F.size(b), F.lit(False)) & a.isNotNull() & b.isNotNull()
    return F.when(~alike, known(False)).when(F.size(a) == 0, known(True)).otherwise(
        _let(pairs, lambda ps: F.when(F.forall(ps, sound), compared(ps)).otherwise(known(False))))


def bit_distance(pairs: DataFrame) -> DataFrame:
    """Adds ``ulp`` to (kernel, pos, bits_a, bits_b): distance in representable
    steps, or 0/1 for integer kernels; null for a NaN on either side."""
    integer = F.col("kernel").contains("hash")
    nan = is_nan_bits("bits_a") | is_nan_bits("bits_b")
    ulp = (F.when(integer, F.when(F.col("bits_a") == F.col("bits_b"), 0).otherwise(1).cast("long"))
           .when(~nan, ulp_distance_bits("bits_a", "bits_b")))
    return pairs.withColumn("ulp", ulp)


def ulp_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Identity rate and divergence per key; ``ulp`` null marks a skipped NaN pair."""
    return pairs.groupBy(*keys).agg(
        F.count("ulp").alias("compared"), F.count_if(F.col("ulp").isNull()).alias("nan_skipped"),
        F.count_if(F.col("ulp") == 0).alias("identical"),
        F.coalesce(F.max("ulp"), F.lit(0)).alias("max_ulp"),
        F.coalesce(F.try_divide(F.sum("ulp"), F.count("ulp")), F.lit(0.0)).alias("mean_ulp"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(F.col("ulp") == 0), F.count("ulp")),
                   F.lit(0.0)).alias("identical_pct"))


def ulp_histogram(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ulp, count, cumulative %) plus p99, worst relative error and the
    headroom left by a tolerance of 1e-6, repeated on the key's rows."""
    rel = F.max("rel_diff").alias("rel")
    hist = pairs.where(F.col("ulp").isNotNull()).groupBy(*keys, "ulp").agg(F.count(F.lit(1)).alias("count"), rel)
    cum = running(hist, keys, ["ulp"], {"cum": ("sum", F.col("count")), "n": ("total", F.col("count"))})
    stats = cum.groupBy(*keys).agg(
        F.min(F.when(F.col("cum") > rank_of(0.99)(F.col("n")), F.col("ulp"))).alias("p99"),
        F.coalesce(F.max("rel"), F.lit(0.0)).alias("max_rel"))
    return cum.join(stats, keys).select(
        *keys, "ulp", "count", (F.lit(100.0) * F.col("cum") / F.col("n")).alias("cumulative_pct"), "p99", "max_rel",
        F.when(F.col("max_rel") > 0, F.lit(1e-6) / F.col("max_rel")).otherwise(F.lit(0.0)).alias("headroom"))
