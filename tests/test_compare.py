import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import compare as C
from fleetlens.operators import kernels as K
from fleetlens.operators import tiles as T

NAN, INF = math.nan, math.inf


def side(spark, values, kind="float"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"id long, pos long, value {kind}")


def packed(spark, values, kind="float"):
    return spark.createDataFrame([(1, values)], f"id long, value array<{kind}>")


def exact(spark, a, b):
    return C.compare_exact(side(spark, a, "long"), side(spark, b, "long"), ["id"]).first()


def tol(spark, a, b, rel=1e-6, abs_=1e-9):
    return C.compare_tolerant(side(spark, a), side(spark, b), ["id"], abs_, rel).first()


def test_exact(spark):
    a = list(range(8))
    assert exact(spark, a, a).verdict == "Match" and exact(spark, a, a).first_diff == 8
    r = exact(spark, a, [0, 1, 2, 3, 4, 255, 6, 7])
    assert (r.verdict, r.differing, r.first_diff) == ("Mismatch", 1, 5)
    r = exact(spark, [0] * 4, [9] * 4)
    assert (r.differing, r.elements) == (4, 4)
    r = exact(spark, [1, 2, 3], [1, 2])
    assert (r.verdict, r.differing, r.elements) == ("Mismatch", 3, 3)


def test_tolerant(spark):
    ref = np.array([1.0, 3.14159, 1e6, 2.71828], dtype=np.float32)
    near = [float(x) for x in (ref.view(np.int32) + 5).view(np.float32)]
    r = tol(spark, near, [float(x) for x in ref])
    assert (r.verdict, r.max_ulp) == ("Match", 5) and r.max_rel > 0
    r = tol(spark, [1.0, 2.5, 3.0], [1.0, 2.0, 3.0])
    assert (r.verdict, r.differing, r.first_diff) == ("Mismatch", 1, 1) and r.max_rel > 0.2


@pytest.mark.parametrize("a, b, ok", [
    (1e-12, 0.0, True), (1e-3, 0.0, False), (-0.0, 0.0, True), (NAN, 1.0, False), (1.0, NAN, False), (NAN, NAN, True),
    (INF, 1e30, False), (INF, INF, True)])
def test_tolerant_special_values(spark, a, b, ok):
    r = tol(spark, [a], [b])
    assert (r.verdict == "Match") is ok
    if math.isnan(a) != math.isnan(b):
        assert (r.max_ulp, r.max_abs, r.max_rel) == (0xFFFFFFFF, INF, 0.0)


@pytest.mark.parametrize("a, b", [([1.0, 2.0, 3.0], [1.0, 2.5, 3.0]), ([1.0, NAN], [1.0, NAN]), ([1.0, NAN], [1.0, 2.0]),
                                  ([1.0], [1.0, 2.0]), ([1.0, 2.0], [1.0]), ([INF, -0.0], [INF, 0.0])])
def test_array_payloads_compare_like_long_ones(spark, a, b):
    want = tol(spark, a, b)
    got = C.compare_tolerant(packed(spark, a), packed(spark, b), ["id"], 1e-9, 1e-6).first()
    assert got.asDict() == want.asDict()


def test_two_empty_payloads_match(spark):
    got = C.compare_exact(packed(spark, [], "long"), packed(spark, [], "long"), ["id"]).first()
    assert (got.verdict, got.elements, got.differing) == ("Match", 0, 0)


def render(n, seed, bias=1.0, corrupt=0.0, scale=1.0, pixels=1024):
    rng = np.random.default_rng(seed)
    p = np.arange(pixels)
    out = {"id": 1, "pixel": p}
    for k, c in enumerate("rgb"):
        mean = 0.2 + 0.8 * np.sin(p * 0.01 + k)
        s = rng.normal(mean * n, np.abs(0.6 * mean) * math.sqrt(n)) * bias
        out[c] = np.where(p % 1000 / 1000 < corrupt, s * scale, s).astype(np.float32)
    out["samples"] = np.float32(n)
    return pd.DataFrame(out)


def statistical(spark, a, b):
    return C.compare_statistical(spark.createDataFrame(a), spark.createDataFrame(b), ["id"]).first()


def reference_statistical(a, b):
    """Plain recomputation of the rule over one pair of tiles."""
    na, nb = a["samples"].to_numpy(float), b["samples"].to_numpy(float)
    pooled = np.sqrt(1 / na + 1 / nb)
    ma = np.stack([a[c].to_numpy(float) / na for c in "rgb"], 1)
    mb = np.stack([b[c].to_numpy(float) / nb for c in "rgb"], 1)
    d = np.abs((ma - mb) / pooled[:, None]).ravel()
    m = len(d)
    scale = max(np.sort(d)[int(.99 * (m - 1))] / 2.5758, 1e-3 * max(np.sort(np.abs(mb).ravel())[int(.5 * (m - 1))], 1e-9))
    z = d / scale
    se = scale * math.sqrt((pooled ** 2).sum() / m) / math.sqrt(m)
    return int((z > 6).sum()), z.max(), abs((ma - mb).sum() / m) / se


@pytest.mark.parametrize("b, verdict", [
    (render(4096, 2), "Match"), (render(1024, 4, bias=1.10), "Mismatch"),
    (render(1024, 6, corrupt=0.2, scale=5.0), "Mismatch"), (render(1024, 8, bias=0.0), "Mismatch")])
def test_statistical(spark, b, verdict):
    a = render(1024, 1)
    r = statistical(spark, a, b)
    out, worst, za = reference_statistical(a, b)
    assert r.verdict == verdict and r.outliers == out
    assert r.worst == pytest.approx(worst) and r.z_aggregate == pytest.approx(za)


def test_statistical_refusals(spark):
    a = render(256, 9, pixels=64)
    assert statistical(spark, a, a).verdict == "Match"
    bad = a.copy()
    bad.loc[5, "samples"] = 0.0
    assert statistical(spark, a, bad).verdict == "Unsupported"
    bad = a.copy()
    bad.loc[3, "g"] = np.nan
    r = statistical(spark, a, bad)
    assert (r.verdict, r.bad_channel) == ("Mismatch", 10)
    bad.loc[2, "samples"] = -1.0  # an earlier problem wins
    assert statistical(spark, a, bad).verdict == "Unsupported"
    assert statistical(spark, a, a.iloc[:-1]).verdict == "Mismatch"


def test_ulp_tools(spark):
    rows = [("smoke_hash", 0, 0x7FC00001, 0x7FC00001), ("smoke_hash", 1, 5, 6), ("f", 0, 0x3F800000, 0x3F800000),
            ("f", 1, 0x3F800000, 0x3F800003), ("f", 2, 0x7FC00001, 1)]
    p = C.bit_distance(spark.createDataFrame(rows, "kernel string, pos long, bits_a long, bits_b long"))
    got = {r.kernel: r for r in C.ulp_summary(p, ["kernel"]).collect()}
    assert (got["smoke_hash"].compared, got["smoke_hash"].identical, got["smoke_hash"].max_ulp) == (2, 1, 1)
    assert (got["f"].compared, got["f"].nan_skipped, got["f"].max_ulp, got["f"].mean_ulp) == (2, 1, 3, 1.5)


def test_kernel_registry(spark):
    df = side(spark, [1, 2, 3], "long")
    a, b = K.kernel_map(df, "smoke_hash"), K.kernel_map(df.repartition(3), "smoke_hash")
    assert K.compare_kernel("smoke_hash", a, b, ["id"]).first().verdict == "Match"
    with pytest.raises(KeyError):
        K.kernel_map(df, "unknown")
    with pytest.raises(ValueError):
        K.register("x", K.Kernel(lambda c: c, "by eye"))
    v = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i.cast("double")).alias("value"))
    a = K.kernel_map(v, "smoke_pixels")
    got = K.compare_kernel("smoke_pixels", a, a, ["id"]).collect()
    assert [(r.verdict, r.elements) for r in got] == [("Match", 12)] * 2


def upload(tile, seq, n, value, samples):
    return [(tile, seq, i, value, value, value, samples) for i in range(n)]


UPLOAD = "tile long, upload long, pixel long, r float, g float, b float, samples float"


def test_tiles(spark):
    grid = T.Grid(64, 64, 32, 32)
    rows = upload(0, 1, 1024, 0.5, 4.0) + upload(0, 2, 1024, 0.5, 100.0) + upload(1, 1, 1024, 0.5, 50.0)
    rows += upload(2, 1, 1024, 0.5, 75.0) + upload(2, 2, 1023, 0.5, 900.0)  # wrong size: dropped
    df = spark.createDataFrame(rows, UPLOAD)
    r = T.tile_samples(df, grid).first()
    assert tuple(r) == (0.0, 100.0, 3, 4, 3)
    more = df.unionByName(spark.createDataFrame(upload(3, 1, 1024, 0.5, 200.0), UPLOAD))
    r = T.tile_samples(more, grid).first()
    assert (r.min_samples, r.max_samples, r.least_sampled) == (50.0, 200.0, 1)
    assert T.tile_samples(df.where("false"), grid).first().least_sampled == 0


def test_mosaic(spark):
    grid = T.Grid(20, 16, 16, 16)  # the second column is clipped to 4
    rows = upload(0, 1, 256, 4.0, 8.0) + upload(1, 1, 64, float("nan"), 8.0)
    img = {(r.x, r.y): r for r in T.mosaic(spark.createDataFrame(rows, UPLOAD), grid).collect()}
    assert len(img) == 320 and all(r.alpha == 255 for r in img.values())
    assert 180 < img[0, 0].red < 195 and img[17, 3].red == 0
    blank = T.mosaic(spark.createDataFrame(rows, UPLOAD).where("tile = 9"), grid)
    assert blank.agg(F.max("red"), F.min("alpha"), F.count("x")).first()[:] == (0, 255, 320)


def test_statistical_sides_of_unequal_size(spark):
    rows = [(k, p, 1.0, 2.0, 3.0, 4.0) for k in (1, 2, 3) for p in range(16)]
    cols = "id long, pixel long, r double, g double, b double, samples double"
    a = spark.createDataFrame([r for r in rows if r[0] < 3], cols)
    b = spark.createDataFrame([r for r in rows if r[0] != 2 and r[:2] != (1, 15)], cols)
    got = {r.id: (r.verdict, r.elements, r.outliers, r.worst, r.bad_channel) for r in C.compare_statistical(a, b, ["id"]).collect()}
    assert got == {k: ("Mismatch", 48, 0, None, -1) for k in (1, 2, 3)}
