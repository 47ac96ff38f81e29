import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import exprs as E


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def lit(v):
    return F.lit(v)


def test_every_state_event_pair(spark):
    rows = [(s, e) for s in E.STATES for e in E.EVENTS]
    got = spark.createDataFrame(rows, "s string, e string").select("s", "e", E.transition("s", "e").alias("t")).collect()
    assert len(got) == 70
    assert {(r.s, r.e): r.t for r in got if r.t} == E.TRANSITIONS
    assert len(E.TRANSITIONS) == 12
    assert not any(r.t for r in got if r.s in E.TERMINAL)


SIZE = dict(score=1000.0, correction=1.0, throttle=1.0, target_ms=2000, lease_ms=30000, floor=0,
            remaining=1_000_000, cold_start=False)


@pytest.mark.parametrize("change, units", [
    ({}, 2000), ({"score": 2000.0}, 4000), ({"score": 0.0}, 0), ({"score": -5.0}, 0), ({"score": math.nan}, 0),
    ({"score": math.inf}, 0), ({"correction": 2.0}, 1000), ({"correction": 0.5}, 4000), ({"throttle": 0.5}, 1000),
    ({"throttle": 0.0}, 0), ({"lease_ms": 1000}, 500), ({"score": 1.0, "lease_ms": 1000, "floor": 400_000}, 400_000),
    ({"floor": 400_000, "remaining": 1234}, 1234), ({"remaining": 0}, 0), ({"cold_start": True}, 250),
    ({"score": 1e15, "remaining": 1 << 60}, 0xFFFFFFFF), ({"correction": math.nan}, 2000),
])
def test_task_size(spark, change, units):
    args = {k: F.lit(v) for k, v in {**SIZE, **change}.items()}
    assert one(spark, E.task_size(**args)) == units


def test_correction_step(spark):
    def step(c, p, a):
        return one(spark, E.correction_step(lit(c), lit(p), lit(a)))
    assert step(1.0, 1000.0, 2000.0) == pytest.approx(1.3)
    assert step(1.0, 2000.0, 60000.0) <= 10.0
    for p, a in ((0.0, 1000.0), (1000.0, 0.0), (math.nan, 1.0), (1.0, math.inf)):
        assert step(1.5, p, a) == 1.5
    assert step(1.0, 1.0, 1e9) == pytest.approx(0.7 + 0.3 * 1000)


def test_severity(spark):
    def sev(u, r):
        return one(spark, E.severity(lit(u), lit(r)))
    assert sev(5, 1e-7) == 0.25
    assert sev(16, 1.0) == 0.25
    assert sev(5_000_000, 0.5) > 1.0
    assert sev(0xFFFFFFFF, math.inf) == 4.0
    assert sev(17, 0.0) == 0.5
    assert sev(17, 1e9) == 4.0


@pytest.mark.parametrize("policy, score, probation, banned, need", [
    ("none", 0.1, True, True, 1), ("fixed2x", 0.99, False, False, 2), ("adaptive", 0.95, False, False, 1),
    ("adaptive", 0.6, False, False, 2), ("adaptive", 0.99, True, False, 4), ("adaptive", 0.99, False, True, 4)])
def test_required_agreement(spark, policy, score, probation, banned, need):
    assert one(spark, E.required_agreement(lit(policy), lit(score), lit(probation), lit(banned))) == need


def bits(x):
    return struct.unpack("<I", struct.pack("<f", x))[0]


FLOATS = [0.0, -0.0, 1.0, -1.0, 1.0000001, 3.14159, 1e30, -1e30, 1e-45, -1e-45, 1.1754944e-38, 0.75, 0.49999997, 2.0,
          float("inf"), float("-inf"), float("nan")]


def test_ulp_distance_from_bits_and_from_floats(spark):
    rows = [(bits(a), bits(b), a, b) for a in FLOATS for b in FLOATS]
    df = spark.createDataFrame(rows, "ab long, bb long, a float, b float")
    got = df.select("ab", "bb", "a", "b", E.ulp_distance_bits("ab", "bb").alias("x"), E.ulp_distance("a", "b").alias("y")).collect()

    def order(u):
        return -(u & 0x7FFFFFFF) if u >= 0x80000000 else u
    for r in got:
        a, b = struct.unpack("<ff", struct.pack("<II", r.ab, r.bb))
        if a == b:
            want = 0
        elif not (math.isfinite(a) and math.isfinite(b)):
            want = 0xFFFFFFFF
        else:
            want = min(abs(order(r.ab) - order(r.bb)), 0xFFFFFFFF)
        assert (r.x, r.y) == (want, want), (a, b)


def test_smallest_values_of_either_sign_are_two_steps_apart(spark):
    assert one(spark, E.ulp_distance_bits(lit(1), lit(0x80000001))) == 2


def test_float_rank_on_random_bits(spark):
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32)
    vals = raw.view(np.float32)
    keep = np.isfinite(vals)
    rows = [(int(b), float(v)) for b, v in zip(raw[keep], vals[keep])]
    df = spark.createDataFrame(rows, "b long, v float")
    assert df.where(E.float_rank("v") != E.ordered_bits("b")).count() == 0


def test_mix32(spark):
    def mix(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return (x ^ (x >> 31)) >> 32
    xs = [0, 1, 42, 2**32, 2**63 - 1, -1]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", E.mix32("x").alias("m"))
    assert {r.x: r.m for r in df.collect()} == {x: mix(x & (2**64 - 1)) for x in xs}


def test_range_too_long_is_flagged_not_narrowed(spark):
    df = spark.createDataFrame([(5, 5_000_000_000, 1), ((3 << 32) + 7, 10, 1)], "start_unit long, unit_count long, seed long")
    a, b = E.range_params(df).collect()
    assert a.param_error and b.param_error is None
    assert (b.start_lo, b.base_hi) == (7, 3)


@pytest.mark.parametrize("w, h, tw, th", [(64, 64, 64, 64), (128, 128, 64, 64), (100, 70, 64, 64), (65, 65, 64, 64),
                                          (7, 3, 64, 64), (192, 64, 32, 16)])
def test_tiles_partition_the_image(spark, w, h, tw, th):
    from fleetlens.operators.tiles import Grid
    g = Grid(w, h, tw, th)
    cells = [(x, y) for r in g.tiles(spark).collect() for x in range(r.x, r.x + r.w) for y in range(r.y, r.y + r.h)]
    assert len(cells) == len(set(cells)) == w * h
    assert one(spark, E.tile_at(lit(g.tile_count), w, h, tw, th)) is None


def test_tone_map(spark):
    assert 180 < one(spark, E.tone_map(lit(0.5))) < 195
    assert [one(spark, E.tone_map(lit(v))) for v in (0.0, -1.0, math.nan, 1.0, 7.0)] == [0, 0, 0, 255, 255]


def test_text_rules(spark):
    assert one(spark, E.printable_ascii(lit("GPU\té\x7f X~"))) == "GPU X~"
    assert one(spark, E.well_formed_address(lit("a" * 64)))
    for bad in ("A" * 64, "a" * 63, "a" * 65, "a" * 64 + "\n", ""):
        assert not one(spark, E.well_formed_address(lit(bad)))
    assert one(spark, E.finite_or_null(lit(math.inf))) is None
    assert one(spark, E.score_sanitise(lit(1e300))) == 1e15
    assert one(spark, E.score_sanitise(lit(math.nan))) is None


def test_hashes_of_large_numbers_wrap(spark):
    from fleetlens.functions import exprs as X
    from fleetlens.operators import quality as Y

    def pcg(v):
        s = ((v & 0xFFFFFFFF) * X.PCG_MUL + X.PCG_ADD) & 0xFFFFFFFF
        w = (((s >> ((s >> 28) + 4)) ^ s) * X.PCG_OUT) & 0xFFFFFFFF
        return (w >> 22) ^ w
    ids = [1, 6_000_000_000, 20_000_000_000, (1 << 62) + 12345]
    df = spark.createDataFrame([(i, 1) for i in ids], "task_id long, worker_id long")
    assert {r[0]: r[1] for r in df.select("task_id", X.pcg_hash("task_id")).collect()} == {i: pcg(i) for i in ids}
    rows = spark.createDataFrame([(i, 1) for i in [*ids, *range(6_000_000_000, 6_000_000_400)]], "task_id long, worker_id long")
    pool = spark.createDataFrame([(k, k * 10) for k in range(7)], "slot long, start_unit long")
    scores = spark.createDataFrame([], "worker_id long, score double")
    got = {r.task_id: r.slot for r in Y.spot_sample(rows, scores, pool).collect()}
    want = {}
    for (i,) in rows.select("task_id").collect():
        h = i * 2654435761 % (1 << 64)
        if h % 10000 / 10000.0 < 0.10:
            want[i] = (h >> 16) % 7
    assert got == want and len(got) > 10


def test_a_grant_and_a_check_are_used_once(spark):
    from fleetlens.operators import joins as J

    ev = spark.createDataFrame([(1, 1, 100, "grant"), (2, 1, 200, "accept"), (3, 1, 900, "accept"), (4, 1, 950, "grant"), (5, 1, 960, "grant"), (6, 1, 970, "accept")],
                               "event_id long, worker_id long, t_ms long, event string").selectExpr("*", "7L as task_id", "1L as unit_count")
    got = {r.event_id: r.actual_ms for r in J.grant_accept_asof(ev).collect()}
    assert got == {2: 100, 3: None, 6: 10}
    issued = spark.createDataFrame([(1, 5)], "task_id long, expected_checksum long")
    results = spark.createDataFrame([(1, 21, 6, 2), (1, 20, 5, 1), (1, 22, 6, 3)], "task_id long, worker_id long, checksum long, seq long")
    assert [(r.worker_id, r.correct) for r in J.spot_resolve(issued, results, ["seq"]).collect()] == [(20, True)]
