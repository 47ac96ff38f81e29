import random
import struct

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import quorum as Q
from fleetlens.operators import reputation as P


def exact(spark, answers, required=2, cap=4, policy="fixed2x"):
    rows = [(1, i + 1, i + 1, a) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string")
    return Q.settle(Q.decide_exact(df, required, cap, policy)).first()


@pytest.mark.parametrize("answers, kw, action, agreeing, dissenting", [
    ("A", {"policy": "none"}, "Accept", 1, 0),
    ("A", {}, "NeedMoreReplicas", 0, 0),
    ("AA", {}, "Accept", 2, 0),
    ("AB", {}, "NeedMoreReplicas", 0, 0),
    ("ABA", {}, "Accept", 2, 1),
    ("ABAB", {"required": 3}, "Inconclusive", 0, 0),
    ("ABAC", {"required": 3}, "Inconclusive", 0, 0),
    ("ABAA", {"required": 9}, "Accept", 3, 1),
    ("AABB", {}, "Accept", 2, 0),  # settled by the second answer; the others are late
    ("BAAB", {}, "Accept", 2, 1),  # the first answer to be given twice wins, not the first answer
])
def test_exact(spark, answers, kw, action, agreeing, dissenting):
    r = exact(spark, answers, **kw)
    assert (r.action, r.agreeing, r.dissenting) == (action, agreeing, dissenting)
    if action == "Accept":
        assert r.answer == "A"
    if dissenting:
        assert (r.dissent_max_ulp, r.dissent_max_rel) == (0xFFFFFFFF, 1.0)


def test_a_cleared_round_starts_empty(spark):
    # four different answers, then a fresh round that agrees; the tail is late
    r = exact(spark, "ABCD" + "EFE" + "AAAAA")
    assert (r.action, r.answer, r.round, r.submissions) == ("Accept", "E", 1, 12)
    # the A of the first round must not be counted in the second
    assert exact(spark, "ABCD" + "A").action == "NeedMoreReplicas"


def test_required_agreement_of_the_arriving_worker(spark):
    rows = [(1, 1, 1, "A", 2), (1, 2, 2, "A", 3), (1, 3, 3, "B", 2)]
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, answer string, need long")
    # Worker 2 needs three that agree, but worker 3 only two, and two agree by then.
    r = Q.decide_exact(df, F.col("need")).first()
    assert (r.action, r.answer, r.n, r.agreeing, r.dissenting) == ("Accept", "A", 3, 2, 1)


def test_late_answers_are_neither_credited_nor_charged(spark):
    df = spark.createDataFrame([(1, 10 + i, i + 1, a) for i, a in enumerate("AABB")], "task_id long, worker_id long, seq long, answer string")
    got = Q.quorum_credits(df, Q.settle(Q.decide_exact(df))).collect()
    assert sorted((r.worker_id, r.severity) for r in got) == [(10, 0.0), (11, 0.0)]


def test_quorum_credits_charge_the_dissenter(spark):
    df = spark.createDataFrame([(1, w, i + 1, a) for i, (w, a) in enumerate([(11, "A"), (12, "B"), (13, "A")])],
                               "task_id long, worker_id long, seq long, answer string")
    got = {r.worker_id: (r.accepted, r.severity) for r in Q.quorum_credits(df, Q.settle(Q.decide_exact(df))).collect()}
    assert got == {11: (True, 0.0), 12: (False, 4.0), 13: (True, 0.0)}


def nudge(x, n):
    return struct.unpack("<f", struct.pack("<i", struct.unpack("<i", struct.pack("<f", x))[0] + n))[0]


def tolerant(spark, payloads, required=2, cap=4, kind="array<float>"):
    rows = [(1, i + 1, i + 1, v) for i, v in enumerate(payloads)]
    df = spark.createDataFrame(rows, f"task_id long, worker_id long, seq long, value {kind}")
    return Q.decide_tolerant(df, required, cap, 1e-9, 1e-6).first()


def test_five_steps_apart_agree(spark):
    ref = [1.0, nudge(3.14159, 0), 1e6]
    r = tolerant(spark, [ref, [nudge(v, 5) for v in ref]])
    assert (r.action, r.agreeing) == ("Accept", 2)


def test_wrong_answer_does_not_hide_behind_the_tolerance(spark):
    assert tolerant(spark, [[1.0, 2.0], [1.0, 2.5]]).action == "NeedMoreReplicas"
    assert tolerant(spark, [[1.0, 2.0], [1.0]]).action == "NeedMoreReplicas"


def test_clusters_compare_with_every_member(spark):
    r = tolerant(spark, [[1.0], [nudge(1.0, 6)], [nudge(1.0, -6)]], required=3)
    assert r.agreeing != 3 and r.clusters == 2


def test_dissent_is_measured_against_the_winner(spark):
    r = tolerant(spark, [[1.0], [1.5], [1.0]])
    assert (r.action, r.agreeing, r.dissenting, r.dissent_max_rel) == ("Accept", 2, 1, 0.5)
    assert r.dissent_max_ulp == struct.unpack("<i", struct.pack("<f", 1.5))[0] - struct.unpack("<i", struct.pack("<f", 1.0))[0]


def test_nan_agrees_only_with_nan(spark):
    nan = float("nan")
    assert tolerant(spark, [[nan], [nan]]).action == "Accept"
    assert tolerant(spark, [[nan], [1.0]]).action == "NeedMoreReplicas"


def test_known_pool(spark):
    rows = [(i, 10, i, 2, i * 7) for i in range(300)] + [(5, 10, 999, 2, 1), (1000, 0, 998, 2, 1), (1001, 10, 997, 1, 1)]
    v = spark.createDataFrame(rows, "start_unit long, unit_count long, arrival long, agreeing long, checksum long")
    got = {r.start_unit for r in Q.known_pool(v).collect()}
    assert got == set(range(44, 300))


def verdict_rows(spark, rows):
    return spark.createDataFrame(rows, "worker_id long, t_ms long, verdict_id long, accepted boolean, severity double, spot boolean")


def test_scores(spark):
    rows = [(1, i, i, True, 0.0, False) for i in range(200)] + [(2, 0, 1000, True, 0.0, False)]
    rows += [(3, 0, 2000, False, 1.0, False), (4, 0, 3000, False, 1.0, True), (5, 0, 4000, False, 9.0, True)]
    s = {(r.worker_id, r.verdict_id): r for r in P.reputation_scores(verdict_rows(spark, rows)).collect()}
    assert s[1, 199].score > 0.98 and s[2, 1000].score < 0.7
    assert s[4, 3000].score < s[3, 2000].score and s[4, 3000].spot_failures == 1
    assert s[5, 4000].beta == 6.0  # the cap holds after doubling


def test_ban_and_probation(spark):
    cfg = P.ReputationConfig()
    bad = [(1, 1000 + i, i, False, 4.0, False) for i in range(12)]
    after = 1_000_000
    good = [(1, after + i, 100 + i, True, 0.0, False) for i in range(500)]
    h = {r.verdict_id: r for r in P.reputation_history(verdict_rows(spark, bad + good), cfg).collect()}
    starts = [v for v, r in h.items() if r.ban_started]
    # 2/(4+4) = 0.25 already falls below the limit at the first rejection
    assert starts == [0] and h[0].banned_until == 1000 + 300_000
    assert not h[11].on_probation
    assert h[100].on_probation and h[100].score < 0.3  # the record survives the ban
    cleared = min(v for v, r in h.items() if v >= 100 and not r.on_probation)
    assert h[cleared].score >= 0.90 > h[cleared - 1].score


def test_latest_partial(spark):
    p = spark.createDataFrame([(1, 1, 1, 10), (1, 3, 2, 30), (1, 2, 3, 20), (1, 3, 4, 99), (2, 1, 5, 1)],
                              "task_id long, sequence long, arrival long, units_done long")
    done = spark.createDataFrame([(2,)], "task_id long")
    assert [tuple(r) for r in Q.latest_partial(p, done).collect()] == [(1, 3, 2, 30)]


def test_partials_of_strangers_are_refused(spark):
    p = spark.createDataFrame([(1, 1, 1, 7), (1, 9, 2, 8)], "task_id long, sequence long, arrival long, worker_id long")
    leases = spark.createDataFrame([(1, 7)], "task_id long, worker_id long")
    got = Q.latest_partial(Q.held_partials(p, leases), leases.where("false")).collect()
    assert [(r.sequence, r.worker_id) for r in got] == [(1, 7)]


def statistical(spark, payloads, required=2, cap=4):
    rows = [(1, i + 1, i + 1, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "task_id long, worker_id long, seq long, payload array<struct<r:double,g:double,b:double,samples:double>>")
    return Q.settle(Q.decide_statistical(df, required, cap)).first()


def noisy(seed, pixels=60, bias=0.0, samples=16):
    rng = random.Random(seed)
    return [(*[sum(rng.gauss(10 + bias, 2) for _ in range(samples)) for _ in "rgb"], float(samples)) for _ in range(pixels)]


def test_statistical(spark):
    a, b, c = noisy(1), noisy(2), noisy(3)
    off = noisy(4, bias=3.0)
    r = statistical(spark, [a, b])
    assert (r.action, r.agreeing, r.dissenting, r.dissent_max_rel) == ("Accept", 2, 0, 0.0)
    r = statistical(spark, [a, off, b, c])  # settled by the third
    assert (r.action, r.agreeing, r.dissenting, r.winner_seq, list(r.agreeing_workers)) == ("Accept", 2, 1, 1, [1, 3])
    assert r.dissent_max_rel > 12
    assert statistical(spark, [a, off]).action == "NeedMoreReplicas"
    # Sizes that differ, no samples, and radiance that is not finite are no agreement, not even of equal payloads.
    inf, none, nothing = [(float("inf"), 1.0, 1.0, 4.0)] * 3, [(1.0, 1.0, 1.0, 0.0)] * 3, [(1.0, None, 1.0, 4.0)] * 3
    for pair in ([a, a[:-1]], [inf, inf], [none, none], [nothing, nothing], [None, None], [a, None]):
        assert statistical(spark, pair).action == "NeedMoreReplicas"
    assert statistical(spark, [[], []]).action == "Accept"
    assert statistical(spark, [a, a[:-1], off, [(0.0, 0.0, 0.0, 0.0)]], cap=4).action == "Inconclusive"


def test_statistical_pair_is_the_comparison(spark):
    from fleetlens.operators import compare as C
    tiles = [(i, noisy(i), noisy(100 + i, bias=(i % 4) * 0.15)) for i in range(24)]
    kind = "array<struct<r:double,g:double,b:double,samples:double>>"
    df = spark.createDataFrame(tiles, f"id long, a {kind}, b {kind}")
    got = {r.id: r.p for r in df.select("id", C.statistical_pair(F.col("a"), F.col("b")).alias("p")).collect()}
    sides = [df.select("id", F.posexplode(s).alias("pixel", "v")).select("id", F.col("pixel").cast("long").alias("pixel"), "v.*") for s in "ab"]
    want = {r.id: r for r in C.compare_statistical(*sides, ["id"]).collect()}
    assert {v.verdict for v in want.values()} == {"Match", "Mismatch"}
    for i, p in got.items():
        assert (p.match, p.z_aggregate) == (want[i].verdict == "Match", pytest.approx(want[i].z_aggregate, rel=1e-9))
