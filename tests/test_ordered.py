"""Split groups must give what one ordered pass gives."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ordered as O
from fleetlens.operators.live import transition_table


def skewed(spark, n=3000, keys=7, seed=1):
    """One key holds two thirds of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.66 else rng.randrange(1, keys)
        rows.append((k, rng.randrange(0, 40), i, rng.randrange(-5, 9), rng.choice([None, i])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, t long, id long, v long, m long").repartition(3)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, hot, inclusive):
    rows, df = skewed(spark)
    got = O.running(df, ["k"], ["t", "id"], {
        "s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "l": ("last", F.col("m")),
        "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, inclusive=inclusive, hot=hot)
    have = {r.id: (r.s, r.n, r.l, r.lo, r.hi) for r in got.collect()}
    assert len(have) == len(rows)
    for g in groups(rows).values():
        for i, r in enumerate(g):
            seen = g[:i + 1] if inclusive else g[:i]
            vs, ms = [x[3] for x in seen], [x[4] for x in seen if x[4] is not None]
            assert have[r[2]] == (sum(vs), len(vs), ms[-1] if ms else None,
                                  min(vs) if vs else None, max(vs) if vs else None)


def test_running_descending_and_without_key(spark):
    rows, df = skewed(spark, 500)
    for hot in (False, True):
        got = O.running(df, [], ["-t", "-id"], {"nxt": ("last", F.col("id"))}, inclusive=False, hot=hot)
        have = {r.id: r.nxt for r in got.collect()}
        order = sorted(rows, key=lambda r: (r[1], r[2]))
        assert have == {r[2]: (order[i + 1][2] if i + 1 < len(order) else None) for i, r in enumerate(order)}


def test_hot_key_is_cut_into_pieces(spark):
    _, df = skewed(spark)
    pieces = O.split_ranges(df, ["k"], ["t", "id"])
    per_key = pieces.groupBy("k").agg(F.count_distinct(O.CHUNK).alias("n")).where("k = 0").first()["n"]
    largest = pieces.groupBy(O.CHUNK).count().agg(F.max("count")).first()[0]
    assert per_key > 1 and largest < 3000 * 0.5


def test_hot_groups_are_found(spark):
    even = spark.createDataFrame([(i % 500,) for i in range(3000)], "k long")
    _, df = skewed(spark)
    spark.conf.set("spark.fleetlens.hotRows", "100")
    try:
        assert O.is_hot(df, ["k"]) and not O.is_hot(even, ["k"])
        assert O.is_hot(even, [])  # one group of all rows
    finally:
        spark.conf.unset("spark.fleetlens.hotRows")
    assert not O.is_hot(df, ["k"])


@pytest.mark.parametrize("low, high", [(0, 0), (5, 4), (-3, 70_000)])
def test_expand(spark, low, high):
    df = spark.createDataFrame([(1, low, high)], "id long, a long, b long")
    got = O.expand(df, F.col("a"), F.col("b"), "i", block=1000, spread=3)
    n = max(0, high - low + 1)
    assert got.agg(F.count("i"), F.count_distinct("i"), F.min("i"), F.max("i")).first()[:] == (
        (n, n, low, high) if n else (0, 0, None, None))


@pytest.mark.parametrize("split", [False, True])
def test_nearest_ranks(spark, split):
    spark.conf.set("spark.fleetlens.hotRows", "0" if split else "1000000")
    rows, df = skewed(spark)
    got = {r.k: r for r in O.nearest_ranks(df, ["k"], "v", {
        "lo": O.lower_mid, "hi": O.upper_mid, "p95": O.rank_of(0.95), "p99": O.rank_of(0.99)}).collect()}
    spark.conf.unset("spark.fleetlens.hotRows")
    for k, g in groups(rows).items():
        s = sorted(r[3] for r in g)
        n = len(s)
        want = (n, s[(n - 1) // 2], s[n // 2], s[min(n - 1, int(.95 * n))], s[min(n - 1, int(.99 * n))])
        assert (got[k].n, got[k].lo, got[k].hi, got[k].p95, got[k].p99) == want


@pytest.mark.parametrize("hot", [False, True])
def test_ewma(spark, hot):
    rows, df = skewed(spark)
    df = df.withColumn("p", F.greatest("v", F.lit(0)).cast("double")).withColumn("q", (F.col("t") + 1).cast("double"))
    got = O.scan(df, ["k"], ["t", "id"], ["p", "q"], O.Ewma("p", "q", 0.3, 0.1, 1000.0), hot)
    have = {r.id: r.correction_after for r in got.collect()}
    for g in groups(rows).values():
        x = 1.0
        for _, t, i, v, _ in g:
            if v > 0:
                x = 0.7 * x + 0.3 * min(max((t + 1) / v, 0.1), 1000.0)
            assert have[i] == pytest.approx(x, rel=1e-9)


@pytest.mark.parametrize("hot", [False, True])
def test_state_machine(spark, hot):
    rows, df = skewed(spark)
    table = transition_table()
    df = df.withColumn("code", (F.col("v") + 5).cast("int") % 11 - 1).drop("m")
    got = O.scan(df, ["k"], ["t", "id"], ["code"], O.StateMachine("code", table), hot)
    have = {r.id: (r.state_code, r.legal) for r in got.collect()}
    for g in groups(rows).values():
        s = 0
        for r in g:
            e = (r[3] + 5) % 11 - 1
            nxt = table[s][e] if e >= 0 else -1
            s = nxt if nxt >= 0 else s
            assert have[r[2]] == (s, nxt >= 0)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("length", [1, 3, 7, 50])
def test_cooldown(spark, hot, length):
    rows, df = skewed(spark)
    df = df.withColumn("strike", F.col("v") > 2).drop("m")
    got = O.scan(df, ["k"], ["t", "id"], ["t", "strike"], O.Cooldown("t", "strike", length), hot)
    have = {r.id: (r.ban_started, r.banned_until) for r in got.collect()}
    for g in groups(rows).values():
        until = 0.0
        for _, t, i, v, _ in g:
            start = v > 2 and until <= t
            until = float(t + length) if start else until
            assert have[i] == (start, until)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("group, total", [(0, 10**9), (37, 10**9), (1000, 4000), (5, 100), (900, 900)])
def test_carve(spark, hot, group, total):
    rows, df = skewed(spark)
    df = (df.withColumn("size", F.col("v") + 6).withColumn("tot", F.lit(total).cast("long"))
          .withColumn("grp", F.lit(group).cast("long")).drop("m"))
    got = O.scan(df, ["k"], ["t", "id"], ["size", "tot", "grp"], O.Carve("size", "tot", "grp"), hot)
    have = {r.id: (r.start_unit, r.granted) for r in got.collect()}
    for g in groups(rows).values():
        cur = 0
        for r in g:
            take = min(r[3] + 6, total - cur)
            if group:
                take = min(take, group - cur % group)
            assert have[r[2]] == (cur, take)
            cur += take


def test_rows_made_by_an_explode_are_counted(spark):
    from pyspark.sql import functions as F

    from fleetlens.operators.ordered import is_hot

    spark.conf.set("spark.fleetlens.hotRows", "1000")
    try:
        few = spark.range(10).select(F.lit(1).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(500))).alias("v"))
        assert is_hot(few, ["k"])
        assert not is_hot(spark.range(10).select((F.col("id") % 2).alias("k")), ["k"])
    finally:
        spark.conf.unset("spark.fleetlens.hotRows")
