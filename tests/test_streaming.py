"""Streams over several triggers must equal their batch twins on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import live as L
from fleetlens.operators import reputation as P
from fleetlens.operators import summary as A
from fleetlens.streaming import stateful as S

ROW = "event_id long, t_ms long, event string, task_id long, worker_id long, unit_count long, duration_ms double, predicted_ms double"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Six files, one per trigger; one worker and one task hold a third of the rows."""
    rng = random.Random(5)
    rows, t = [], 1_700_000_000_000
    for i in range(600):
        t += rng.randrange(500, 9000)
        w = 0 if rng.random() < .34 else rng.randrange(1, 6)
        k = 0 if rng.random() < .34 else rng.randrange(1, 25)
        e = rng.choice(["grant", "grant", "accept", "expire", "cancel", "worker_join"])
        rows.append((i, t, e, k, w, rng.randrange(1, 50), float(rng.randrange(1, 400)), float(rng.randrange(0, 300))))
    path = str(tmp_path_factory.mktemp("log"))
    df = spark.createDataFrame(rows, ROW)
    for n in range(6):
        df.where(F.col("event_id").between(n * 100, n * 100 + 99)).coalesce(1).write.mode("append").parquet(path)
    ts = F.timestamp_millis("t_ms").alias("ts")
    return spark.read.parquet(path).select("*", ts), path, ts


@pytest.fixture
def drain(spark, log, tmp_path):
    schema = spark.read.parquet(log[1]).schema

    def run(make, mode="append", keys=None):
        src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log[1]).select("*", log[2]))
        q = (S.stream_upsert(make(src), str(tmp_path / "rows"), mode).option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert len(q.recentProgress) >= 6
        return S.read_upserted(spark, str(tmp_path / "rows"), keys)
    return run


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def task_events(ev):
    names = F.array(*[F.lit(e) for e in ("Grant", "Renew", "Submit", "LeaseExpired", "Accept", "Cancel")])
    return ev.select("task_id", "t_ms", "event_id", F.element_at(names, (F.col("unit_count") % 6 + 1).cast("int")).alias("task_event"))


def test_lifecycle(drain, log):
    order = ["t_ms", "event_id"]
    got = drain(lambda s: S.stream_lifecycle(task_events(s), order))
    want = L.lifecycle(task_events(log[0]), order)
    cols = ("task_id", "event_id", "state", "legal")
    assert rows_of(got, *cols) == rows_of(want, *cols)
    assert rows_of(L.lifecycle_totals(got, order), "task_id", "state", "applied", "illegal") == \
        rows_of(L.lifecycle_totals(want, order), "task_id", "state", "applied", "illegal")


def test_correction(drain, log):
    acc = log[0].where("event = 'accept'")
    got = drain(lambda s: S.stream_correction(s.where("event = 'accept'").select(
        "worker_id", "t_ms", "event_id", "predicted_ms", F.col("duration_ms").alias("actual_ms"))))
    assert rows_of(got, "event_id", "correction_after") == rows_of(A.correction_history(acc), "event_id", "correction_after")


def verdicts(ev):
    return ev.select("worker_id", "t_ms", F.col("event_id").alias("verdict_id"), (F.col("unit_count") % 5 > 1).alias("accepted"),
                     (F.col("unit_count") % 4).cast("double").alias("severity"), (F.col("unit_count") % 7 == 0).alias("spot"))


@pytest.mark.parametrize("hot", ["1000000", "0"])
def test_reputation(spark, drain, log, hot):
    cfg = P.ReputationConfig(blacklist_below=0.5, trusted_at=0.52, cooldown_ms=60_000)
    cols = ("verdict_id", "alpha", "beta", "score", "ban_started", "banned_until", "on_probation")
    got = drain(lambda s: S.stream_reputation(verdicts(s), cfg))
    spark.conf.set("spark.fleetlens.hotRows", hot)
    want = P.reputation_history(verdicts(log[0]), cfg)
    a, b = rows_of(got, *cols), rows_of(want, *cols)
    spark.conf.unset("spark.fleetlens.hotRows")
    assert a == b
    assert any(r[4] for r in a) and any(r[6] for r in a)


def test_expiry(drain, log):
    lease = 40_000
    got = drain(lambda s: S.stream_expiry(s, lease, "1 minute"))
    kinds = log[0].where("event in ('grant', 'accept', 'cancel')")
    now = kinds.agg(F.max("t_ms")).first()[0] - 60_000
    cols = ("task_id", "worker_id", "unit_count", "granted_at_ms", "expired_at_ms")
    # a silent task fires once the watermark has passed its deadline
    want = rows_of(L.lease_expiries(log[0], lease, now - 1), *cols)
    assert rows_of(got, *cols) == want and want


def test_sessions(drain, log):
    got = drain(lambda s: S.stream_lost(s, "30 seconds", "1 minute"))
    want = L.worker_sessions(log[0], 30_000_000)
    mark = (log[0].agg(F.max("t_ms")).first()[0] - 60_000) * 1000
    cols = ("worker_id", "start_us", "end_us", "events")
    assert rows_of(got, *cols) == rows_of(want.where(F.col("end_us") <= mark), *cols)


def test_timeline_and_window_cap(drain, log):
    got = drain(lambda s: S.stream_timeline(s, "1 minute", "1 minute"))
    want = L.timeline(log[0], "1 minute")
    mark = log[0].agg(F.max("t_ms")).first()[0] - 60_000
    assert rows_of(got, *want.columns) == rows_of(want.where(F.col("window_ms") + 60_000 <= mark), *want.columns)


def test_window_cap(drain, log):
    got = drain(lambda s: S.stream_window_cap(s, ["worker_id"], "5 minutes", 3, "1 minute"))
    b = L.window_cap(log[0], ["worker_id"], ["t_ms", "event_id"], "5 minutes", 3)
    want = b.groupBy("worker_id", "window_us").agg(F.count("nth").alias("sent"), F.count_if("refused").alias("refused"))
    mark = (log[0].agg(F.max("t_ms")).first()[0] - 60_000) * 1000
    want = want.where(F.col("window_us") + 300_000_000 <= mark)
    cols = ("worker_id", "window_us", "sent", "refused")
    assert rows_of(got, *cols) == rows_of(want, *cols)


def test_first_result_drops_later_ones(drain, log):
    got = drain(lambda s: S.stream_first_result(s.where("event = 'accept'"), "10 days"))
    want = L.first_result(log[0].where("event = 'accept'").select("task_id", "event_id", "t_ms"), ["t_ms", "event_id"])
    assert rows_of(got, "task_id") == rows_of(want, "task_id")


def test_partial(drain, log):
    def shape(ev):
        return ev.select("task_id", F.col("unit_count").alias("sequence"), F.col("event_id").alias("arrival"), "duration_ms")
    from fleetlens.operators.quorum import latest_partial
    got = drain(lambda s: S.stream_partial(shape(s)), "update", ["task_id"])
    want = latest_partial(shape(log[0]), log[0].where("false"))
    cols = ("task_id", "sequence", "arrival", "duration_ms")
    assert rows_of(got, *cols) == rows_of(want, *cols)


def test_offenders(drain, log):
    bad = F.col("event") == "expire"
    got = drain(lambda s: S.stream_offenders(s, ["worker_id"], bad), "update", ["worker_id"])
    b = L.offender_tiers(log[0], ["worker_id"], ["t_ms", "event_id"], bad)
    want = b.groupBy("worker_id").agg(F.max("bad_count").alias("bad_count"), F.max_by("tier", F.struct("t_ms", "event_id")).alias("tier"))
    assert rows_of(got, "worker_id", "bad_count", "tier") == rows_of(want, "worker_id", "bad_count", "tier")


def sweeps(ev):
    return ev.select("worker_id", "t_ms", "event_id", F.lit(1).alias("workers"), F.lit(1).alias("outstanding"),
                     (F.col("event") == "accept").cast("long").alias("leased"))


def test_stall(drain, log):
    order = ["t_ms", "event_id"]
    got = drain(lambda s: S.stream_stall(sweeps(s), ["worker_id"], order, 5))
    want = L.stalls(sweeps(log[0]), order, ["worker_id"], 5)
    assert rows_of(got.where("stall = 'onset'"), "worker_id", "t_ms") == rows_of(want, "worker_id", "onset")
    assert rows_of(got.where("stall = 'cleared'"), "worker_id", "t_ms") == \
        rows_of(want.where("cleared >= 0"), "worker_id", "cleared")


def test_upsert_is_idempotent(spark, log, tmp_path):
    path = str(tmp_path / "u")
    agg = log[0].groupBy("worker_id").agg(F.count("event_id").alias("n"))
    for _ in range(2):  # the same batch replayed
        agg.write.mode("overwrite").parquet(f"{path}/batch_id=0")
    agg.withColumn("n", F.col("n") + 1).where("worker_id = 0").write.mode("overwrite").parquet(f"{path}/batch_id=1")
    got = {r.worker_id: r.n for r in S.read_upserted(spark, path, ["worker_id"]).collect()}
    want = {r.worker_id: r.n + (r.worker_id == 0) for r in agg.collect()}
    assert got == want
