"""Keyed streams in event-time order and the upsert table: however rows are dealt to triggers, results are the same."""

import random
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import live as L
from fleetlens.streaming import keyed as K
from fleetlens.streaming import stateful as S
from fleetlens.streaming.upsert import UpsertTable

ROW = "event_id long, t_ms long, event string, task_id long, worker_id long, unit_count long"
START = 1_700_000_000_000


def make_log(n=500):
    rng = random.Random(3)
    rows, t = [], START
    for i in range(n):
        t += rng.randrange(0, 40_000)
        task = 0 if rng.random() < .3 else rng.randrange(1, 12)
        rows.append((i, t, rng.choice(["grant", "renew", "renew", "renew", "accept", "cancel", "expire"]), task, rng.randrange(2), 3))
    return rows


@pytest.fixture
def deal(spark, tmp_path):
    """Write rows as one file per trigger and drain a stream over them; the last file ends the stream."""
    def run(slices, make, name="a", stop_after=None):
        folder = str(tmp_path / f"in-{name}")
        for n, rows in enumerate(slices):
            df = spark.createDataFrame(rows, ROW).withColumn("ts", F.timestamp_millis("t_ms"))
            df.coalesce(1).write.mode("append").parquet(folder)
        K.end_of_stream(spark, folder, df)
        out = []

        def land(batch, batch_id):
            if stop_after is not None and batch_id == stop_after and not stopped:
                stopped.append(batch_id)
                raise RuntimeError("lost")
            out.extend((batch_id, r) for r in batch.collect())
        stopped = []
        for _ in range(2 if stop_after is not None else 1):
            src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            q = (make(src).writeStream.foreachBatch(land).option("checkpointLocation", str(tmp_path / f"state-{name}"))
                 .trigger(availableNow=True).start())
            try:
                q.awaitTermination()
            except Exception:
                assert stopped
        return [r for _, r in out], q
    return run


def shuffled(rows, seed, spread=40):
    """Five triggers; a row comes up to ``spread`` places early or late."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(-spread, spread))
    cut = len(rows) // 5
    return [[rows[i] for i in order[k * cut:(k + 1) * cut if k < 4 else None]] for k in range(5)]


def bag(rows, drop=("late", "t_ms")):
    return Counter(tuple(v for k, v in sorted(r.asDict().items()) if k not in drop) for r in rows)


def test_shuffled_triggers_give_the_batch_result(spark, deal):
    rows = make_log()
    batch = spark.createDataFrame(rows, ROW).withColumn("ts", F.timestamp_millis("t_ms"))
    leases = bag(L.renewed_leases(batch, 120_000, K.FAR_MS).collect())
    released = bag(L.released_work(batch, 60_000).collect())
    assert leases and released and max(r[2] for r in leases) > 0
    for seed in (1, 2):
        slices = shuffled(rows, seed)
        got, _ = deal(slices, lambda s: S.stream_leases(s, 120_000, watermark="2 hours"), f"l{seed}")
        assert bag(got) == leases
        got, q = deal(slices, lambda s: S.stream_released(s, 60_000, watermark="2 hours"), f"r{seed}")
        assert bag(got) == released
        # Workers that were lost and hold nothing are forgotten.
        assert q.lastProgress.stateOperators[0].numRowsTotal == 0


def test_a_lost_trigger_is_made_up_for_once(spark, deal):
    rows = make_log(300)
    batch = spark.createDataFrame(rows, ROW).withColumn("ts", F.timestamp_millis("t_ms"))
    for stop in (2, 5):
        got, _ = deal(shuffled(rows, 4), lambda s: S.stream_leases(s, 120_000, watermark="2 hours"), f"c{stop}", stop_after=stop)
        assert bag(got) == bag(L.renewed_leases(batch, 120_000, K.FAR_MS).collect())


def test_late_rows_change_nothing_and_are_kept_apart(spark, deal):
    rows = make_log(300)
    slow = rows[10:300:29]
    slices = shuffled([r for r in rows if r not in slow], 5, spread=0)
    slices[4] += slow
    marks = [max(r[1] for s in slices[:k] for r in s) - 600_000 if k else 0 for k in range(5)]
    late = {r[0] for k, s in enumerate(slices) for r in s if r[1] <= marks[k]}
    assert 3 < len(late) < len(slow) + 1

    def make(s):
        return S.stream_lifecycle(s.withColumn("task_event", F.initcap("event")), ["t_ms", "event_id"], "ts", "10 minutes")
    got, _ = deal(slices, make)
    assert Counter(r.t_ms for r in got if r.late) == Counter(r[1] for r in rows if r[0] in late)
    df = spark.createDataFrame([r for r in rows if r[0] not in late], ROW).withColumn("task_event", F.initcap("event"))
    want = L.lifecycle(df, ["t_ms", "event_id"]).select("task_id", "event_id", "state", "legal")
    assert Counter((r.task_id, r.event_id, r.state, r.legal) for r in got if not r.late) == Counter(map(tuple, want.collect()))


def test_renewals_follow_the_lease_rules():
    rule = K.Lease(1000)
    state, _ = rule.rows(None, [(0, "grant", 7, 5)])
    assert rule.deadline(state) == 1000
    state, _ = rule.rows(state, [(500, "renew", 7, 0)])
    assert rule.deadline(state) == 1500
    state, _ = rule.rows(state, [(600, "renew", 8, 0)])
    assert rule.deadline(state) == 1500, "only the holder renews"
    assert rule.fire(state) == (None, [(7, 5, 0, 1, 1500)])
    assert rule.rows(None, [(1600, "renew", 7, 0)]) == (None, []), "no lease to renew"


def updates(spark, batch_id):
    """Key 0 in every batch, others seldom."""
    return spark.createDataFrame([(0, batch_id * 10), (1 + batch_id % 7, batch_id)], "k long, v long")


def want(n):
    return {0: (n - 1) * 10} | {1 + b % 7: b for b in range(n)}


def test_upsert_folders_do_not_grow(spark, tmp_path):
    table, schema = UpsertTable(spark, str(tmp_path / "t"), ["k"], merge_every=3), updates(spark, 0).schema
    assert table.read(schema).count() == 0
    counts = set()
    for b in range(20):
        table.land(updates(spark, b), b)
        held = table.read()
        if b >= 12:
            counts.add(sum(1 for p in Path(tmp_path / "t").glob("*/*") if p.is_dir()))
        if b in (0, 2, 3, 11, 19):
            assert dict(map(tuple, held.collect())) == want(b + 1)
    assert max(counts) <= 2 * 3 + 3 + 4
    before = table.read()
    table.land(updates(spark, 20), 20)
    assert dict(map(tuple, before.collect())) == want(20), "a reader keeps its version"


def test_upsert_survives_replays_and_crashes(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], merge_every=3)
    for b in range(5):
        table.land(updates(spark, b), b)
    table.land(updates(spark, 0), 4)
    assert dict(map(tuple, table.read().collect())) == want(5), "a trigger that was committed is not taken again"
    # Batch 5 merges; it fails after the delta and the new base, before the manifest.
    make = spark.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.land(make([(0, 50), (6, 5)], "k long, v long"), 5)
    assert dict(map(tuple, table.read().collect())) == want(5)
    table.land(updates(spark, 5), 5)
    assert dict(map(tuple, table.read().collect())) == want(6)
    # A manifest folder that is being rewritten is one of the older ones.
    shutil.rmtree(tmp_path / "t" / "manifest" / str(6 % 4))
    assert dict(map(tuple, table.read().collect())) == want(6)


def test_rows_that_move_the_watermark_make_no_key(spark, deal):
    rows = make_log(200)
    with K.short_batches(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
        got, q = deal([rows], lambda s: S.stream_leases(s, 120_000, watermark="2 hours"), "w")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    batch = spark.createDataFrame(rows, ROW).withColumn("ts", F.timestamp_millis("t_ms"))
    assert bag(got) == bag(L.renewed_leases(batch, 120_000, K.FAR_MS).collect())
    assert all(r.late is False for r in got)
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(keys) == len({r[3] for r in rows})


def test_in_order_leaves_out_events_without_a_time(spark, tmp_path):
    from fleetlens.plans import bindings as B
    from fleetlens.plans import queries_live as Q

    day, kinds = 86_400, ["click", "view", "error", "signup"]
    rows = [(i, 1_704_067_200 + i * day // 10, i % 7, kinds[i % 4], 1.0, f'{{"k": {i % 90}}}') for i in range(200)] + [(200, None, 3, "view", 1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    df.select(*[f.split()[0] for f in B.TABLES["events"].split(", ")]).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = Q.stream_in_order(spark, str(tmp_path)).collect()
    assert len(got) == 7 and sum(r.late + r.applied + r.illegal for r in got) == 200
    assert sum(r.late for r in got) > 0


def test_keys_in_buckets_give_the_same_rows(spark, deal):
    rows = [(*r[:3], None if r[3] == 5 else r[3], *r[4:]) for r in make_log(300)]
    slices = shuffled(rows, 6)

    def make(s, **kw):
        return K.in_order(s, ["task_id"], ["event_id"], K.Lease(120_000), watermark="10 minutes", **kw)
    alone, _ = deal(slices, make, "alone")
    got, q = deal(slices, lambda s: make(s, buckets=3), "buckets", stop_after=2)
    assert bag(got, drop=()) == bag(alone, drop=())
    assert any(r.late for r in got) and any(r.task_id is None and not r.late for r in got)
    # Keys without a value are a group of their own.
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= 3 + 1 and states[-1] == 0
