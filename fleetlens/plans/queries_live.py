"""Live operators over the test tables. Keys named ``stream_*`` run a real
stream over the table's files (``availableNow``) unless noted."""

import uuid

from pyspark.sql import functions as F

from fleetlens.functions.exprs import EVENTS
from fleetlens.operators import live as L
from fleetlens.plans import bindings as B
from fleetlens.plans.catalog import query
from fleetlens.plans.queries_exprs import TRANSITION_ROWS
from fleetlens.session import checkpoint_dir
from fleetlens.streaming import stateful as S
from fleetlens.streaming.keyed import FAR_MS, end_of_stream, short_batches
from fleetlens.streaming.upsert import UpsertTable


def stream_table(spark, sf, name):
    """A test table as a file stream."""
    return spark.readStream.schema(B.TABLES[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def fresh_folder(spark):
    return f"{checkpoint_dir(spark)}/fleetlens-streams/{uuid.uuid4().hex}"


def run_now(spark, df, mode, keys=None):
    """Drain a stream into the shared folder and read the landed rows; with ``keys`` the latest row of each."""
    base = fresh_folder(spark)
    if keys:
        kept = UpsertTable(spark, f"{base}/rows", keys)
        (df.writeStream.outputMode(mode).foreachBatch(kept.land).option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start().awaitTermination())
        return kept.read(df.schema)
    drain(spark, df, mode, base)
    return S.read_upserted(spark, f"{base}/rows")


def drain(spark, df, mode, base):
    """Land what a stream has not yet landed in ``base``."""
    with short_batches(spark):
        land(spark, df, mode, base)


def land(spark, df, mode, base, settle=True):
    """As ``drain``, in batches of the session's size. Without ``settle`` what the new watermark has passed waits for the next
    trigger, which handles it before its own rows."""
    conf = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(settle and before == "true").lower())
    try:
        q = (S.stream_upsert(df, f"{base}/rows", mode).option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)


def _stream_events(spark, sf, whole=False):
    """The event stream; with ``whole`` a last row moves the watermark past all others."""
    ev = B.as_event_log(stream_table(spark, sf, "events"))
    return ev.unionByName(end_of_stream(spark, fresh_folder(spark), ev)) if whole else ev


def on_time(got):
    return got.where("NOT late").drop("late")


# Test events become task events of the worker they name.
TASK_EVENT = "[" + ", ".join(f"'{e}'" for e in EVENTS) + "][(k + event_id) % 10 + 1]"


def _task_events(ev):
    name = F.element_at(F.array(*[F.lit(e) for e in EVENTS]), ((F.col("k") + F.col("event_id")) % 10 + 1).cast("int"))
    return ev.select(F.col("worker_id").alias("task_id"), "t_ms", "event_id", name.alias("task_event"), "ts")


LIFE = f"""
WITH RECURSIVE tr(s, e, t) AS (VALUES {TRANSITION_ROWS}),
 x AS (SELECT worker_id AS task_id, t_ms, event_id, {TASK_EVENT} AS task_event,
   row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS i FROM ev),
 f AS (SELECT DISTINCT task_id, 0::BIGINT AS i, 0::BIGINT AS t_ms, 0::BIGINT AS event_id, '' AS task_event, 'Queued' AS state, true AS legal FROM x
   UNION ALL SELECT x.task_id, x.i, x.t_ms, x.event_id, x.task_event, coalesce(tr.t, f.state), tr.t IS NOT NULL
   FROM f JOIN x ON x.task_id = f.task_id AND x.i = f.i + 1 LEFT JOIN tr ON tr.s = f.state AND tr.e = x.task_event)"""


@query("lifecycle", ["ev"], f"{LIFE} SELECT task_id, t_ms, event_id, task_event, state, legal FROM f WHERE i > 0")
def lifecycle(spark, sf):
    return L.lifecycle(_task_events(B.event_log(spark, sf)).drop("ts"), ["t_ms", "event_id"])


@query("stream_lifecycle", ["ev"], f"""
{LIFE} SELECT task_id, arg_max(state, i) AS state, count(*) FILTER (legal) AS applied, count(*) FILTER (NOT legal) AS illegal
FROM f WHERE i > 0 GROUP BY task_id""")
def stream_lifecycle(spark, sf):
    order = ["t_ms", "event_id"]
    got = run_now(spark, S.stream_lifecycle(_task_events(_stream_events(spark, sf, whole=True)), order, "ts"), "append")
    return L.lifecycle_totals(on_time(got), order)


#: Groups that share a call and a state where each trigger touches most keys.
KEY_BUCKETS = 512
SLICE_MS, JITTER_MS, DELAY_MS = 4 * B.DAY_MS, B.DAY_MS // 2, B.DAY_MS
START_MS = 1_704_067_200_000  # 2024-01-01, the first day of the events
SLICE = f"(t_ms - {START_MS} + event_id * 7919 % {JITTER_MS}) {{div}} {SLICE_MS} + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END"


@query("stream_in_order", ["ev"], f"""
WITH RECURSIVE tr(s, e, t) AS (VALUES {TRANSITION_ROWS}),
 sl AS (SELECT *, {SLICE.format(div="//")} AS slice FROM ev),
 marks AS (SELECT slice, max(max(t_ms)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_MS} AS mark FROM sl GROUP BY slice),
 judged AS (SELECT sl.*, coalesce(t_ms <= mark, false) AS late FROM sl JOIN marks USING (slice)),
 x AS (SELECT worker_id AS task_id, {TASK_EVENT} AS task_event, row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS i
   FROM judged WHERE NOT late),
 f AS (SELECT DISTINCT task_id, 0::BIGINT AS i, 'Queued' AS state, true AS legal FROM x
   UNION ALL SELECT x.task_id, x.i, coalesce(tr.t, f.state), tr.t IS NOT NULL
   FROM f JOIN x ON x.task_id = f.task_id AND x.i = f.i + 1 LEFT JOIN tr ON tr.s = f.state AND tr.e = x.task_event)
SELECT worker_id AS task_id, count(*) FILTER (late) AS late, any_value(state) AS state, coalesce(any_value(applied), 0) AS applied,
  coalesce(any_value(illegal), 0) AS illegal
FROM judged LEFT JOIN (SELECT task_id AS task, arg_max(state, i) AS state, count(*) FILTER (legal) AS applied, count(*) FILTER (NOT legal) AS illegal
  FROM f WHERE i > 0 GROUP BY task_id) ON task = worker_id GROUP BY worker_id""")
def stream_in_order(spark, sf):
    """The lifecycle of events that come in eight triggers, out of order by half a day and one in fifty by four days.

    All slices are staged by one parallel write; each is then fed to the stream, which goes on from its checkpoint. A slice
    has events of nearly all keys, so these are handled in buckets, and once for each slice. Events without a time are in no slice."""
    staged, folder, base = (fresh_folder(spark) for _ in range(3))
    ev = _task_events(B.event_log(spark, sf)).withColumn("slice", F.expr(SLICE.format(div="div")))
    ev.where("slice IS NOT NULL").write.partitionBy("slice").parquet(staged)
    slices = sorted(r.slice for r in spark.read.schema(ev.schema).parquet(staged).select("slice").distinct().collect())
    like, order = ev.drop("slice"), ["t_ms", "event_id"]
    for n in [*slices, None]:
        if n is None:
            end_of_stream(spark, folder, like)
        else:
            spark.read.schema(like.schema).parquet(f"{staged}/slice={n}").write.mode("append").parquet(folder)
        events = spark.readStream.schema(like.schema).parquet(folder)
        land(spark, S.stream_lifecycle(events, order, "ts", "1 day", KEY_BUCKETS), "append", base, settle=n is None)
    got = S.read_upserted(spark, f"{base}/rows")
    late = got.groupBy("task_id").agg(F.count_if("late").alias("late"))
    return late.join(L.lifecycle_totals(on_time(got), order), "task_id", "left").fillna(0, ["applied", "illegal"])


HOLD_MS = B.DAY_MS // 2
LEASED = """
x AS (SELECT worker_id AS task_id, k % 2 AS worker_id, unit_count, t_ms, event_id, CASE event WHEN 'worker_join' THEN 'renew' ELSE event END AS event,
  row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS i FROM ev WHERE event <> 'expire')"""
RENEWED = f"""
WITH RECURSIVE {LEASED.strip()},
f AS (SELECT DISTINCT task_id, 0::BIGINT AS i, 0::BIGINT AS holder, 0::BIGINT AS units, 0::BIGINT AS granted, 0::BIGINT AS renewals,
    NULL::BIGINT AS deadline FROM x
  UNION ALL SELECT x.task_id, x.i,
    CASE WHEN x.event = 'grant' THEN x.worker_id ELSE f.holder END, CASE WHEN x.event = 'grant' THEN x.unit_count ELSE f.units END,
    CASE WHEN x.event = 'grant' THEN x.t_ms ELSE f.granted END,
    CASE WHEN x.event = 'grant' THEN 0 WHEN x.event = 'renew' AND x.worker_id = f.holder THEN f.renewals + 1 ELSE f.renewals END,
    CASE WHEN x.event = 'grant' THEN x.t_ms + {HOLD_MS} WHEN x.event <> 'renew' OR f.deadline <= x.t_ms THEN NULL
         WHEN x.worker_id = f.holder AND f.deadline IS NOT NULL THEN x.t_ms + {HOLD_MS} ELSE f.deadline END
  FROM f JOIN x ON x.task_id = f.task_id AND x.i = f.i + 1)
SELECT f.task_id, f.holder AS worker_id, units AS unit_count, granted AS granted_at_ms, renewals, deadline AS expired_at_ms
FROM f LEFT JOIN x ON x.task_id = f.task_id AND x.i = f.i + 1 WHERE deadline IS NOT NULL AND (x.t_ms IS NULL OR deadline <= x.t_ms)"""


def _lease_events(ev):
    """Each worker's log as a task's: two holders, joins as renewals."""
    return ev.where("event IS NULL OR event <> 'expire'").select(
        F.col("worker_id").alias("task_id"), (F.col("k") % 2).alias("worker_id"), "unit_count", "t_ms", "event_id",
        F.when(F.col("event") == "worker_join", "renew").otherwise(F.col("event")).alias("event"), "ts")


@query("lease_renewals", ["ev"], RENEWED)
def lease_renewals(spark, sf):
    return L.renewed_leases(_lease_events(B.event_log(spark, sf)), HOLD_MS, FAR_MS)


@query("stream_lease_renewals", ["ev"], RENEWED)
def stream_lease_renewals(spark, sf):
    return on_time(run_now(spark, S.stream_leases(_lease_events(_stream_events(spark, sf, whole=True)), HOLD_MS), "append")).drop("t_ms")


RELEASED = f"""
WITH g AS (SELECT worker_id, k % 5 AS task_id, t_ms, event_id, event, lead(t_ms) OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS next_ms FROM ev),
l AS (SELECT *, min(CASE WHEN next_ms IS NULL OR next_ms - t_ms >= {HOLD_MS} THEN t_ms + {HOLD_MS} END)
  OVER (PARTITION BY worker_id ORDER BY t_ms, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lost_at_ms FROM g),
t AS (SELECT *, lead(t_ms) OVER (PARTITION BY worker_id, task_id ORDER BY t_ms, event_id) AS then_ms FROM l
  WHERE event IN ('grant', 'accept', 'cancel', 'expire'))
SELECT worker_id, task_id, t_ms AS granted_at_ms, lost_at_ms FROM t WHERE event = 'grant' AND (then_ms IS NULL OR then_ms >= lost_at_ms)"""


def _held(ev):
    return ev.select("worker_id", (F.col("k") % 5).alias("task_id"), "t_ms", "event_id", "event", "ts")


@query("released_work", ["ev"], RELEASED)
def released_work(spark, sf):
    return L.released_work(_held(B.event_log(spark, sf)), HOLD_MS)


@query("stream_released", ["ev"], RELEASED)
def stream_released(spark, sf):
    got = run_now(spark, S.stream_released(_held(_stream_events(spark, sf, whole=True)), HOLD_MS), "append")
    return on_time(got).drop("t_ms")


LEASE = 6 * 3_600_000


@query("lease_expiries", ["ev"], f"""
SELECT task_id, worker_id, unit_count, t_ms AS granted_at_ms, t_ms + {LEASE} AS expired_at_ms FROM (
  SELECT *, lead(t_ms) OVER (PARTITION BY task_id ORDER BY t_ms, event_id) AS next_ms FROM ev WHERE event IN ('grant', 'accept', 'cancel'))
WHERE event = 'grant' AND (next_ms IS NULL AND t_ms + {LEASE} <= 1706745600000 OR next_ms >= t_ms + {LEASE})""")
def lease_expiries(spark, sf):
    return L.lease_expiries(B.event_log(spark, sf, "grant", "accept", "cancel"), LEASE, 1_706_745_600_000)


@query("stream_expiry", ["ev"], f"""
WITH m AS (SELECT max(t_ms) - 600000 AS mark FROM ev WHERE event IN ('grant', 'accept', 'cancel'))
SELECT task_id, worker_id, unit_count, t_ms AS granted_at_ms, t_ms + {LEASE} AS expired_at_ms FROM (
  SELECT *, lead(t_ms) OVER (PARTITION BY task_id ORDER BY t_ms, event_id) AS next_ms FROM ev WHERE event IN ('grant', 'accept', 'cancel')), m
WHERE event = 'grant' AND (next_ms IS NULL AND t_ms + {LEASE} < mark OR next_ms >= t_ms + {LEASE})""")
def stream_expiry(spark, sf):
    return run_now(spark, S.stream_expiry(_stream_events(spark, sf), LEASE), "append")


SESSIONS = """
SELECT worker_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY us) AS s FROM (
    SELECT user_id AS worker_id, epoch_us(ts) AS us,
      CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY worker_id, s"""


@query("worker_sessions", [], SESSIONS)
def worker_sessions(spark, sf):
    return L.worker_sessions(B.event_log(spark, sf), 12 * 3_600_000_000)


@query("stream_lost", [], f"""
SELECT worker_id, start_us, end_us, events FROM ({SESSIONS})
WHERE end_us // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)""")
def stream_lost(spark, sf):
    return run_now(spark, S.stream_lost(_stream_events(spark, sf), "12 hours"), "append")


@query("first_result", ["ev"], """
SELECT task_id, arg_min(event_id, event_id) AS event_id, arg_min(t_ms, event_id) AS t_ms, arg_min(worker_id, event_id) AS worker_id
FROM ev WHERE event = 'accept' GROUP BY task_id""")
def first_result(spark, sf):
    r = B.event_log(spark, sf, "accept").select("task_id", "event_id", "t_ms", "worker_id")
    return L.first_result(r, ["t_ms", "event_id"])


@query("stream_first_result", ["ev"], "SELECT DISTINCT task_id FROM ev WHERE event = 'accept'")
def stream_first_result(spark, sf):
    # Which of several results of one trigger is kept is open, so only the task is reported.
    r = _stream_events(spark, sf).where("event = 'accept'").select("task_id", "ts")
    return run_now(spark, S.stream_first_result(r, "60 days"), "append").select("task_id")


@query("stream_reputation", ["rep"], """
WITH RECURSIVE s AS (SELECT worker_id, t_ms, verdict_id, accepted, alpha / (alpha + beta) AS score,
    row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, verdict_id) AS i FROM rep),
 f AS (SELECT DISTINCT worker_id, 0::BIGINT AS i, 0::BIGINT AS verdict_id, 0.0::DOUBLE AS score, false AS ban_started, 0::BIGINT AS active,
    false AS on_probation FROM s
  UNION ALL SELECT worker_id, i, verdict_id, score, started, CASE WHEN started THEN t_ms + 86400000 WHEN ended THEN 0 ELSE active END,
    CASE WHEN accepted AND score >= 0.55 THEN false ELSE on_probation OR ended END
  FROM (SELECT s.*, f.active, f.on_probation, f.active > 0 AND f.active <= s.t_ms AS ended,
      NOT s.accepted AND s.score < 0.45 AND (f.active = 0 OR f.active <= s.t_ms) AS started
    FROM f JOIN s ON s.worker_id = f.worker_id AND s.i = f.i + 1))
SELECT worker_id, verdict_id, score, ban_started, on_probation FROM f WHERE i > 0""")
def stream_reputation(spark, sf):
    from fleetlens.plans.queries_state import TEST_REPUTATION
    v = B.as_verdicts(_stream_events(spark, sf, whole=True), "ts")
    got = on_time(run_now(spark, S.stream_reputation(v, TEST_REPUTATION, "ts"), "append"))
    return got.select("worker_id", "verdict_id", "score", "ban_started", "on_probation")


@query("stream_correction", ["ev"], """
WITH RECURSIVE a AS (SELECT worker_id, event_id, least(greatest(duration_ms / predicted_ms, 0.1), 1000.0) AS r,
    row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS i FROM ev WHERE event = 'accept'),
 f AS (SELECT worker_id, i, event_id, 0.7::DOUBLE * 1.0 + 0.3::DOUBLE * r AS c FROM a WHERE i = 1
  UNION ALL SELECT a.worker_id, a.i, a.event_id, 0.7::DOUBLE * f.c + 0.3::DOUBLE * a.r FROM f JOIN a ON a.worker_id = f.worker_id AND a.i = f.i + 1)
SELECT worker_id, event_id, c AS correction_after FROM f""")
def stream_correction(spark, sf):
    c = _stream_events(spark, sf, whole=True).where("event IS NULL OR event = 'accept'").select(
        "worker_id", "t_ms", "event_id", "predicted_ms", F.col("duration_ms").alias("actual_ms"), "ts")
    got = run_now(spark, S.stream_correction(c, event_time="ts"), "append")
    return on_time(got).select("worker_id", "event_id", "correction_after")


@query("stream_partial", ["ev"], """
SELECT task_id, sequence, arrival, units_done FROM (SELECT task_id, k AS sequence, event_id AS arrival, unit_count AS units_done,
  row_number() OVER (PARTITION BY task_id ORDER BY k DESC, event_id) AS r FROM ev) WHERE r = 1""")
def stream_partial(spark, sf):
    p = _stream_events(spark, sf).select("task_id", F.col("k").alias("sequence"), F.col("event_id").alias("arrival"),
                                         F.col("unit_count").alias("units_done"))
    return run_now(spark, S.stream_partial(p), "update", ["task_id"])


TIMELINE = """
SELECT t_ms // {w} * {w} AS window_ms, count(*) FILTER (event = 'grant') AS grants, count(*) FILTER (event = 'accept') AS done,
  count(*) FILTER (event = 'expire') AS expired, count(*) FILTER (event = 'cancel') AS cancelled,
  count(*) FILTER (event = 'worker_join') AS joined, count(*) FILTER (event = 'worker_lost') AS lost,
  CAST(coalesce(sum(unit_count) FILTER (event = 'accept'), 0) AS BIGINT) AS units_done,
  coalesce(max(duration_ms) FILTER (event = 'accept'), 0) AS slowest_ms FROM ev GROUP BY 1"""


@query("timeline", ["ev"], TIMELINE.format(w=1000))
def timeline(spark, sf):
    return L.timeline(B.event_log(spark, sf))


@query("stream_timeline", ["ev"], f"""
SELECT * FROM ({TIMELINE.format(w=3600000)}) WHERE window_ms + 3600000 <= (SELECT max(t_ms) - 600000 FROM ev)""")
def stream_timeline(spark, sf):
    return run_now(spark, S.stream_timeline(_stream_events(spark, sf), "1 hour"), "append")


@query("stall", ["ev"], """
WITH s AS (SELECT t_ms, event_id, event <> 'grant' AS stalled,
    sum(CASE WHEN event = 'grant' THEN 1 ELSE 0 END) OVER (ORDER BY t_ms, event_id) AS island FROM ev),
 n AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY t_ms, event_id) AS nth, count(*) OVER (PARTITION BY island) AS sweeps FROM s WHERE stalled)
SELECT n.t_ms AS onset, coalesce(h.t_ms, -1) AS cleared, sweeps FROM n LEFT JOIN (SELECT * FROM s WHERE NOT stalled) h ON h.island = n.island + 1
WHERE sweeps >= 20 AND nth = 20""")
def stall(spark, sf):
    # Every log line is a sweep; it shows a lease when it is a grant.
    s = B.event_log(spark, sf).select("t_ms", "event_id", F.lit(1).alias("workers"), F.lit(1).alias("outstanding"),
                                      (F.col("event") == "grant").cast("long").alias("leased"))
    return L.stalls(s, ["t_ms", "event_id"])


@query("stream_stall", ["ev"], """
WITH s AS (SELECT worker_id, t_ms, event_id, event <> 'grant' AS stalled,
    sum(CASE WHEN event = 'grant' THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS island FROM ev)
SELECT worker_id, t_ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY worker_id, island ORDER BY t_ms, event_id) AS nth FROM s WHERE stalled)
WHERE nth = 10""")
def stream_stall(spark, sf):
    s = _stream_events(spark, sf).select("worker_id", "t_ms", "event_id", F.lit(1).alias("workers"), F.lit(1).alias("outstanding"),
                                         (F.col("event") == "grant").cast("long").alias("leased"))
    got = run_now(spark, S.stream_stall(s, ["worker_id"], ["t_ms", "event_id"], 10), "append")
    return got.where("stall = 'onset'").select("worker_id", "t_ms", "event_id")


@query("offender_tiers", ["ev"], """
SELECT *, CASE WHEN bad_count >= 64 THEN 'disconnect' WHEN bad_count >= 16 THEN 'no_work' ELSE 'ok' END AS tier FROM (
SELECT worker_id, event_id, t_ms, CAST(sum(CASE WHEN event IN ('expire', 'cancel') THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS BIGINT) AS bad_count FROM ev)""")
def offender_tiers(spark, sf):
    ev = B.event_log(spark, sf).select("worker_id", "event_id", "t_ms", "event")
    return L.offender_tiers(ev, ["worker_id"], ["t_ms", "event_id"], F.col("event").isin("expire", "cancel")).drop("event")


@query("stream_offenders", ["ev"], """
SELECT *, CASE WHEN bad_count >= 64 THEN 'disconnect' WHEN bad_count >= 16 THEN 'no_work' ELSE 'ok' END AS tier FROM (
SELECT worker_id, count(*) FILTER (event IN ('expire', 'cancel')) AS bad_count FROM ev GROUP BY worker_id)""")
def stream_offenders(spark, sf):
    s = S.stream_offenders(_stream_events(spark, sf), ["worker_id"], F.col("event").isin("expire", "cancel"))
    return run_now(spark, s, "update", ["worker_id"])


@query("window_cap", ["ev"], """
SELECT event_id, worker_id, t_ms // 86400000 * 86400000000 AS window_us,
  row_number() OVER (PARTITION BY worker_id, t_ms // 86400000 ORDER BY t_ms, event_id) AS nth,
  row_number() OVER (PARTITION BY worker_id, t_ms // 86400000 ORDER BY t_ms, event_id) > 3 AS refused FROM ev""")
def window_cap(spark, sf):
    ev = B.event_log(spark, sf).select("event_id", "worker_id", "t_ms", "ts")
    return L.window_cap(ev, ["worker_id"], ["t_ms", "event_id"], "1 day", 3).drop("ts", "t_ms")


@query("stream_window_cap", ["ev"], """
SELECT worker_id, t_ms // 86400000 * 86400000000 AS window_us, count(*) AS sent, greatest(count(*) - 3, 0) AS refused FROM ev
WHERE t_ms // 86400000 < (SELECT max(t_ms) // 86400000 FROM ev) GROUP BY ALL""")
def stream_window_cap(spark, sf):
    s = S.stream_window_cap(_stream_events(spark, sf), ["worker_id"], "1 day", 3)
    return run_now(spark, s, "append")


@query("stream_upsert", ["ev"], """
SELECT worker_id, max(t_ms) AS last_seen_ms, count(*) AS events FROM ev GROUP BY worker_id""")
def stream_upsert(spark, sf):
    s = _stream_events(spark, sf).groupBy("worker_id").agg(F.max("t_ms").alias("last_seen_ms"), F.count(F.lit(1)).alias("events"))
    return run_now(spark, s, "update", ["worker_id"])
