"""Structured Streaming operators.

Where a live rule only needs the best or the sum of what was seen, it is a
streaming aggregation: partial results combine before the shuffle and a hot key
costs one row per task. Rules that depend on the order of a key's rows use
``applyInPandasWithState`` with the folds of ``operators.ordered``. With an
``event_time`` a key's rows wait for the watermark and are folded in its order,
late ones come out marked (``streaming.keyed``). Without, a key's new rows of one
trigger are sorted together, so bound a trigger at the source
(``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.functions.exprs import EVENTS, MAX_CORRECTION, MIN_CORRECTION, STATES
from fleetlens.operators import live
from fleetlens.operators.ordered import Ewma, Scan, StateMachine
from fleetlens.operators.reputation import ReputationConfig
from fleetlens.sources.state import compact
from fleetlens.streaming import keyed

WATERMARK = "10 minutes"
#: How long a key that has ended is remembered.
RETAIN_MS = 60 * 86_400_000


def scan_stream(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold: Scan,
                event_time: str | None = None, watermark: str = WATERMARK, buckets: int | None = None) -> DataFrame:
    """The streaming form of :func:`operators.ordered.scan`: each row with the
    fold's outputs, state carried across triggers. ``buckets``: see :func:`keyed.in_order`."""
    if event_time:
        keep = [c for c in df.columns if c not in (*keys, event_time, "t_ms")]
        rule = keyed.Folded(fold, df.schema, inputs, keep)
        return keyed.in_order(df, keys, order, rule, event_time, watermark, RETAIN_MS, buckets)
    fields = df.schema.fields + T._parse_datatype_string(
        ", ".join(f"{n} {t}" for n, t in fold.outputs.items())).fields
    state_schema = T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))])

    def handle(key, batches, state: GroupState):
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        start = [float(v) for v in state.get[0]] if state.exists else fold.start()
        outs, end = fold.step(start, {c: pdf[c].to_numpy() for c in inputs})
        state.update(([float(v) for v in end],))
        yield pdf.assign(**outs)[[f.name for f in fields]]

    return df.groupBy(*keys).applyInPandasWithState(
        handle, T.StructType(fields), state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_lifecycle(events: DataFrame, order: list[str], event_time: str | None = None, watermark: str = WATERMARK,
                     buckets: int | None = None) -> DataFrame:
    coded = events.select("task_id", *order, *([event_time] if event_time else []), "task_event",
                          live.code_of(F.col("task_event"), EVENTS).alias("code"))
    got = scan_stream(coded, ["task_id"], order, ["code"], StateMachine("code", live.transition_table()), event_time, watermark, buckets)
    return got.withColumn("state", live.name_of(F.col("state_code"), STATES)).drop("code", "state_code")


class Standing(Scan):
    """Reputation with bans and probation: alpha, beta, end of the ban, probation."""

    outputs = {"alpha": "double", "beta": "double", "score": "double",
               "ban_started": "boolean", "banned_until": "long", "on_probation": "boolean"}

    def __init__(self, cfg: ReputationConfig):
        self.cfg = cfg

    def start(self):
        # alpha, beta, end of the running ban (0: none), probation, end of the last ban
        return [self.cfg.alpha0, self.cfg.beta0, 0.0, 0.0, 0.0]

    def step(self, state, cols):
        cfg = self.cfg
        alpha, beta, until, probation, last = state
        acc, sev = cols["accepted"].astype(bool), cols["severity"].astype(float)
        spot, t = cols["spot"].astype(bool), cols["t_ms"].astype(float)
        n = len(acc)
        pen = np.where(acc, 0.0, np.clip(np.where(spot, 2 * sev, sev), 0.0, cfg.max_penalty))
        a, b = alpha + np.cumsum(acc), beta + np.cumsum(pen)
        score = a / (a + b)
        started, ends, prob = np.zeros(n, dtype=bool), np.empty(n), np.zeros(n, dtype=bool)
        for i in range(n):
            if until and until <= t[i]:
                until, probation = 0.0, 1.0
            if acc[i]:
                if probation and score[i] >= cfg.trusted_at:
                    probation = 0.0
            elif not until and score[i] < cfg.blacklist_below:
                started[i] = True
                until = last = t[i] + cfg.cooldown_ms
            ends[i], prob[i] = last, bool(probation)
        outs = {"alpha": a, "beta": b, "score": score, "ban_started": started,
                "banned_until": ends.astype(np.int64), "on_probation": prob}
        return outs, [float(a[-1]), float(b[-1]), until, probation, last]


def stream_reputation(verdicts: DataFrame, cfg: ReputationConfig = ReputationConfig(), event_time: str | None = None) -> DataFrame:
    return scan_stream(verdicts, ["worker_id"], ["t_ms", "verdict_id"],
                       ["accepted", "severity", "spot", "t_ms"], Standing(cfg), event_time)


def stream_correction(completions: DataFrame, alpha: float = 0.3, event_time: str | None = None) -> DataFrame:
    """Columns: worker_id, t_ms, event_id, predicted_ms, actual_ms."""
    fold = Ewma("predicted_ms", "actual_ms", alpha, MIN_CORRECTION, MAX_CORRECTION)
    return scan_stream(completions, ["worker_id"], ["t_ms", "event_id"], ["predicted_ms", "actual_ms"], fold, event_time)


def stream_leases(events: DataFrame, lease_ms: int, event_time: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Leases that ran out, with renewals: the streaming form of :func:`operators.live.renewed_leases`."""
    return keyed.in_order(events, ["task_id"], ["event_id"], keyed.Lease(lease_ms), event_time, watermark)


def stream_released(events: DataFrame, timeout_ms: int, event_time: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Tasks that lost workers give back: the streaming form of :func:`operators.live.released_work`."""
    return keyed.in_order(events, ["worker_id"], ["event_id"], keyed.HeldWork(timeout_ms), event_time, watermark)


EXPIRY_SCHEMA = "task_id long, worker_id long, unit_count long, granted_at_ms long, expired_at_ms long"


def stream_expiry(events: DataFrame, lease_ms: int, watermark: str = WATERMARK) -> DataFrame:
    """Expired leases. A grant sets the deadline, any later event of the task
    settles it; an event-time timer fires for tasks that fall silent."""
    ev = (events.where(F.col("event").isin("grant", "accept", "cancel"))
          .select("task_id", "t_ms", "event_id", "event", "worker_id", "unit_count", "ts").withWatermark("ts", watermark))
    state_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("worker_id", "unit_count", "granted", "deadline")])
    names = [f.name for f in T._parse_datatype_string(EXPIRY_SCHEMA).fields]

    def handle(key, batches, state: GroupState):
        out = []
        lease = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if lease:
                out.append((key[0], lease[0], lease[1], lease[2], lease[3]))
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values(["t_ms", "event_id"], kind="stable")
            for t, kind, w, u in zip(pdf["t_ms"], pdf["event"], pdf["worker_id"], pdf["unit_count"]):
                if lease and t >= lease[3]:
                    out.append((key[0], *lease))
                lease = (int(w), int(u), int(t), int(t) + lease_ms) if kind == "grant" else None
            if lease:
                state.update(lease)
                mark = state.getCurrentWatermarkMs()
                state.setTimeoutTimestamp(max(lease[3], mark + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=names)

    return ev.groupBy("task_id").applyInPandasWithState(
        handle, EXPIRY_SCHEMA, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stream_lost(events: DataFrame, timeout: str = "45 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Spells of activity; one is emitted when the watermark passes its end, at
    which point the worker is lost. Sessions of a key merge on the map side
    (``session.tune``)."""
    s = (events.withWatermark("ts", watermark)
         .groupBy("worker_id", F.session_window("ts", timeout).alias("s")).agg(F.count(F.lit(1)).alias("events")))
    return s.select("worker_id", F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"),
                    "events")


def stream_first_result(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return results.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["task_id"])


def stream_partial(partials: DataFrame) -> DataFrame:
    """Newest partial per task, as an aggregation in update mode. Partials of
    other workers than the lease holder are filtered before
    (``quorum.held_partials``): they may not move the sequence."""
    rest = [c for c in partials.columns if c not in ("task_id", "sequence", "arrival")]
    best = partials.groupBy("task_id").agg(
        F.max_by(F.struct("sequence", "arrival", *rest), F.struct("sequence", -F.col("arrival"))).alias("p"))
    return best.select("task_id", "p.*")


def stream_timeline(events: DataFrame, width: str = "1 second", watermark: str = WATERMARK) -> DataFrame:
    return live.timeline(events.withWatermark("ts", watermark), width)


class StallCounter(Scan):
    outputs = {"streak": "long", "stall": "string"}

    def __init__(self, at: int):
        self.limit = at

    def start(self):
        return [0.0]

    def step(self, state, cols):
        streak, marks, counts = int(state[0]), [], []
        for w, o, held in zip(cols["workers"], cols["outstanding"], cols["leased"]):
            if w > 0 and o > 0 and held == 0:
                streak += 1
                marks.append("onset" if streak == self.limit else "")
            else:
                marks.append("cleared" if streak >= self.limit else "")
                streak = 0
            counts.append(streak)
        return {"streak": np.array(counts), "stall": np.array(marks, dtype=object)}, [float(streak)]


def stream_stall(sweeps: DataFrame, keys: list[str], order: list[str], at: int = live.STALL_SWEEPS) -> DataFrame:
    """One row per sweep and coordinator (``keys``) with onset and clear marks."""
    return scan_stream(sweeps, keys, order, ["workers", "outstanding", "leased"], StallCounter(at))


def stream_offenders(records: DataFrame, keys: list[str], bad, no_work: int = live.NO_WORK_AT,
                     disconnect: int = live.DISCONNECT_AT) -> DataFrame:
    """Bad records per connection and the tier reached, as an aggregation."""
    g = records.groupBy(*keys).agg(F.count_if(bad).alias("bad_count"))
    return g.withColumn("tier", F.when(F.col("bad_count") >= disconnect, "disconnect")
                        .when(F.col("bad_count") >= no_work, "no_work").otherwise("ok"))


def stream_window_cap(messages: DataFrame, keys: list[str], width: str, cap: int = live.SIGNAL_CAP,
                      watermark: str = WATERMARK) -> DataFrame:
    """Messages and refusals per sender and window."""
    g = messages.withWatermark("ts", watermark).groupBy(*keys, F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("sent"))
    return g.select(*keys, F.unix_micros("w.start").alias("window_us"), "sent",
                    F.greatest(F.col("sent") - cap, F.lit(0)).alias("refused"))


def stream_upsert(df: DataFrame, path: str, mode: str = "update"):
    """Writer that lands each trigger's rows under its batch number. A replayed
    batch overwrites its own folder, so it is idempotent; a failed one leaves
    the rows to the next attempt. Set trigger and checkpoint, then start."""
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return df.writeStream.outputMode(mode).foreachBatch(land)


def read_upserted(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Landed rows; with ``keys`` the latest row per key (changelog compaction)."""
    rows = spark.read.parquet(path)
    if keys is None:
        return rows.drop("batch_id")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return compact(rows, keys, "batch_id", rest)
