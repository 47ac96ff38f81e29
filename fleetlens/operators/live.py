"""Batch twins of the live operators: lifecycle, leases, sessions, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import EVENTS, STATES, TRANSITIONS
from fleetlens.operators.ordered import StateMachine, is_hot, number_rows, running, scan

NO_WORK_AT = 16
DISCONNECT_AT = 64
SIGNAL_CAP = 64
STALL_SWEEPS = 20


def transition_table() -> list[list[int]]:
    return [[STATES.index(TRANSITIONS[s, e]) if (s, e) in TRANSITIONS else -1 for e in EVENTS] for s in STATES]


def code_of(c: Column, names: list[str]) -> Column:
    """Position in a fixed list, -1 for anything else."""
    return (F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), c), F.lit(0)) - 1).cast("int")


def name_of(c: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))


def lifecycle(events: DataFrame, order: list[str]) -> DataFrame:
    """State after each task event and whether the event was legal. ``events``:
    task_id, task_event and the order columns; an illegal event changes nothing."""
    coded = events.select("task_id", *order, "task_event", code_of(F.col("task_event"), EVENTS).alias("code"))
    got = scan(coded, ["task_id"], order, ["code"], StateMachine("code", transition_table()))
    return got.withColumn("state", name_of(F.col("state_code"), STATES)).drop("code", "state_code")


def lifecycle_totals(history: DataFrame, order: list[str]) -> DataFrame:
    return history.groupBy("task_id").agg(
        F.max_by("state", F.struct(*order)).alias("state"), F.count_if("legal").alias("applied"),
        F.count_if(~F.col("legal")).alias("illegal"))


def lease_expiries(events: DataFrame, lease_ms: int, now_ms: int, ends=("accept", "cancel"),
                   starts=("grant",)) -> DataFrame:
    """Grants whose deadline passed before the task's next event. The next
    event is the previous one in descending order. Deadlines up to ``now_ms``."""
    kinds = [*starts, *ends]
    ev = events.where(F.col("event").isin(*kinds)).select("task_id", "t_ms", "event_id", "event", "worker_id", "unit_count")
    nxt = running(ev, ["task_id"], ["-t_ms", "-event_id"], {"next_ms": ("last", F.col("t_ms"))}, inclusive=False)
    deadline = F.col("t_ms") + F.lit(lease_ms)
    fired = (F.col("next_ms").isNull() & (deadline <= F.lit(now_ms))) | (F.col("next_ms") >= deadline)
    return nxt.where(F.col("event").isin(*starts) & fired).select(
        "task_id", "worker_id", "unit_count", F.col("t_ms").alias("granted_at_ms"), deadline.alias("expired_at_ms"))


def renewed_leases(events: DataFrame, lease_ms: int, now_ms: int) -> DataFrame:
    """Leases that ran out by ``now_ms``, where renewals by the holder move the deadline.

    ``events`` (task_id, t_ms, event_id, event, worker_id, unit_count) with the events grant, renew, accept and cancel; all
    but a renewal end the lease before. A lease runs out at the first of its grant and renewals that the next one follows
    no sooner than ``lease_ms`` later, unless it was ended before that."""
    ev = events.where(F.col("event").isin("grant", "renew", "accept", "cancel")).select(
        "task_id", "t_ms", "event_id", "event", "worker_id", "unit_count")
    settles = F.when(F.col("event") != "renew", F.struct("event_id", "event", "worker_id", "unit_count", "t_ms"))
    ev = running(ev, ["task_id"], ["t_ms", "event_id"], {"lease": ("last", settles)})
    ev = running(ev, ["task_id"], ["-t_ms", "-event_id"], {"ended_ms": ("last", F.when(F.col("event") != "renew", F.col("t_ms")))},
                 inclusive=False)
    own = ev.where((F.col("lease.event") == "grant") & ((F.col("event") == "grant") | (F.col("worker_id") == F.col("lease.worker_id"))))
    own = own.withColumn("lease_id", F.col("lease.event_id"))
    key = ["task_id", "lease_id"]
    own = running(own, key, ["-t_ms", "-event_id"], {"next_ms": ("last", F.col("t_ms"))}, inclusive=False)
    own = running(own, key, ["t_ms", "event_id"], {"nth": ("count", F.lit(1))})
    quiet = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("t_ms") >= lease_ms)
    first = own.groupBy(*key).agg(F.min_by(F.struct("*"), F.when(quiet, F.col("nth"))).alias("r")).select("r.*")
    deadline = F.col("t_ms") + F.lit(lease_ms)
    out = (F.col("ended_ms").isNull() & (deadline <= now_ms)) | (F.col("ended_ms") >= deadline)
    return first.where(out).select(
        "task_id", F.col("lease.worker_id").alias("worker_id"), F.col("lease.unit_count").alias("unit_count"),
        F.col("lease.t_ms").alias("granted_at_ms"), (F.col("nth") - 1).alias("renewals"), deadline.alias("expired_at_ms"))


def released_work(events: DataFrame, timeout_ms: int) -> DataFrame:
    """Tasks that a worker held when it was lost: (worker_id, task_id, granted_at_ms, lost_at_ms).

    ``events`` (worker_id, t_ms, event_id, event, task_id). A worker is lost ``timeout_ms`` after the last event before a
    silence of that length, or before the end. It holds a task from the grant until it is accepted, cancelled or expired."""
    order = ["-t_ms", "-event_id"]
    ev = events.select("worker_id", "task_id", "t_ms", "event_id", "event")
    ev = running(ev, ["worker_id"], order, {"next_ms": ("last", F.col("t_ms"))}, inclusive=False)
    quiet = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("t_ms") >= timeout_ms)
    ev = running(ev, ["worker_id"], order, {"lost_at_ms": ("last", F.when(quiet, F.col("t_ms") + timeout_ms))})
    own = ev.where(F.col("event").isin("grant", "accept", "cancel", "expire"))
    own = running(own, ["worker_id", "task_id"], order, {"then_ms": ("last", F.col("t_ms"))}, inclusive=False)
    held = F.col("then_ms").isNull() | (F.col("then_ms") >= F.col("lost_at_ms"))
    return own.where((F.col("event") == "grant") & held).select(
        "worker_id", "task_id", F.col("t_ms").alias("granted_at_ms"), "lost_at_ms")


def worker_sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Spells of activity per worker; silence of ``gap_us`` ends one and the
    worker counts as lost. Columns: worker_id, ts, event_id."""
    keys, order = ["worker_id"], ["us", "event_id"]
    e = events.select("worker_id", F.unix_micros("ts").alias("us"), "event_id")
    hot = is_hot(e, keys)
    e = running(e, keys, order, {"prev": ("last", F.col("us"))}, inclusive=False, hot=hot)
    fresh = F.coalesce(F.col("us") - F.col("prev") >= F.lit(gap_us), F.lit(True)).cast("long")
    e = running(e, keys, order, {"spell": ("sum", fresh)}, hot=hot)
    return e.groupBy("worker_id", "spell").agg(
        F.min("us").alias("start_us"), (F.max("us") + F.lit(gap_us)).alias("end_us"),
        F.count(F.lit(1)).alias("events")).drop("spell")


def first_result(results: DataFrame, order: list[str]) -> DataFrame:
    """The earliest result per task; one aggregation with map-side combine."""
    rest = [c for c in results.columns if c != "task_id"]
    return results.groupBy("task_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("task_id", "r.*")


def timeline(events: DataFrame, width: str = "1 second") -> DataFrame:
    """Counts per tumbling window; the same expression serves a stream."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(
        *[F.count_if(F.col("event") == e).alias(n) for e, n in (
            ("grant", "grants"), ("accept", "done"), ("expire", "expired"), ("cancel", "cancelled"),
            ("worker_join", "joined"), ("worker_lost", "lost"))],
        F.coalesce(F.sum(F.when(F.col("event") == "accept", F.col("unit_count"))), F.lit(0)).alias("units_done"),
        F.coalesce(F.max(F.when(F.col("event") == "accept", F.col("duration_ms"))), F.lit(0.0)).alias("slowest_ms"),
    ).select((F.unix_micros("w.start") / 1000).cast("long").alias("window_ms"),
             "grants", "done", "expired", "cancelled", "joined", "lost", "units_done", "slowest_ms")


def stalls(sweeps: DataFrame, order: list[str], keys: list[str] | None = None,
           at: int = STALL_SWEEPS) -> DataFrame:
    """Runs of at least ``at`` sweeps with workers and outstanding work but
    nothing leased: the sweep that raised it, the one that cleared it (-1 while
    it lasts) and the length. Columns: workers, outstanding, leased."""
    keys = keys or []
    flag = (F.col("workers") > 0) & (F.col("outstanding") > 0) & (F.col("leased") == 0)
    s = sweeps.withColumn("stalled", flag)
    # An island is the stretch since the last healthy sweep.
    hot = is_hot(sweeps, keys)
    s = running(s, keys, order, {"island": ("sum", (~F.col("stalled")).cast("long"))}, hot=hot)
    runs = (s.where("stalled").groupBy(*keys, "island")
            .agg(F.count(F.lit(1)).alias("sweeps"), F.min(F.struct(*order)).alias("first"))
            .where(F.col("sweeps") >= at))
    numbered = number_rows(s.where("stalled").join(runs.select(*keys, "island"), [*keys, "island"], "left_semi"),
                           [*keys, "island"], order, "nth", hot=hot)
    onset = numbered.where(F.col("nth") == at).select(*keys, "island", F.col(order[0]).alias("onset"))
    healthy = s.where(~F.col("stalled")).select(*keys, (F.col("island") - 1).alias("island"), F.col(order[0]).alias("cleared"))
    on = [*keys, "island"]
    return (runs.select(*on, "sweeps").join(onset, on).join(healthy, on, "left")
            .select(*keys, "onset", F.coalesce("cleared", F.lit(-1)).alias("cleared"), "sweeps"))


def offender_tiers(records: DataFrame, keys: list[str], order: list[str], bad: Column,
                   no_work: int = NO_WORK_AT, disconnect: int = DISCONNECT_AT) -> DataFrame:
    """Running count of bad records per connection and the tier it puts it in.
    ``keys`` names one connection, so a reconnect starts from zero."""
    r = running(records, keys, order, {"bad_count": ("sum", bad.cast("long"))})
    return r.withColumn("tier", F.when(F.col("bad_count") >= disconnect, "disconnect")
                        .when(F.col("bad_count") >= no_work, "no_work").otherwise("ok"))


def window_cap(messages: DataFrame, keys: list[str], order: list[str], width: str, cap: int = SIGNAL_CAP) -> DataFrame:
    """Messages with their number within the sender's window; beyond ``cap`` refused."""
    m = messages.withColumn("window_us", F.unix_micros(F.window("ts", width)["start"]))
    n = number_rows(m, [*keys, "window_us"], order, "nth")
    return n.withColumn("refused", F.col("nth") > cap)
