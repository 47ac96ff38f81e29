"""Keyed streams whose rows are handled in event-time order, whatever order triggers bring them in.

A key's rows wait in its state until the watermark has passed them and are then handled in order, with the timers between
them at their own places. A row that comes when the watermark has passed its time is *late*: it changes nothing and comes
out marked, for a table of its own. Results therefore depend on the rows and on which of them were late, never on how
the rest was dealt to triggers, and a replayed trigger repeats its output.

State of a key is bounded by its rows within the watermark's delay plus the rule's own state. Timers are event-time
timers that Spark keeps with the state, so after a restart they fire once, at the same place.
"""

from __future__ import annotations

import pickle
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.operators.ordered import Scan

#: Columns that every result has besides its rule's: whether the row was late, and its time.
MARKS = "late boolean, t_ms long"
FAR_MS = 4_102_444_800_000  # 2100-01-01
#: Rows that a stream with keyed state exchanges with Python at a time.
BATCH_ROWS = 500


class Rule:
    """What happens to one key. ``rows`` handles consecutive rows and returns the new state and output tuples.

    States are plain Python values. With ``timed``, rows come one by one and ``deadline`` names the time at which
    ``fire`` is to be called unless a row before it moves it; a row at that very time comes after it.
    """

    inputs: list[str] = []
    outputs = ""
    timed = False

    def start(self):
        return None

    def rows(self, state, rows: list[tuple]):
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        return None

    def fire(self, state):
        raise NotImplementedError

    def ended(self, state) -> bool:
        """Whether the key needs no more state once the retention is over."""
        return False


class Folded(Rule):
    """A fold of ``operators.ordered`` as a rule; every row comes out with the order and input columns and the fold's."""

    def __init__(self, fold: Scan, schema: T.StructType, inputs: list[str], keep: list[str], ended=lambda state: False):
        self.fold, self.inputs, self.used, self.done = fold, list(dict.fromkeys([*keep, *inputs])), inputs, ended
        # The time comes out among the marks.
        self.shown = [i for i, c in enumerate(self.inputs) if c != "t_ms"]
        self.outputs = ", ".join([f"`{self.inputs[i]}` {schema[self.inputs[i]].dataType.simpleString()}" for i in self.shown]
                                 + [f"{n} {t}" for n, t in fold.outputs.items()])

    def start(self):
        return [float(v) for v in self.fold.start()]

    def rows(self, state, rows):
        cols = {c: np.array(v) for c, v in zip(self.inputs, zip(*rows, strict=True), strict=True) if c in self.used}
        outs, state = self.fold.step(state, cols)
        made = zip(*[np.asarray(outs[n]).tolist() for n in self.fold.outputs], strict=True)
        return [float(v) for v in state], [(*[row[i] for i in self.shown], *new) for row, new in zip(rows, made, strict=True)]

    def ended(self, state):
        return self.done(state)


class Lease(Rule):
    """Leases of a task: (worker_id, unit_count, granted_at_ms, renewals, expired_at_ms) of each that ran out.

    A grant starts a lease. A renewal by its holder moves the one deadline; by anyone else, or without a lease, it does
    nothing. Acceptance and cancellation end the lease. It is valid strictly before the deadline.
    """

    timed = True
    inputs = ["__t", "event", "worker_id", "unit_count"]
    outputs = "worker_id long, unit_count long, granted_at_ms long, renewals long, expired_at_ms long"

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def rows(self, state, rows):
        for t, event, worker, units in rows:
            if event == "grant":
                state = (worker, units, t, 0, t + self.lease_ms)
            elif event in ("accept", "cancel"):
                state = None
            elif event == "renew" and state and state[0] == worker:
                state = (*state[:3], state[3] + 1, t + self.lease_ms)
        return state, []

    def deadline(self, state):
        return state[4] if state else None

    def fire(self, state):
        return None, [state]

    def ended(self, state):
        return state is None


class HeldWork(Rule):
    """Tasks that a worker gives back by falling silent: (task_id, granted_at_ms, lost_at_ms).

    Any event of the worker shows that it is alive; after ``timeout_ms`` without one it is lost and every task it holds
    goes back. Grants are held until accepted, cancelled or expired.
    """

    timed = True
    inputs = ["__t", "event", "task_id"]
    outputs = "task_id long, granted_at_ms long, lost_at_ms long"

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def rows(self, state, rows):
        _, held = state or (0, {})
        for t, event, task in rows:
            if event == "grant":
                held = {**held, task: t}
            elif event in ("accept", "cancel", "expire"):
                held = {k: v for k, v in held.items() if k != task}
            state = (t + self.timeout_ms, held)
        return state, []

    def deadline(self, state):
        return state[0] if state else None

    def fire(self, state):
        lost, held = state
        return None, [(task, granted, lost) for task, granted in sorted(held.items())]

    def ended(self, state):
        return state is None


def in_order(df: DataFrame, keys: list[str], order: list[str], rule: Rule, event_time: str = "ts",
             watermark: str = "10 minutes", retain_ms: int = 0, buckets: int | None = None) -> DataFrame:
    """``keys``, the rule's outputs and ``MARKS`` for a stream with the timestamp ``event_time``.

    Rows of a key are handled by (event time, ``order``). Late rows have ``late`` set, their time in ``t_ms`` and no
    outputs. A key whose rule has ended is forgotten ``retain_ms`` after its last row; a row after that starts it anew.

    Rows from ``FAR_MS`` on only move the watermark.

    Spark drops rows behind the watermark before a stateful operator sees them. So each row goes on twice: one copy
    carries its time and moves the watermark, and goes no further; the other has no event time of Spark's, is never dropped,
    and is judged here.

    Spark's Python side hands back the states of keys only together with output rows, so a key without any gives one row of
    nulls, which is dropped here: a worker then holds the states of as many keys as a batch has rows (``short_batches``), not
    those of its whole partition.

    A call to Python costs far more than a row in it. With ``buckets`` keys are dealt over that many groups by their hash, a
    group's keys are handled in one call and their states are one value: for triggers that touch most keys, as each rewrites
    the states of the groups that it touches. The number belongs to the stream's checkpoint.
    """
    t = F.unix_millis(F.col(event_time).cast("timestamp"))
    cols = list(dict.fromkeys([*order, *[c for c in rule.inputs if c != "__t"]]))
    rows = df.select(*keys, t.alias("__t"), *[c for c in cols if c not in keys], F.col(event_time).cast("timestamp").alias("__ts"),
                     F.explode(F.array(F.lit(True), F.lit(False))).alias("__live"))
    rows = rows.where(F.col("__t").isNotNull() & ((F.col("__t") < FAR_MS) | ~F.col("__live")))
    # The copies that moved the watermark are dropped by a condition on the mark, which cannot go before it.
    rows = (rows.withColumn("__mark", F.when(~F.col("__live"), F.col("__ts"))).drop("__ts", "__live")
            .withWatermark("__mark", watermark).where(F.col("__mark").isNull()))
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(f"{rule.outputs}, {MARKS}").fields)
    names = [f.name for f in schema]
    blank = [None] * (len(names) - len(keys) - 2)

    def arrivals(batches, given):
        """Key, place and inputs of every row. ``given`` names keys that are the same for all."""
        for pdf in batches:
            def column(c, pdf=pdf):
                return given[c] * len(pdf) if c in given else pdf[c].tolist()
            yield from zip(zip(*[column(k) for k in keys], strict=True), zip(*[column(c) for c in ["__t", *order]], strict=True),
                           zip(*[column(c) for c in rule.inputs], strict=True), strict=True)

    def advance(key, held, new, now, out):
        """State of a key, or None once it is forgotten, and when it is to be called without rows."""
        own, waiting, last = held or (rule.start(), [], 0)
        for p, b in new:
            if p[0] <= now:
                out.append((*key, *blank, True, p[0]))
            else:
                waiting.append((p, b))
        waiting.sort(key=lambda r: r[0])
        n = sum(p[0] <= now for p, _ in waiting)
        ready, waiting = waiting[:n], waiting[n:]
        if ready:
            last = ready[-1][0][0]

        def keep(made, at):
            out.extend((*key, *o, False, at) for o in made)

        def fire(until):
            nonlocal own
            while (due := rule.deadline(own)) is not None and due <= until:
                own, made = rule.fire(own)
                keep(made, due)

        if rule.timed:
            for p, b in ready:
                fire(p[0])
                own, made = rule.rows(own, [b])
                keep(made, p[0])
            fire(now)
        elif ready:
            own, made = rule.rows(own, [b for _, b in ready])
            out.extend((*key, *o, False, p[0]) for (p, _), o in zip(ready, made, strict=True))

        ended = rule.ended(own) and not waiting
        if ended and now >= last + retain_ms:
            return None, None
        due = [w[0][0] for w in waiting[:1]] + [d for d in [rule.deadline(own)] if d is not None] + ([last + retain_ms] if ended else [])
        return (own, waiting, last), max(min(due), now + 1) if due else None

    def put(state, held, due):
        if held:
            state.update((pickle.dumps(held),))
            if due is not None:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()

    def table(out):
        out = out or [(*[None] * len(keys), *blank, None, None)]
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    def handle(key, batches, state: GroupState):
        now, out = state.getCurrentWatermarkMs(), []
        new = [] if state.hasTimedOut else [row[1:] for row in arrivals(batches, {k: [v] for k, v in zip(keys, key, strict=True)})]
        put(state, *advance(key, pickle.loads(state.get[0]) if state.exists else None, new, now, out))
        yield table(out)

    def handle_bucket(bucket, batches, state: GroupState):
        now, out, new = state.getCurrentWatermarkMs(), [], {}
        held = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for key, *row in arrivals(batches, {k: [None] for k, null in zip(keys, bucket[1:], strict=True) if null}):
                new.setdefault(key, []).append(row)
        for key in [*new, *[k for k, (_, due) in held.items() if due is not None and due <= now and k not in new]]:
            found = advance(key, held.pop(key, (None, None))[0], new.get(key, []), now, out)
            if found[0]:
                held[key] = found
        put(state, held, min((due for _, due in held.values() if due is not None), default=None))
        yield table(out)

    by = keys
    if buckets is not None:
        # A column of a group is all null or not at all, so that whole numbers come to Python as such.
        rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = rows.select("*", *[F.col(k).isNull().alias(f"__null_{k}") for k in keys])
        by = ["__bucket", *[f"__null_{k}" for k in keys]]
    return rows.groupBy(*by).applyInPandasWithState(
        handle if buckets is None else handle_bucket, schema, T.StructType([T.StructField("s", T.BinaryType())]), "append",
        GroupStateTimeout.EventTimeTimeout).where(F.col("late").isNotNull())


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Streams started inside exchange at most so many rows at a time with Python, and so hold as many states there."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def end_of_stream(spark: SparkSession, path: str, like: DataFrame, event_time: str = "ts") -> DataFrame:
    """A stream of one row of nulls far in the future, to be united with a drained stream before its watermark, or to lie
    in the last of its files (``path`` is appended to).

    When a stream that ends is drained, the rows after the last watermark would wait for ever; this row moves it past them.
    """
    row = spark.range(1).select(*[(F.timestamp_millis(F.lit(FAR_MS)) if f.name == event_time else F.lit(None)).cast(f.dataType).alias(f.name)
                                  for f in like.schema])
    row.write.mode("append").parquet(path)
    return spark.readStream.schema(row.schema).parquet(path)
