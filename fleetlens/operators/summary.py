"""Summaries of event logs, tasks, workers and snapshots.

Sums of durations are taken in whole micro-units (the log carries three
decimals), so a total does not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import MAX_CORRECTION, MIN_CORRECTION, STATES, TERMINAL
from fleetlens.operators.ordered import (
    Ewma, expand, is_hot, lower_mid, nearest_ranks, number_rows, rank_of, running, scan, upper_mid, whole_div)


def milli(c) -> Column:
    """A 3-decimal measure as a whole number of thousandths."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1000).cast("long")


def is_event(name: str) -> Column:
    return F.col("event") == name


def run_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """One row per run; runs without a grant or an accept are left out.
    Percentiles are the element at min(n-1, int(q*n)) of the sorted durations.

    One pass: events are added up per run and duration (combined on the map side),
    and both the totals and the ranks come from those rows."""
    grant, accept, cancel = is_event("grant"), is_event("accept"), is_event("cancel")
    per = events.groupBy(*by, F.when(accept, F.col("duration_ms")).alias("duration_ms")).agg(
        F.count_if(accept).alias("tasks"),
        F.sum(F.when(accept, F.col("unit_count"))).alias("units"),
        F.min(F.when(grant, F.col("t_ms"))).alias("t0"),
        F.max(F.when(accept, F.col("t_ms"))).alias("t1"),
        F.count_if(is_event("expire")).alias("expiries"),
        F.count_if(cancel).alias("cancels"),
        F.count_if(grant & (F.col("speculative") != 0)).alias("speculative_grants"),
        F.sum(F.when(cancel, F.col("unit_count"))).alias("wasted_units"))
    cum = running(per, by, ["duration_ms"], {"__cum": ("sum", F.col("tasks")), "__size": ("total", F.col("tasks"))})
    rank = lambda fn: F.min(F.when(F.col("__cum") > fn(F.col("__size")), F.col("duration_ms")))
    q = cum.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tasks", "units", "expiries", "cancels", "speculative_grants")],
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("duration_ms").alias("max_ms"),
        F.coalesce(F.sum("wasted_units"), F.lit(0)).alias("wasted_units"),
        rank(lower_mid).alias("lo"), rank(upper_mid).alias("hi"), rank(rank_of(0.95)).alias("p95_ms"),
        rank(rank_of(0.99)).alias("p99_ms")).where("t0 is not null and t1 is not null")
    wall = F.greatest(F.lit(1).cast("long"), F.col("t1") - F.col("t0"))
    return q.select(
        *by, "tasks", "units", wall.alias("wall_ms"),
        (F.lit(1000.0) * F.col("units") / wall).alias("units_per_sec"),
        ((F.col("lo") + F.col("hi")) / 2).alias("p50_ms"), "p95_ms", "p99_ms", "max_ms",
        "expiries", "cancels", "speculative_grants", "wasted_units")


def state_counts(tasks: DataFrame) -> DataFrame:
    """Every state with its count, zero included: seven counters in one pass."""
    one = tasks.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("count"),
                              F.when(F.col("all") > 0, F.col(s) / F.col("all")).otherwise(F.lit(0.0)).alias("share"))
                     for s in STATES])
    return one.select(F.inline(rows))


def fleet_snapshot(tasks: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    t = tasks.agg(F.count(F.lit(1)).alias("total_tasks"), F.count_if(F.col("state") == "Queued").alias("queue_depth"),
                  F.coalesce(F.sum(F.when(F.col("state") == "Accepted", F.lit(1))), F.lit(0)).alias("tasks_done"))
    j = jobs.agg(F.coalesce(F.sum("total_units"), F.lit(0)).alias("units_total"),
                 F.coalesce(F.sum(F.col("total_units") - F.col("next_unit")), F.lit(0)).alias("units_remaining"))
    e = events.agg(F.count_distinct("worker_id").alias("workers"),
                   F.coalesce(F.sum(F.when(is_event("cancel"), F.col("unit_count"))), F.lit(0)).alias("wasted_units"))
    # Three one-row tables side by side.
    return t.join(F.broadcast(j)).join(F.broadcast(e)).withColumn(
        "progress_pct", F.when(F.col("units_total") > 0,
                               100.0 * (F.col("units_total") - F.col("units_remaining")) / F.col("units_total"))
        .otherwise(F.lit(0.0)))


def worker_throughput(events: DataFrame) -> DataFrame:
    per = events.where(is_event("accept")).groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("tasks_completed"), F.sum("unit_count").alias("units_completed"),
        (F.sum(milli("duration_ms")) / 1000.0).alias("observed_ms"))
    return per.withColumn("units_per_sec", F.when(
        F.col("observed_ms") > 0, F.lit(1000.0) * F.col("units_completed") / F.col("observed_ms")).otherwise(F.lit(0.0)))


def source_mix(fetches: DataFrame) -> DataFrame:
    """Counts by input source, and the locality hit rate over fresh grants that
    have an input. Columns: source, has_input, requeued, cached_hit."""
    graded = F.col("has_input") & ~F.col("requeued")
    one = fetches.agg(
        *[F.count_if(F.col("source") == s).alias("from_" + s) for s in ("none", "cached", "peer", "origin")],
        F.count_if(graded).alias("input_grants"), F.count_if(graded & F.col("cached_hit")).alias("input_grants_hit"))
    return one.withColumn("hit_rate", F.when(
        F.col("input_grants") > 0, F.col("input_grants_hit") / F.col("input_grants")).otherwise(F.lit(0.0)))


def candidate_counts(stats: DataFrame) -> DataFrame:
    """Outcomes of tasks that tried a peer; the others would dilute the rate."""
    return stats.where("attempts > 0").agg(
        F.count(F.lit(1)).alias("fetches"), F.count_if("connected").alias("connected"),
        *[F.count_if(F.col("mask").bitwiseAND(F.lit(b)) != 0).alias(n)
          for n, b in (("host", 1), ("srflx", 2), ("relay", 4))])


def wasted_work(events: DataFrame, by: list[str]) -> DataFrame:
    return events.where(is_event("cancel")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("cancels"), F.sum("unit_count").alias("wasted_units"))


def job_completion(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Fraction of units accepted on originals, and whether the job is done:
    range exhausted and every task terminal."""
    per = tasks.groupBy("job_id").agg(
        F.sum(F.when((F.col("state") == "Accepted") & F.col("replica_of").isNull(), F.col("unit_count"))).alias("done"),
        F.count_if(~F.col("state").isin(*TERMINAL)).alias("open_tasks"))
    j = jobs.join(per, "job_id", "left")
    done, open_ = F.coalesce("done", F.lit(0)), F.coalesce("open_tasks", F.lit(0))
    return j.select(
        "job_id", done.alias("units_done"), "total_units",
        F.when(F.col("total_units") > 0, done / F.col("total_units")).otherwise(F.lit(0.0)).alias("fraction"),
        ((F.col("next_unit") >= F.col("total_units")) & (open_ == 0)).alias("complete"))


def coverage_loss(audit: DataFrame, jobs: DataFrame) -> DataFrame:
    j = jobs.select("job_id", "total_units").join(audit, "job_id", "left")
    covered = F.coalesce("covered", F.lit(0))
    return j.select("job_id", "total_units", covered.alias("units_covered"),
                    (F.col("total_units") - covered).alias("units_lost"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


def grants_and_tasks(events: DataFrame, by: list[str]) -> DataFrame:
    """Grants and distinct accepted tasks per group in one pass. Counting per
    (group, task) first spreads a hot group over tasks of the cluster."""
    per_task = events.groupBy(*by, "task_id").agg(
        F.count_if(is_event("grant")).alias("g"), F.bool_or(is_event("accept")).alias("a"))
    return per_task.groupBy(*by).agg(F.sum("g").alias("grants"), F.count_if("a").alias("tasks"))


def detection_overhead(events: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Grants per distinct accepted task, and the share of lies not accepted.
    ``truth`` has ``by``, wrong, accepted."""
    per = grants_and_tasks(events, by)
    lies = truth.groupBy(*by).agg(F.count_if("wrong").alias("lies"),
                                  F.count_if(F.col("wrong") & F.col("accepted")).alias("accepted_wrong"))
    j = per.join(lies, by, "left")
    for c in ("lies", "accepted_wrong"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)))
    return (j.withColumn("overhead", F.when(F.col("tasks") > 0, F.col("grants") / F.col("tasks")).otherwise(F.lit(0.0)))
            .withColumn("detected", F.col("lies") - F.col("accepted_wrong"))
            .withColumn("detection_rate", F.when(F.col("lies") > 0, F.col("detected") / F.col("lies"))
                        .otherwise(F.lit(1.0))))


def time_to_ready(workers: DataFrame, by: list[str], ready: str = "ready_ms", grant: str = "grant_ms") -> DataFrame:
    """Workers that never became ready (negative) are counted, not dropped.
    Times are whole milliseconds; -1 where there is none."""
    base = workers.groupBy(*by).agg(
        F.count_if(F.col(ready) >= 0).alias("n_ready"), F.count_if(F.col(ready) < 0).alias("never_ready"),
        F.sum(F.when(F.col(ready) >= 0, F.col(ready))).alias("sum_ready"),
        F.max(F.when(F.col(ready) >= 0, F.col(ready))).alias("max_ready"))
    # Both measures as one long table: one pass for both medians.
    long = workers.select(*by, F.inline(F.array(
        F.struct(F.lit("ready").alias("kind"), F.col(ready).alias("v")),
        F.struct(F.lit("grant").alias("kind"), F.col(grant).alias("v"))))).where("v >= 0")
    mids = nearest_ranks(long, [*by, "kind"], "v", {"lo": lower_mid, "hi": upper_mid})
    mid = (F.col("lo") + F.col("hi")) / 2
    wide = mids.groupBy(*by).agg(F.max(F.when(F.col("kind") == "ready", mid)).alias("ready_mid"),
                                 F.max(F.when(F.col("kind") == "grant", mid)).alias("grant_mid"))
    j = base.join(wide, by, "left")
    return j.select(
        *by, "n_ready", "never_ready",
        F.coalesce("ready_mid", F.lit(-1.0)).alias("median_ms"),
        F.coalesce(F.try_divide(F.col("sum_ready"), F.col("n_ready")).cast("double"), F.lit(-1.0)).alias("mean_ms"),
        F.coalesce(F.col("max_ready").cast("double"), F.lit(-1.0)).alias("max_ms"),
        F.coalesce("grant_mid", F.lit(-1.0)).alias("median_grant_ms"))


def egress_ratio(runs: DataFrame, setting: str, arm: str, measure: str, control, treatment) -> DataFrame:
    """Control as the upper median, treatment as a range, and the ratios."""
    ctl = nearest_ranks(runs.where(F.col(arm) == F.lit(control)), [setting], measure,
                        {"control": upper_mid}).drop("n")
    trt = runs.where(F.col(arm) == F.lit(treatment)).groupBy(setting).agg(
        F.min(measure).alias("low"), F.max(measure).alias("high"))
    return ctl.join(trt, setting).select(
        setting, "control", "low", "high",
        F.when(F.col("high") > 0, F.col("control") / F.col("high")).otherwise(F.lit(0.0)).alias("ratio_low"),
        F.when(F.col("low") > 0, F.col("control") / F.col("low")).otherwise(F.lit(0.0)).alias("ratio_high"))


def device_merge(snapshots: DataFrame, flags: list[str], counters: list[str], latest: list[str],
                 time: str = "timestamp_ms") -> DataFrame:
    """One row per worker over all snapshots: flags or-ed, counters max-ed,
    the last truthy value of the rest, and the first sighting."""
    def truthy(c):
        kind = snapshots.schema[c].dataType.typeName()
        v = F.col(c)
        return v.isNotNull() & (v != "") if kind == "string" else v.isNotNull() & (v != 0)
    return snapshots.groupBy("worker_id").agg(
        F.min(time).alias("first_seen"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags],
        *[F.max(c).alias(c) for c in counters],
        *[F.max_by(c, F.when(truthy(c), F.col(time))).alias(c) for c in latest])


def setting_median(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Upper median of the non-negative values."""
    return nearest_ranks(df.where(F.col(measure) >= 0), by, measure, {"median": upper_mid})


def repeat_spread(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Range and mean of an integer measure over repeats."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.min(measure).alias("low"),
                               F.max(measure).alias("high"), (F.sum(measure) / F.count(measure)).alias("mean"))


def sizing_convergence(events: DataFrame) -> DataFrame:
    """Accepts with a prediction, numbered per worker in time order."""
    acc = events.where(is_event("accept") & (F.col("predicted_ms") > 0)).select(
        "worker_id", "t_ms", "event_id", "predicted_ms", F.col("duration_ms").alias("actual_ms"), "correction")
    return (number_rows(acc, ["worker_id"], ["t_ms", "event_id"], "task_index")
            .withColumn("ratio", F.col("actual_ms") / F.col("predicted_ms")))


def final_corrections(convergence: DataFrame) -> DataFrame:
    """Spread of the workers' last factors: min, true median, max."""
    last = convergence.groupBy("worker_id").agg(
        F.max_by("correction", F.struct("t_ms", "event_id")).alias("final"))
    q = nearest_ranks(last, [], "final", {"lo": lower_mid, "hi": upper_mid,
                                          "min_correction": lambda n: F.lit(0), "max_correction": lambda n: n - 1})
    return q.select(F.col("n").alias("workers"), "min_correction",
                    ((F.col("lo") + F.col("hi")) / 2).alias("median_correction"), "max_correction")


def correction_history(events: DataFrame, alpha: float = 0.3, lease_ms: float | None = None) -> DataFrame:
    """The worker's correction factor after each completion, in time order.
    With ``lease_ms`` an expiry counts as a task that took one lease."""
    kinds = ["accept"] + (["expire"] if lease_ms is not None else [])
    actual = F.col("duration_ms") if lease_ms is None else F.when(
        is_event("expire"), F.lit(float(lease_ms))).otherwise(F.col("duration_ms"))
    rows = events.where(F.col("event").isin(*kinds)).select(
        "worker_id", "t_ms", "event_id", "predicted_ms", actual.alias("actual_ms"))
    fold = Ewma("predicted_ms", "actual_ms", alpha, MIN_CORRECTION, MAX_CORRECTION)
    return scan(rows, ["worker_id"], ["t_ms", "event_id"], ["predicted_ms", "actual_ms"], fold)


def overhead_thirds(events: DataFrame, by: list[str]) -> DataFrame:
    """Grants per distinct accepted task in each third of a run. The thirds are
    half-open, so the very last accept belongs to none."""
    span = events.groupBy(*by).agg(
        F.min(F.when(is_event("grant"), F.col("t_ms"))).alias("t0"),
        F.max(F.when(is_event("accept"), F.col("t_ms"))).alias("t1")).where("t0 is not null and t1 is not null")
    span = span.withColumn("span", F.greatest(F.lit(1).cast("long"), F.col("t1") - F.col("t0")))
    edges = [F.col("t0") + F.floor(F.col("span") * k / 3).cast("long") for k in range(4)]
    third = (F.when((F.col("t_ms") >= edges[0]) & (F.col("t_ms") < edges[1]), 1)
             .when((F.col("t_ms") >= edges[1]) & (F.col("t_ms") < edges[2]), 2)
             .when((F.col("t_ms") >= edges[2]) & (F.col("t_ms") < edges[3]), 3))
    ev = (events.where(F.col("event").isin("grant", "accept")).join(span, by)
          .withColumn("third", third).where("third is not null"))
    j = grants_and_tasks(ev, [*by, "third"])
    return j.select(*by, F.col("third").cast("long").alias("third"), "grants", "tasks",
                    F.when(F.col("tasks") > 0, F.col("grants") / F.col("tasks")).otherwise(F.lit(0.0)).alias("overhead"))


def counter_deltas(timeline: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Change of cumulative counters since the previous sample; the first counts from 0."""
    prev = running(timeline, by, order, {"__prev": ("last", F.struct(*cols))}, inclusive=False)
    for c in cols:
        prev = prev.withColumn(c + "_delta", F.col(c) - F.coalesce(F.col("__prev." + c), F.lit(0)))
    return prev.drop("__prev")


def completion_cdf(accepts: DataFrame, condition: str, value: str, tie: str) -> DataFrame:
    """Sorted values of every condition on the percentile grid of the longest
    one: grid point i reads rank int(i*len/n). Seen from the other side, rank r
    serves the points ceil(r*n/len) up to ceil((r+1)*n/len) - 1, so every row
    produces its own points and nothing is joined."""
    keys = [condition]
    rows = accepts.select(condition, value, tie)
    hot = is_hot(rows, keys)
    r = running(rows, keys, [value, tie], {"__r": ("count", F.lit(1)), "__len": ("total", F.lit(1))}, hot=hot)
    longest = (accepts.groupBy(condition).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("__n")))
    r = r.join(F.broadcast(longest))  # one row

    def wide(c):
        return F.col(c).cast("decimal(19,0)")

    def ceil_of(rank):
        return whole_div(rank * wide("__n") + wide("__len") - 1, wide("__len"))
    points = expand(r, ceil_of(wide("__r") - 1), ceil_of(wide("__r")) - 1, "i")
    return points.select("i", (F.lit(100.0) * (F.col("i") + 1) / F.col("__n")).alias("percentile"), condition, value)


def scaling_efficiency(runs: DataFrame, base_workers: int = 1) -> DataFrame:
    """Speed-up over the base size, efficiency, and the ideal line."""
    base = runs.where(F.col("workers") == base_workers).agg(F.max("units_per_sec").alias("base"))
    return runs.join(F.broadcast(base)).select(
        *runs.columns,
        (F.col("units_per_sec") / F.col("base")).alias("speedup"),
        (F.col("units_per_sec") / (F.col("workers") / F.lit(float(base_workers)) * F.col("base"))).alias("efficiency"),
        (F.col("base") * F.col("workers") / F.lit(float(base_workers))).alias("ideal"))


def leaderboard(workers: DataFrame, limit: int | None = None) -> DataFrame:
    """Workers by observed rate, fastest first; ties by id. With ``limit`` the
    sort is a per-task top-k merge instead of a full range sort."""
    out = workers.orderBy(F.col("units_per_sec").desc_nulls_last(), F.col("worker_id").asc())
    return out.limit(limit) if limit else out
