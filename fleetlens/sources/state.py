"""Durable state tables: changelog compaction, bridges, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import STATES

# Per entity, the columns a conflicting write may change.
MUTABLE = {
    "jobs": ["next_unit"],
    "tasks": ["state"],
    "reputation": ["alpha", "beta", "accepted", "rejected", "spot_failures",
                   "blacklisted_until_ms", "on_probation"],
}


def _as_struct(order) -> Column:
    names = [order] if isinstance(order, str) else list(order)
    return F.struct(*names)


def compact(df: DataFrame, keys: list[str], order, mutable: list[str]) -> DataFrame:
    """Last write per key for ``mutable`` columns, first write for the others.
    One aggregation with map-side combine, so a hot key costs one row per task."""
    ver = _as_struct(order)
    names = [order] if isinstance(order, str) else list(order)
    fixed = [c for c in df.columns if c not in keys and c not in mutable and c not in names]
    aggs = [F.max_by(F.struct(*mutable), ver).alias("__m")]
    if fixed:
        aggs.append(F.min_by(F.struct(*fixed), ver).alias("__f"))
    got = df.groupBy(*keys).agg(*aggs)
    cols = [F.col("__m." + c).alias(c) if c in mutable else F.col("__f." + c).alias(c)
            for c in df.columns if c in mutable or c in fixed]
    return got.select(*keys, *cols)


def prior_workers(subs: DataFrame) -> DataFrame:
    return subs.select("task_id", "worker_id").dropDuplicates()


def recover(tasks: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State after a restart: (tasks, jobs, next_id).

    Unknown states read as Queued; Leased and Validating go back to the queue.
    Holder and lease are cleared everywhere. A job's task list is the task
    table keyed by job plus a count, not an array: a job may own any number of
    tasks.
    """
    known = F.col("state").isin(*STATES)
    was = F.when(known, F.col("state")).otherwise(F.lit("Queued"))
    back = was.isin("Leased", "Validating")
    out = (tasks
           .withColumn("requeued", back)
           .withColumn("state", F.when(back, F.lit("Queued")).otherwise(was))
           .withColumn("holder", F.lit(0).cast("long"))
           .withColumn("lease_expires_at_ms", F.lit(0).cast("long")))
    counts = out.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_tasks"),
                                       F.count_if("requeued").alias("n_requeued"))
    jobs_out = (jobs.join(counts, "job_id", "left")
                .withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)))
                .withColumn("n_requeued", F.coalesce("n_requeued", F.lit(0))))
    ids = tasks.select(F.col("task_id").alias("id")).unionByName(jobs.select(F.col("job_id").alias("id")))
    next_id = ids.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)) + 1, F.lit(1)).alias("next_id"))
    return out, jobs_out, next_id
