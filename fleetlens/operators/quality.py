"""Filters and predicates over tasks, leases, workers and payload declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import TERMINAL

# Size and rate limits.
MAX_PARAMS_BYTES = 4 * 1024
MAX_OUTPUT_BYTES = 8 * 1024 * 1024
MAX_ENVELOPE_BYTES = 64 * 1024
MIN_UPLOAD_INTERVAL_MS = 500
CHUNK_BYTES = 16 * 1024
WORKER_TIMEOUT_MS = 45_000
SPOT_MULTIPLIER = 2654435761
PROVEN_AT = 0.9
RATE_TRUSTED = 0.02
RATE_UNPROVEN = 0.10
SPECULATE_AT = 0.95


def quality_rules() -> dict[str, Column]:
    """Name -> condition that marks a broken row. A missing field is no violation."""
    c = F.col
    return {
        "params_size": c("params_bytes") > MAX_PARAMS_BYTES,
        "output_size": c("output_bytes") > MAX_OUTPUT_BYTES,
        "envelope_size": c("envelope_bytes") > MAX_ENVELOPE_BYTES,
        "single_in_flight": c("in_flight") > 1,
        "lease_held": ~c("lease_held"),
        "replica_worker_new": c("worker_is_prior"),
        "upload_interval": (c("upload_interval_ms") != 0) & (c("upload_interval_ms") < MIN_UPLOAD_INTERVAL_MS),
        "checksum": c("checksum") != c("computed_checksum"),
        "payload_length": c("declared_bytes") != c("actual_bytes"),
        "chunk_total": c("chunk_total") != c("expected_chunks"),
        "chunk_index": c("chunk_index") >= c("chunk_total"),
        "chunk_size": c("chunk_bytes") > CHUNK_BYTES,
        "chunk_short": (c("chunk_bytes") < CHUNK_BYTES) & (c("chunk_index") + 1 != c("chunk_total")),
    }


def usable_rules(df: DataFrame) -> dict[str, Column]:
    """The rules whose columns ``df`` has."""
    need = {
        "params_size": ["params_bytes"], "output_size": ["output_bytes"], "envelope_size": ["envelope_bytes"],
        "single_in_flight": ["in_flight"], "lease_held": ["lease_held"], "replica_worker_new": ["worker_is_prior"],
        "upload_interval": ["upload_interval_ms"], "checksum": ["checksum", "computed_checksum"],
        "payload_length": ["declared_bytes", "actual_bytes"], "chunk_total": ["chunk_total", "expected_chunks"],
        "chunk_index": ["chunk_index", "chunk_total"], "chunk_size": ["chunk_bytes"],
        "chunk_short": ["chunk_bytes", "chunk_index", "chunk_total"],
    }
    return {n: r for n, r in quality_rules().items() if set(need[n]) <= set(df.columns)}


def quality_report(df: DataFrame, rules: dict[str, Column], id_col: str) -> DataFrame:
    """(rule, violations, sample): one pass, one row of partial results per task."""
    aggs = []
    for name, broken in rules.items():
        hit = F.coalesce(broken, F.lit(False))
        aggs += [F.count_if(hit).alias("n_" + name), F.min(F.when(hit, F.col(id_col))).alias("s_" + name)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("n_" + n).alias("violations"),
                              F.coalesce(F.col("s_" + n), F.lit(-1)).cast("long").alias("sample")) for n in rules])
    return one.select(F.inline(rows))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The broken rows with the names of the rules they break."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def overdue_leases(tasks: DataFrame, now_ms: int) -> DataFrame:
    """Leases at or past their deadline: valid strictly before it."""
    return tasks.where((F.col("state") == "Leased") & (F.col("lease_expires_at_ms") <= F.lit(now_ms)))


def lost_workers(events: DataFrame, now_ms, timeout_ms: int = WORKER_TIMEOUT_MS) -> DataFrame:
    """Workers silent for more than the timeout. ``now_ms`` is a number or a
    column of ``events`` that is constant over the table."""
    seen = events.groupBy("worker_id").agg(F.max("t_ms").alias("last_seen_ms"))
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return seen.where(F.col("last_seen_ms") + F.lit(timeout_ms) < now)


def spot_sample(grants: DataFrame, scores: DataFrame, pool: DataFrame) -> DataFrame:
    """Grants replaced by a known range. ``scores`` (worker_id, score) may miss
    workers, who then score the prior. ``pool`` (slot, start_unit, unit_count,
    checksum) is numbered from 0 and bounded (known_pool keeps 256)."""
    # The product wraps at 64 bits without a sign.
    h = F.expr(f"cast(task_id as decimal(20, 0)) * {SPOT_MULTIPLIER} % {1 << 64}")
    # No score draws at more than the unproven rate: nine in ten grants leave before the join.
    drawn = grants.withColumn("roll", (h % 10000).cast("long") / F.lit(10000.0)).where(F.col("roll") < max(RATE_UNPROVEN, RATE_TRUSTED))
    g = drawn.join(scores, "worker_id", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))
    rate = F.when(F.col("score") >= PROVEN_AT, F.lit(RATE_TRUSTED)).otherwise(F.lit(RATE_UNPROVEN))
    # The pool is bounded, so it rides along as one array in one broadcast row.
    packed = pool.agg(F.array_sort(F.collect_list(F.struct("slot", *[c for c in pool.columns if c != "slot"]))).alias("pool"))
    chosen = g.where(F.col("roll") < rate).join(F.broadcast(packed)).where(F.size("pool") > 0)
    at = (F.floor(h / 65536).cast("long") % F.size("pool") + 1).cast("int")
    return chosen.withColumn("pick", F.element_at("pool", at)).select(*g.columns, "pick.*")


def speculation_candidates(tasks: DataFrame, jobs: DataFrame, proposals: DataFrame, prior: DataFrame,
                           threshold: float = SPECULATE_AT) -> DataFrame:
    """Which proposed (task, worker) races are allowed. The worker is proposed
    by the caller, one per request, so the number of pairs is the number of
    requests and never tasks times workers."""
    done = (tasks.groupBy("job_id").agg(
        F.sum(F.when((F.col("state") == "Accepted") & F.col("replica_of").isNull(), F.col("unit_count")))
        .alias("done")))
    ripe = (jobs.where(F.col("next_unit") >= F.col("total_units")).join(done, "job_id")
            .where((F.col("total_units") > 0) & (F.col("done") / F.col("total_units") >= threshold))
            .select("job_id"))
    live = (tasks.where(F.col("replica_of").isNotNull() & ~F.col("state").isin(*TERMINAL))
            .select(F.col("replica_of").alias("task_id")).dropDuplicates())
    originals = tasks.where((F.col("state") == "Leased") & F.col("replica_of").isNull())
    return (originals.join(ripe, "job_id", "left_semi").join(live, "task_id", "left_anti")
            .select("task_id", "job_id", "holder", "start_unit", "unit_count")
            .join(proposals, "task_id")
            .where(F.col("worker_id") != F.col("holder"))
            .join(prior.select("task_id", "worker_id").dropDuplicates(), ["task_id", "worker_id"], "left_anti"))


def blacklist_filter(requests: DataFrame, reputation: DataFrame, now_col: str = "t_ms") -> DataFrame:
    """Requests of workers not banned at that moment; a served ban shows as probation."""
    until = F.coalesce("blacklisted_until_ms", F.lit(0))
    j = requests.join(reputation.select("worker_id", "blacklisted_until_ms", "on_probation"), "worker_id", "left")
    return (j.where(~((until != 0) & (F.col(now_col) < until)))
            .withColumn("on_probation", F.coalesce("on_probation", F.lit(False)) | (until != 0))
            .drop("blacklisted_until_ms"))
