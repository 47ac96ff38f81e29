"""Event-log analytics over the test tables."""

import uuid

from pyspark.sql import functions as F

from fleetlens.operators import joins as J
from fleetlens.operators import summary as S
from fleetlens.plans import bindings as B
from fleetlens.plans.catalog import query
from fleetlens.session import checkpoint_dir
from fleetlens.sources.tables import read_result_table, write_result_table

def _rank(q: str, n: str) -> str:
    return f"list_sort(ds)[CAST(least({n} - 1, floor({q}::DOUBLE * {n})) AS BIGINT) + 1]"


RUN_SUMMARY = f"""
WITH g AS (SELECT run, count(*) FILTER (event = 'accept') AS tasks, sum(unit_count) FILTER (event = 'accept') AS units,
  greatest(1, max(t_ms) FILTER (event = 'accept') - min(t_ms) FILTER (event = 'grant')) AS wall_ms,
  list(duration_ms) FILTER (event = 'accept') AS ds, max(duration_ms) FILTER (event = 'accept') AS max_ms,
  count(*) FILTER (event = 'expire') AS expiries, count(*) FILTER (event = 'cancel') AS cancels,
  count(*) FILTER (event = 'grant' AND speculative <> 0) AS speculative_grants,
  coalesce(sum(unit_count) FILTER (event = 'cancel'), 0) AS wasted_units, count(*) FILTER (event = 'grant') AS grants
  FROM ev GROUP BY run)
SELECT run, tasks, CAST(units AS BIGINT) AS units, wall_ms, 1000.0::DOUBLE * units / wall_ms AS units_per_sec,
  (list_sort(ds)[(tasks - 1) // 2 + 1] + list_sort(ds)[tasks // 2 + 1]) / 2 AS p50_ms,
  {_rank('0.95', 'tasks')} AS p95_ms, {_rank('0.99', 'tasks')} AS p99_ms, max_ms, expiries, cancels,
  speculative_grants, CAST(wasted_units AS BIGINT) AS wasted_units FROM g WHERE tasks > 0 AND grants > 0"""


@query("run_summary", ["ev"], RUN_SUMMARY)
def run_summary(spark, sf):
    return S.run_summary(B.event_log(spark, sf, "grant", "accept", "expire", "cancel"), ["run"])


@query("result_table", ["ev"], f"SELECT *, 'SIMULATED' AS provenance FROM ({RUN_SUMMARY})")
def result_table(spark, sf):
    """The summary written as a labelled result table and read back."""
    got = S.run_summary(B.event_log(spark, sf, "grant", "accept", "expire", "cancel"), ["run"])
    path = f"{checkpoint_dir(spark)}/fleetlens-results/{uuid.uuid4().hex}"
    write_result_table(got, path, "run_summary", "SIMULATED", "test tables")
    return read_result_table(spark, path, got.schema).drop("source_file", "rev")


@query("state_counts", ["tk"], """
SELECT s AS state, (SELECT count(*) FROM tk WHERE state = s) AS count,
  (SELECT count(*) FROM tk WHERE state = s)::DOUBLE / (SELECT count(*) FROM tk) AS share
FROM (SELECT unnest(['Queued','Leased','Validating','NeedsReplica','Accepted','Rejected','Cancelled']) AS s)""")
def state_counts(spark, sf):
    return S.state_counts(B.tasks(spark, sf))


@query("fleet_snapshot", ["tk", "jb", "ev"], """
SELECT *, 100.0::DOUBLE * (units_total - units_remaining) / units_total AS progress_pct FROM
 (SELECT count(*) AS total_tasks, count(*) FILTER (state = 'Queued') AS queue_depth,
    count(*) FILTER (state = 'Accepted') AS tasks_done FROM tk),
 (SELECT CAST(sum(total_units) AS BIGINT) AS units_total, CAST(sum(total_units - next_unit) AS BIGINT) AS units_remaining FROM jb),
 (SELECT count(DISTINCT worker_id) AS workers, CAST(sum(unit_count) FILTER (event = 'cancel') AS BIGINT) AS wasted_units FROM ev)""")
def fleet_snapshot(spark, sf):
    return S.fleet_snapshot(B.tasks(spark, sf), B.jobs(spark, sf), B.event_log(spark, sf))


THROUGHPUT = """
SELECT worker_id, count(*) AS tasks_completed, CAST(sum(unit_count) AS BIGINT) AS units_completed,
  sum(CAST(round(duration_ms * 1000) AS BIGINT)) / 1000.0::DOUBLE AS observed_ms,
  1000.0::DOUBLE * sum(unit_count) / (sum(CAST(round(duration_ms * 1000) AS BIGINT)) / 1000.0::DOUBLE) AS units_per_sec
FROM ev WHERE event = 'accept' GROUP BY worker_id"""


@query("worker_throughput", ["ev"], THROUGHPUT)
def worker_throughput(spark, sf):
    return S.worker_throughput(B.event_log(spark, sf, "accept"))


@query("leaderboard", ["ev"], THROUGHPUT)
def leaderboard(spark, sf):
    return S.leaderboard(S.worker_throughput(B.event_log(spark, sf, "accept")))


@query("source_mix", ["ft"], """
SELECT *, CASE WHEN input_grants > 0 THEN input_grants_hit::DOUBLE / input_grants ELSE 0 END AS hit_rate FROM (
SELECT count(*) FILTER (source = 'none') AS from_none, count(*) FILTER (source = 'cached') AS from_cached,
  count(*) FILTER (source = 'peer') AS from_peer, count(*) FILTER (source = 'origin') AS from_origin,
  count(*) FILTER (has_input AND NOT requeued) AS input_grants,
  count(*) FILTER (has_input AND NOT requeued AND cached_hit) AS input_grants_hit FROM ft)""")
def source_mix(spark, sf):
    return S.source_mix(B.fetches(spark, sf))


@query("candidate_counts", ["ft"], """
SELECT count(*) AS fetches, count(*) FILTER (connected) AS connected, count(*) FILTER (mask & 1 <> 0) AS host,
  count(*) FILTER (mask & 2 <> 0) AS srflx, count(*) FILTER (mask & 4 <> 0) AS relay FROM ft WHERE attempts > 0""")
def candidate_counts(spark, sf):
    return S.candidate_counts(B.fetches(spark, sf))


@query("wasted_work", ["ev"], """
SELECT run, count(*) AS cancels, CAST(sum(unit_count) AS BIGINT) AS wasted_units FROM ev WHERE event = 'cancel' GROUP BY run""")
def wasted_work(spark, sf):
    return S.wasted_work(B.event_log(spark, sf, "cancel"), ["run"])


@query("job_completion", ["tk", "jb"], """
SELECT job_id, CAST(coalesce(done, 0) AS BIGINT) AS units_done, total_units,
  CASE WHEN total_units > 0 THEN coalesce(done, 0)::DOUBLE / total_units ELSE 0 END AS fraction,
  next_unit >= total_units AND coalesce(open_tasks, 0) = 0 AS complete
FROM jb LEFT JOIN (SELECT job_id, sum(unit_count) FILTER (state = 'Accepted' AND replica_of IS NULL) AS done,
  count(*) FILTER (state NOT IN ('Accepted','Rejected','Cancelled')) AS open_tasks FROM tk GROUP BY job_id) USING (job_id)""")
def job_completion(spark, sf):
    return S.job_completion(B.tasks(spark, sf), B.jobs(spark, sf))


@query("detection_overhead", ["ev", "tr"], """
WITH g AS (SELECT 'src' || CAST(worker_id % 20 AS VARCHAR) AS arm, count(*) FILTER (event = 'grant') AS grants,
    count(DISTINCT task_id) FILTER (event = 'accept') AS tasks FROM ev GROUP BY 1 HAVING count(*) FILTER (event IN ('grant', 'accept')) > 0),
  l AS (SELECT arm, count(*) FILTER (wrong) AS lies, count(*) FILTER (wrong AND accepted) AS accepted_wrong FROM tr GROUP BY arm)
SELECT arm, grants, tasks, coalesce(lies, 0) AS lies, coalesce(accepted_wrong, 0) AS accepted_wrong,
  CASE WHEN tasks > 0 THEN grants::DOUBLE / tasks ELSE 0 END AS overhead,
  coalesce(lies, 0) - coalesce(accepted_wrong, 0) AS detected,
  CASE WHEN lies > 0 THEN (lies - accepted_wrong)::DOUBLE / lies ELSE 1.0 END AS detection_rate
FROM g LEFT JOIN l USING (arm)""")
def detection_overhead(spark, sf):
    ev = B.event_log(spark, sf, "grant", "accept").withColumn("arm", F.concat(F.lit("src"), (F.col("worker_id") % 20).cast("string")))
    return S.detection_overhead(ev, B.truth(spark, sf), ["arm"])


@query("time_to_ready", ["jt"], """
WITH r AS (SELECT run, count(*) FILTER (ready_ms >= 0) AS n_ready, count(*) FILTER (ready_ms < 0) AS never_ready,
  list_sort(list(ready_ms) FILTER (ready_ms >= 0)) AS ds, list_sort(list(grant_ms) FILTER (grant_ms >= 0)) AS gs,
  sum(ready_ms) FILTER (ready_ms >= 0) AS sm FROM jt GROUP BY run)
SELECT run, n_ready, never_ready,
  coalesce((ds[(len(ds) - 1) // 2 + 1] + ds[len(ds) // 2 + 1]) / 2::DOUBLE, -1) AS median_ms,
  coalesce(sm::DOUBLE / n_ready, -1) AS mean_ms, coalesce(list_max(ds)::DOUBLE, -1) AS max_ms,
  coalesce((gs[(len(gs) - 1) // 2 + 1] + gs[len(gs) // 2 + 1]) / 2::DOUBLE, -1) AS median_grant_ms FROM r""")
def time_to_ready(spark, sf):
    return S.time_to_ready(B.join_times(spark, sf), ["run"])


def _runs(spark, sf):
    """Cancelled units per (day, worker parity, hour): repeats of a setting."""
    ev = B.event_log(spark, sf, "cancel")
    return ev.groupBy("run", "condition", F.floor(F.col("t_ms") / 3_600_000).alias("rep")).agg(
        F.sum("unit_count").alias("egress"))


RUNS = """
u AS (SELECT run, condition, t_ms // 3600000 AS rep, CAST(sum(unit_count) AS BIGINT) AS egress FROM ev
  WHERE event = 'cancel' GROUP BY ALL)"""


@query("egress_ratio", ["ev"], f"""
WITH {RUNS}, c AS (SELECT run, list_sort(list(egress)) AS e FROM u WHERE condition = 0 GROUP BY run),
 t AS (SELECT run, min(egress) AS low, max(egress) AS high FROM u WHERE condition = 1 GROUP BY run)
SELECT run, e[len(e) // 2 + 1] AS control, low, high, e[len(e) // 2 + 1]::DOUBLE / high AS ratio_low,
  e[len(e) // 2 + 1]::DOUBLE / low AS ratio_high FROM c JOIN t USING (run)""")
def egress_ratio(spark, sf):
    return S.egress_ratio(_runs(spark, sf), "run", "condition", "egress", 0, 1)


@query("setting_median", ["jt"], """
SELECT run, condition, len(ds) AS n, ds[len(ds) // 2 + 1] AS median FROM (
  SELECT run, condition, list_sort(list(ready_ms)) AS ds FROM jt WHERE ready_ms >= 0 GROUP BY ALL)""")
def setting_median(spark, sf):
    return S.setting_median(B.join_times(spark, sf), ["run", "condition"], "ready_ms")


@query("repeat_spread", ["ev"], f"""
WITH {RUNS} SELECT condition, count(*) AS runs, min(egress) AS low, max(egress) AS high,
  sum(egress)::DOUBLE / count(*) AS mean FROM u GROUP BY condition""")
def repeat_spread(spark, sf):
    return S.repeat_spread(_runs(spark, sf), ["condition"], "egress")


@query("arm_compare", ["ev"], """
SELECT run, (sum(unit_count) FILTER (condition = 0))::DOUBLE / count(*) FILTER (condition = 0) AS control,
  (sum(unit_count) FILTER (condition = 1))::DOUBLE / count(*) FILTER (condition = 1) AS treatment,
  (sum(unit_count) FILTER (condition = 1))::DOUBLE / count(*) FILTER (condition = 1)
  - (sum(unit_count) FILTER (condition = 0))::DOUBLE / count(*) FILTER (condition = 0) AS delta
FROM ev WHERE event = 'accept' GROUP BY run""")
def arm_compare(spark, sf):
    ev = B.event_log(spark, sf, "accept").select("run", "condition", "unit_count")
    return J.arm_compare(ev, "condition", "run", F.col("unit_count"), 0, 1)


@query("rate_delta", ["ft"], """
WITH a AS (SELECT count(*) FILTER (condition = 0) AS attempts_a, count(*) FILTER (condition = 0 AND connected) AS connected_a,
  count(*) FILTER (condition = 0 AND relay) AS relay_a, count(*) FILTER (condition = 1) AS attempts_b,
  count(*) FILTER (condition = 1 AND connected) AS connected_b, count(*) FILTER (condition = 1 AND relay) AS relay_b
  FROM ft WHERE attempts > 0)
SELECT *, CASE WHEN attempts_a = 0 OR attempts_b = 0 THEN 'no attempts in an arm'
    WHEN relay_a = 0 AND relay_b = 0 THEN 'no relay in either arm' ELSE 'ok' END AS reason,
  connected_a::DOUBLE / attempts_a AS rate_a, connected_b::DOUBLE / attempts_b AS rate_b,
  CASE WHEN attempts_a > 0 AND attempts_b > 0 AND relay_a + relay_b > 0
    THEN connected_b::DOUBLE / attempts_b - connected_a::DOUBLE / attempts_a END AS delta FROM a""")
def rate_delta(spark, sf):
    return J.rate_delta(B.fetches(spark, sf), "condition", 0, 1)


@query("grant_accept_asof", ["ev"], """
WITH e AS (SELECT *, lag(event) OVER w AS pe, lag(t_ms) OVER w AS pt, lag(task_id) OVER w AS pk FROM ev
  WHERE event IN ('grant', 'accept') WINDOW w AS (PARTITION BY worker_id ORDER BY t_ms, event_id))
SELECT event_id, worker_id, task_id, t_ms, CASE WHEN pe = 'grant' THEN pt END AS granted_at_ms,
  CASE WHEN pe = 'grant' THEN pk END AS granted_task_id, CASE WHEN pe = 'grant' THEN t_ms - pt END AS actual_ms
FROM e WHERE event = 'accept'""")
def grant_accept_asof(spark, sf):
    return J.grant_accept_asof(B.event_log(spark, sf, "grant", "accept"))


CONVERGENCE = """
cv AS (SELECT worker_id, t_ms, event_id, predicted_ms, duration_ms AS actual_ms, correction,
  row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS task_index,
  duration_ms / predicted_ms AS ratio FROM ev WHERE event = 'accept' AND predicted_ms > 0)"""


@query("sizing_convergence", ["ev"], f"WITH {CONVERGENCE} SELECT * FROM cv")
def sizing_convergence(spark, sf):
    return S.sizing_convergence(B.event_log(spark, sf, "accept"))


CORRECTIONS = """WITH RECURSIVE a AS (SELECT worker_id, t_ms, event_id, predicted_ms,
    CASE WHEN event = 'expire' THEN 60000.0::DOUBLE ELSE duration_ms END AS actual_ms,
    row_number() OVER (PARTITION BY worker_id ORDER BY t_ms, event_id) AS i FROM ev WHERE event IN ('accept', 'expire')),
 f AS (SELECT worker_id, i, 0.7::DOUBLE * 1.0 + 0.3::DOUBLE * least(greatest(actual_ms / predicted_ms, 0.1), 1000.0) AS c
   FROM a WHERE i = 1
  UNION ALL SELECT a.worker_id, a.i, 0.7::DOUBLE * f.c + 0.3::DOUBLE * least(greatest(a.actual_ms / a.predicted_ms, 0.1), 1000.0)
   FROM f JOIN a ON a.worker_id = f.worker_id AND a.i = f.i + 1)"""


@query("correction_history", ["ev"], f"""{CORRECTIONS}
SELECT a.worker_id, a.t_ms, a.event_id, a.predicted_ms, a.actual_ms, f.c AS correction_after
FROM a JOIN f USING (worker_id, i)""")
def correction_history(spark, sf):
    return S.correction_history(B.event_log(spark, sf, "accept", "expire"), lease_ms=60_000)


@query("final_corrections", ["ev"], f"""{CORRECTIONS}, l AS (SELECT list_sort(list(v)) AS s FROM (SELECT arg_max(c, i) AS v FROM f GROUP BY worker_id))
SELECT len(s) AS workers, s[1] AS min_correction, (s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2 AS median_correction,
  s[len(s)] AS max_correction FROM l""")
def final_corrections(spark, sf):
    h = S.correction_history(B.event_log(spark, sf, "accept", "expire"), lease_ms=60_000)
    return S.final_corrections(h.withColumnRenamed("correction_after", "correction"))


@query("overhead_thirds", ["ev"], """
WITH s AS (SELECT run, min(t_ms) FILTER (event = 'grant') AS t0,
    greatest(1, max(t_ms) FILTER (event = 'accept') - min(t_ms) FILTER (event = 'grant')) AS span FROM ev GROUP BY run),
 e AS (SELECT ev.*, CASE WHEN t_ms >= t0 AND t_ms < t0 + span // 3 THEN 1 WHEN t_ms >= t0 + span // 3 AND t_ms < t0 + span * 2 // 3 THEN 2
    WHEN t_ms >= t0 + span * 2 // 3 AND t_ms < t0 + span THEN 3 END AS third FROM ev JOIN s USING (run)
    WHERE event IN ('grant', 'accept') AND span IS NOT NULL)
SELECT run, CAST(third AS BIGINT) AS third, count(*) FILTER (event = 'grant') AS grants,
  count(DISTINCT task_id) FILTER (event = 'accept') AS tasks,
  CASE WHEN count(DISTINCT task_id) FILTER (event = 'accept') > 0 THEN (count(*) FILTER (event = 'grant'))::DOUBLE
    / count(DISTINCT task_id) FILTER (event = 'accept') ELSE 0 END AS overhead
FROM e WHERE third IS NOT NULL GROUP BY run, third""")
def overhead_thirds(spark, sf):
    return S.overhead_thirds(B.event_log(spark, sf, "grant", "accept"), ["run"])


@query("counter_deltas", ["ev"], """
WITH t AS (SELECT t_ms // 3600000 AS hour, count(*) FILTER (event = 'accept') AS a, count(*) FILTER (event = 'grant') AS g
  FROM ev GROUP BY 1),
 c AS (SELECT hour, CAST(sum(a) OVER (ORDER BY hour) AS BIGINT) AS accepts, CAST(sum(g) OVER (ORDER BY hour) AS BIGINT) AS grants FROM t)
SELECT *, accepts - coalesce(lag(accepts) OVER (ORDER BY hour), 0) AS accepts_delta,
  grants - coalesce(lag(grants) OVER (ORDER BY hour), 0) AS grants_delta FROM c""")
def counter_deltas(spark, sf):
    from fleetlens.operators.ordered import running
    ev = B.event_log(spark, sf)
    t = ev.groupBy(F.floor(F.col("t_ms") / 3_600_000).alias("hour")).agg(
        F.count_if(F.col("event") == "accept").alias("a"), F.count_if(F.col("event") == "grant").alias("g"))
    c = running(t, [], ["hour"], {"accepts": ("sum", F.col("a")), "grants": ("sum", F.col("g"))}).drop("a", "g")
    return S.counter_deltas(c, [], ["hour"], ["accepts", "grants"])


@query("completion_cdf", ["ev"], """
WITH a AS (SELECT condition, duration_ms, row_number() OVER (PARTITION BY condition ORDER BY duration_ms, event_id) - 1 AS r,
   count(*) OVER (PARTITION BY condition) AS len FROM ev WHERE event = 'accept'),
 n AS (SELECT max(len) AS n FROM a), g AS (SELECT unnest(range(0, (SELECT n FROM n))) AS i)
SELECT i, 100.0::DOUBLE * (i + 1) / n AS percentile, condition, duration_ms FROM g, n, a
WHERE a.r = least(CAST(floor((i * len)::DOUBLE / n) AS BIGINT), len - 1)""")
def completion_cdf(spark, sf):
    acc = B.event_log(spark, sf, "accept")
    return S.completion_cdf(acc, "condition", "duration_ms", "event_id")


@query("scaling_efficiency", ["ev"], """
WITH r AS (SELECT worker_id % 10 + 1 AS workers, 1000.0::DOUBLE * sum(unit_count) / (max(t_ms) - min(t_ms)) AS units_per_sec
  FROM ev WHERE event = 'accept' GROUP BY 1), b AS (SELECT max(units_per_sec) AS base FROM r WHERE workers = 1)
SELECT workers, units_per_sec, units_per_sec / base AS speedup, units_per_sec / (workers / 1.0::DOUBLE * base) AS efficiency,
  base * workers / 1.0::DOUBLE AS ideal FROM r, b""")
def scaling_efficiency(spark, sf):
    runs = B.event_log(spark, sf, "accept").groupBy((F.col("worker_id") % 10 + 1).alias("workers")).agg(
        (F.lit(1000.0) * F.sum("unit_count") / (F.max("t_ms") - F.min("t_ms"))).alias("units_per_sec"))
    return S.scaling_efficiency(runs)


@query("device_merge", ["hw"], """
SELECT worker_id, min(timestamp_ms) AS first_seen, bool_or(flags & 1 <> 0) AS ice_host, bool_or(flags & 2 <> 0) AS ice_srflx,
  bool_or(flags & 4 <> 0) AS ice_relay, max(tasks_completed) AS tasks_completed,
  arg_max(ice_gathered, timestamp_ms) FILTER (ice_gathered <> 0) AS ice_gathered FROM hw GROUP BY worker_id""")
def device_merge(spark, sf):
    h = B.hourly_workers(spark, sf)
    for n, b in (("ice_host", 1), ("ice_srflx", 2), ("ice_relay", 4)):
        h = h.withColumn(n, F.col("flags").bitwiseAND(F.lit(b)) != 0)
    return S.device_merge(h, ["ice_host", "ice_srflx", "ice_relay"], ["tasks_completed"], ["ice_gathered"])


@query("pooled_runs", ["ev"], """
SELECT condition, event_id, duration_ms FROM ev WHERE event = 'accept' AND condition = 0
UNION ALL SELECT condition, event_id, duration_ms FROM ev WHERE event = 'accept' AND condition = 1""")
def pooled_runs(spark, sf):
    acc = B.event_log(spark, sf, "accept").select("condition", "event_id", "duration_ms")
    return J.pooled_runs(acc.where("condition = 0"), acc.where("condition = 1"))


@query("lost_workers", ["ev"], """
WITH l AS (SELECT worker_id, max(t_ms) AS last_seen_ms FROM ev GROUP BY worker_id)
SELECT * FROM l WHERE last_seen_ms + 86400000 < (SELECT max(t_ms) FROM ev)""")
def lost_workers(spark, sf):
    from fleetlens.operators.quality import lost_workers as lost
    ev = B.event_log(spark, sf)
    now = ev.agg(F.max("t_ms")).first()[0]  # the log's own clock: one number
    return lost(ev, now, 86_400_000)
