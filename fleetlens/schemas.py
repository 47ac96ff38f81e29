"""Explicit schemas of every input the toolkit reads."""

from pyspark.sql import types as T

EVENT_LOG = T.StructType([
    T.StructField("t_ms", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("task_id", T.LongType()),
    T.StructField("worker_id", T.LongType()),
    T.StructField("unit_count", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("predicted_ms", T.DoubleType()),
    T.StructField("correction", T.DoubleType()),
    T.StructField("speculative", T.IntegerType()),
])

FLEET_MEMBER = T.StructType([
    T.StructField("worker_id", T.LongType()),
    T.StructField("tasks_completed", T.LongType()),
    T.StructField("score_ops_per_sec", T.DoubleType()),
    T.StructField("correction", T.DoubleType()),
    T.StructField("throttle", T.DoubleType()),
    T.StructField("observed_units_per_sec", T.DoubleType()),
    T.StructField("adapter_vendor", T.StringType()),
    T.StructField("adapter_device", T.StringType()),
    T.StructField("adapter_backend", T.StringType()),
    T.StructField("ice_gathered", T.LongType()),
    T.StructField("ice_host", T.BooleanType()),
    T.StructField("ice_srflx", T.BooleanType()),
    T.StructField("ice_relay", T.BooleanType()),
    T.StructField("ms_to_first_grant", T.DoubleType()),
    T.StructField("ms_to_first_result", T.DoubleType()),
])

SNAPSHOT = T.StructType([
    *[T.StructField(n, T.LongType()) for n in (
        "timestamp_ms", "workers", "queue_depth", "total_tasks", "units_total",
        "units_remaining", "wasted_units", "asset_grants", "asset_grants_hit",
        "asset_from_peer", "asset_from_coordinator", "asset_from_cache",
        "coordinator_asset_egress", "ice_fetches", "ice_connected", "ice_host",
        "ice_srflx", "ice_relay", "rejected_frames")],
    T.StructField("tasks_by_state", T.ArrayType(T.LongType())),
    T.StructField("state_names", T.ArrayType(T.StringType())),
    T.StructField("fleet", T.ArrayType(FLEET_MEMBER)),
])

# Published result tables: name -> columns ("s" string, "l" bigint, "d" double).
RESULT_TABLES = {
    "scaling": "workers l, tasks l, units l, wall_ms l, units_per_sec d, p50_ms d, p95_ms d, p99_ms d, "
               "max_ms d, expiries l, cancels l, speculative_grants l, wasted_units l, efficiency d",
    "fault_tolerance": "kill_fraction d, fleet l, killed l, units_total l, units_covered l, units_lost l, "
                       "keyspace_gaps l, expiries l, tasks l, wall_ms l",
    "byzantine": "policy s, liar_fraction d, collude l, lies_submitted l, accepted_checked l, accepted_wrong l, "
                 "tasks l, grants l, overhead_factor d, detected l, detection_rate d, blacklisted l, "
                 "inconclusive l, wall_s d",
    "longrun": "policy s, accepted_wrong l, lies_submitted l, tasks l, grants l, tasks_per_worker d, "
               "overhead_overall d, overhead_first_third d, overhead_mid_third d, overhead_last_third d, wall_s d",
    "stragglers": "condition s, run l, tasks l, units l, wall_ms l, units_per_sec d, p50_ms d, p95_ms d, p99_ms d, "
                  "max_ms d, expiries l, cancels l, speculative_grants l, wasted_units l",
    "egress": "workers l, p2p s, egress_bytes l, from_peer l, from_coordinator l, from_cache l, fetches l, "
              "workers_seen l, tasks_done l, rep l",
    "sources": "t_sec d, workers l, peer_total l, coordinator_total l, cache_total l, peer_delta l, "
               "coordinator_delta l, cache_delta l, egress_bytes l",
    "time_to_ready": "workers l, p2p s, n_ready l, never_ready l, median_ms d, mean_ms d, max_ms d, "
                     "median_grant_ms d, from_peer l, from_coordinator l, rep l",
    "sizing_convergence": "worker_id l, task_index l, predicted_ms d, actual_ms d, ratio d, correction d",
}
_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}


def result_schema(name: str) -> T.StructType:
    pairs = [p.split() for p in RESULT_TABLES[name].split(",")]
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in pairs])
