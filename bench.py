"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS choose data and cores. One warm-up
and three timed runs per query, results written to the noop sink, median kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tools"))

from check_queries import entry, session  # noqa: E402

HEADLINE = ["run_summary", "worker_throughput", "grant_accept_asof", "correction_history", "coverage_audit", "range_search",
            "reference_check", "quorum_exact", "quorum_tolerant", "reputation_history", "compare_tolerant",
            "blob_reassembly", "range_lookup", "peers_holding", "mosaic", "compact_changelog", "lifecycle", "timeline",
            "compare_statistical", "carve_ranges", "speculation_candidates", "stream_lifecycle", "stream_timeline"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = session(cpus, int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in only:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            entry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
