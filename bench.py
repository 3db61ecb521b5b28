"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_QUERIES comma-separated names instead of the headline set, or ``all``
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from emberscope import fixtures  # noqa: E402

HEADLINE = (
    "r1_suspects", "r4_health", "d_details", "k1_distribution", "k3_data_skew", "k6_executor_hotspot",
    "l5_stage_context", "r2_ranked_jobs", "v6_duration_profile", "v7_duration_histogram",
    "v8_executor_breakdown", "v10_skew_metrics", "v13_merge_snapshots", "s1_event_log_scan", "p8_stage_metrics",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = session(cpus)
    rows = fixtures.source(spark, sf_dir, "lineitem").count()
    apart = {  # each from a known state, so that no query pays for them
        "tables_sec": timed(lambda: fixtures.telemetry(spark, sf_dir)),
        "log_writing_sec": timed(lambda: fixtures.event_log(spark, sf_dir)),
        "log_parsing_sec": timed(lambda: fixtures.staged_events(spark, sf_dir)),
    }
    seconds = {
        name: timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        for name in names
    }
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                **apart,
                "task_rows": rows,
                "rows_per_sec": {name: round(rows / max(took, 1e-3)) for name, took in seconds.items()},
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
