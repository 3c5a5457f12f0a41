"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores. Every query is
run once to warm up the code paths on the smallest tables, then timed once in full (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rulelens.plans.catalog import QUERIES  # noqa: E402
from rulelens.session import local_session  # noqa: E402

HEADLINE = (
    "j4_all_contributors",
    "j5_contributor_results",
    "j9_snapshot_diff",
    "a8_approval",
    "a9_contributor_totals",
    "a14_activity_month",
    "a18_task_rules",
    "w3_nearest_chunks",
    "w4_layers_last",
    "w8_rolling_calls",
    "w9_evaluation_numbers",
    "w10_report_lines",
    "x8_parse_response",
    "d1_chunks",
    "d7_incremental_index",
    "d9_file_contexts",
    "d10_whole_check",
    "d11_joined_cross_check",
    "r1_admission",
    "r2_task_state",
)
WARM = "/root/testdata/sf0.001"


def run(spark, name: str, folder: str) -> float:
    start = time.monotonic()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_PARTITIONS", "8")), "rulelens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM):
        for name in HEADLINE:
            run(spark, name, WARM)
    times = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    chunks = QUERIES["d1_chunks"](spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "chunks_per_second": {n: round(chunks / times[n], 1) for n in ("d7_incremental_index", "d10_whole_check")},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
