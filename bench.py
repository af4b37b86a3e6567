"""Time the headline queries and print one JSON line.

Each query is run into the ``noop`` sink. One pass over all queries warms the
JVM up, then ``BENCH_RUNS`` passes are timed, and a query's fastest run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
# Runs every other view once more.
LEFT_OUT = {"registered_views"}


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8,
        **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = chosen or [n for n in QUERIES if n not in LEFT_OUT]
    times = dict.fromkeys(names, float("inf"))
    for run in range(RUNS + 1):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if run:
                times[name] = round(min(times[name], time.perf_counter() - start), 4)
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": CPUS,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
