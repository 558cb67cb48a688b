"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose the
input and the size of the local session.  Each query runs once to warm up and then
BENCH_REPEATS times (default 3); the median counts.  A run plans the query and writes all
of its rows to the no-op sink, so nothing is optimised away or shipped to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shiftlens.plans.catalogue import all_queries  # noqa: E402
from shiftlens.session import build_session  # noqa: E402

HEADLINES = [
    "daily_kpi",
    "top_performers",
    "client_profitability",
    "vehicle_efficiency",
    "monthly_trends",
    "kpi_summary",
    "validate_all",
    "overlapping_punches",
    "travel_mismatch",
    "daily_performance",
    "health_scores",
    "find_duplicates",
    "near_repeats",
    "mark_exact_duplicates",
    "lineitem_first_wins",
    "document_copies",
    "resolve_people",
    "review_queue",
    "upsert_daily_kpi",
    "integrity_summary",
    "load_timesheets",
    "load_activities",
    "load_calendar",
    "load_vehicle_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        cpus,
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-checkpoint-"),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.sql.codegen.cache.maxEntries": "1000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    times: dict[str, float] = {}
    for name in wanted:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
