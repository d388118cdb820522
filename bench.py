"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query.
Each query is run once to warm up and then timed into a sink that discards rows; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pingtrail.plans.catalog import REGISTRY  # noqa: E402
from pingtrail.session import build_session  # noqa: E402

HEADLINE = [
    "Q1_multi_tower_by_time_of_day",
    "Q2_A6_event_centroids",
    "Q3_departure_inference",
    "Q4_simultaneous_with_sun",
    "Q5_A8_vanishing_bearing",
    "Q6_activity_budget",
    "Q7_localisation_and_movement",
    "Q8_deployment_audit",
    "Q9_quality_report",
    "W1_sessionize",
    "W3_station_transitions",
    "A10_resampled_beeps",
    "J9_interval_join",
    "L3_X7_time_to_sun",
    "M4_group_quantiles",
]


def exchanges(df) -> int:
    """Shuffles of the plan as submitted, before reuse."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "pingtrail-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, shuffles, rows = {}, {}, {}
    for name in sys.argv[1:] or HEADLINE:
        build = REGISTRY[name].run
        df = build(spark, folder)
        shuffles[name], rows[name] = exchanges(df), df.count()
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            build(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], rows[name], shuffles[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "exchanges": shuffles,
        "sf": float(sf.group(1)) if sf else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
