"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (``all`` or a comma list) other queries. Each query runs once
to warm up and then ``BENCH_RUNS`` times; the median counts. A run covers
planning and computing the whole result, which goes to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from reviewflow.plans.queries import queries
from reviewflow.session import build_session, clear_work

HEADLINE = (
    "sentiment_summary latest_prediction decide_class_bias prediction_events event_envelope validate_event "
    "validate_prediction_event route_by_topic dead_letters clean_corpus clean_report stratified_split "
    "length_profile head_tail eval_metrics grid_class_bias grid_thresholds calibration_report "
    "ensemble_sweep insert_if_absent scored_predictions quarantine_split history_table stream_history text_classifier"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registered = queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(registered) if chosen == "all" else chosen.split(",") if chosen else HEADLINE

    spark = build_session(f"local[{cpus}]", "bench")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            clear_work(spark)
        times[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    total = round(sum(times.values()), 4)
    print(json.dumps({
        "metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
