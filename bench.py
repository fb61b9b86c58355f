"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

QUERIES = (
    "coverage_intervals header_stats range_scan_device nan_fill_grid interval_union interval_intersection interval_difference build_from_measures_union sample_patients map_sources asof_history "
    "labels_with_patient label_raster label_threshold window_enumerate window_values window_counts window_filtered window_patient_asof dedup_last_wins overwrite_merge detect_period entropy_by_measure stream_windows"
).split()


def main() -> None:
    from pulsegrid.plans import registry
    from pulsegrid.session import session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found, taken = registry.queries(), {}
    for name in QUERIES:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        taken[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries, better of two runs each", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
