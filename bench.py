"""Time the headline queries: one warm-up, then the median of up to three runs, forced by a noop write.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``; prints one JSON line.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strideflow import catalog  # noqa: E402
from strideflow.catalog import QUERIES  # noqa: E402
from strideflow.plans import models, recognition  # noqa: E402
from strideflow.session import build_session  # noqa: E402

HEADLINE = [
    "latest_traces", "st_neighbours", "st_dbscan", "gap_segments", "anchored_windows", "features_basic",
    "motion_features", "poi_counts", "poi_tf", "features_location_aware", "training_set", "features_clustered",
    "recognise_all",
]
RUNS = 3
# A query that has taken this many seconds after its warm-up is not repeated further.
ENOUGH_SECONDS = 15.0


def recogniser(spark, sf_dir):
    """Recognition with trees that were trained before the clock starts."""
    trees = catalog._period_trees_as_data(spark, sf_dir)

    def run(spark, sf_dir):
        traces, pois = catalog.traces_view(spark, sf_dir), catalog.poi_view(spark, sf_dir)
        return recognition.recognise_all(traces, pois, trees, catalog.RUN_START, algorithm=models.DECISION_TREE)

    return run


# Queries whose preparation is not timed.
PREPARED = {"recognise_all": recogniser}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false",
        # Small tables on one machine: let every core have a share of them.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    n_samples = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        runs = []
        query = PREPARED[name](spark, sf_dir) if name in PREPARED else QUERIES[name]
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if sum(runs[1:]) > ENOUGH_SECONDS:
                break
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "samples": n_samples, "samples_per_sec": {q: round(n_samples / t) for q, t in times.items()},
    }))


if __name__ == "__main__":
    main()
