"""Train, save and measure the four variants: ``spark-submit jobs/train.py --traces … --pois … --models … --report …``.

On a cluster set ``spark.checkpoint.dir`` to a folder that all executors share. Malformed records go to ``--quarantine``.
A repeated run replaces its models, report and quarantine.
"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strideflow.plans.training import run_training  # noqa: E402
from strideflow.session import build_session, scratch  # noqa: E402
from strideflow.sources.traces import admit_traces, read_pois  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("traces", "pois", "models", "report", "quarantine"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--format", default="parquet")
    args = parser.parse_args(argv)
    spark = build_session("train")
    rows = spark.read.format(args.format).load(args.traces)
    traces, bad = admit_traces(rows, labelled=True, deduplicate=True)
    bad.write.mode("overwrite").parquet(args.quarantine)
    with scratch(spark, "train"):
        run_training(traces, read_pois(spark, args.pois), args.models).write.mode("overwrite").parquet(args.report)


if __name__ == "__main__":
    main()
