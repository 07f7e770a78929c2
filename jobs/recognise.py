"""Recognise the latest traces of all users: ``spark-submit jobs/recognise.py --traces … --pois … --models … --results … --run …``.

On a cluster set ``spark.checkpoint.dir`` to a folder that all executors share. The results of a run become
visible as a whole (``read_results`` reads them), and a repeated run replaces them. Malformed records go to ``--quarantine``.
"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strideflow.plans.models import RANDOM_FOREST, load_models  # noqa: E402
from strideflow.plans.recognition import recognise_all  # noqa: E402
from strideflow.session import build_session, scratch  # noqa: E402
from strideflow.sources.traces import admit_traces, read_pois, write_results  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("traces", "pois", "models", "results", "quarantine"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--run", type=int, required=True, help="start of the run in ms")
    parser.add_argument("--algorithm", default=RANDOM_FOREST)
    parser.add_argument("--format", default="parquet")
    args = parser.parse_args(argv)
    spark = build_session("recognise")
    traces, bad = admit_traces(spark.read.format(args.format).load(args.traces), deduplicate=True)
    bad.write.mode("overwrite").parquet(f"{args.quarantine}/run={args.run}")
    models = load_models(args.models, args.algorithm)
    with scratch(spark, "recognise"):
        found = recognise_all(traces, read_pois(spark, args.pois), models, args.run, algorithm=args.algorithm, base=args.models)
        write_results(found, args.results, f"run-{args.run}")


if __name__ == "__main__":
    main()
