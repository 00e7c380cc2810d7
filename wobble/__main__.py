"""python -m wobble -c settings.yaml"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from wobble.config import load_config
from wobble.errors import WobbleError
from wobble.plans.run import StabilityRun


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wobble", description="How stable is the dimensionality reduction of a genotype matrix?")
    p.add_argument("-c", "--config", required=True, help="YAML file with the run's settings")
    args = p.parse_args(argv)
    try:
        config = load_config(args.config)
        logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(max(config.verbosity, 0), 2)], format="%(asctime)s %(message)s")
        for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # a task has one core
            os.environ.setdefault(name, "1")
        spark = SparkSession.builder.appName("wobble").config("spark.executorEnv.OMP_NUM_THREADS", "1").config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1").getOrCreate()
        run = StabilityRun(spark, config)
        out = run.run()
    except WobbleError as e:
        print(f"wobble: {e}", file=sys.stderr)
        return 1
    print(f"stability {out['stability']:.4f}, cluster stability {out['cluster_stability']:.4f}, {out['n_replicates']} replicates; results in {config.result_dir}")
    print("\n".join(run.result_files()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
