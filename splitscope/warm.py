"""Fills the stage store ahead of an analysis: ``python -m splitscope.warm --config C --results R --splits S --metadata M --features a,b``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import load_config
from .plans.pipeline import Result, run_analysis
from .plans.store import Store
from .sources.metadata import sample_datasets
from .sources.splits import SplitRows

log = logging.getLogger("splitscope")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, what in (("config", "YAML file"), ("results", "table of results"), ("splits", "table of training rows with dataset, repeat, fold"), ("metadata", "table of datasets")):
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--features", required=True, help="feature columns of the training rows, separated by commas")
    parser.add_argument("--target")
    scope = parser.add_mutually_exclusive_group()
    scope.add_argument("--datasets", nargs="*", help="only these datasets")
    scope.add_argument("--sample-datasets", type=int, help="a repeatable sample of as many datasets")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--repair", action="store_true", help="compute feature sets again that failed before")
    out = parser.parse_args(argv)
    if out.sample_datasets is not None and out.sample_datasets < 1:
        parser.error("--sample-datasets must be at least 1")
    return out


def warm(spark: SparkSession, args: argparse.Namespace) -> Result:
    config = load_config(args.config)
    if args.repair:
        config = replace(config, descriptors=replace(config.descriptors, retry_failed=True))
    results, rows, metadata = (spark.read.parquet(p) for p in (args.results, args.splits, args.metadata))
    if args.datasets is not None or args.sample_datasets is not None:
        names = spark.createDataFrame([(d,) for d in args.datasets], "dataset string") if args.datasets is not None else sample_datasets(metadata, args.sample_datasets, args.seed)
        results, rows = (t.join(names, "dataset", "left_semi") for t in (results, rows))
    splits = SplitRows(rows, args.features.split(","), args.target, "problem_type" if "problem_type" in rows.columns else None)
    out = run_analysis(config, results, splits, metadata, Store(spark, config.cache.directory))
    log.info("warm: %d gaps, %d described splits", out.gaps.count(), out.descriptors.count())
    return out


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    args = arguments(argv)
    warm(SparkSession.builder.appName("warm").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
