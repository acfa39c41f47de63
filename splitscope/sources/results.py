"""Benchmark results: one row per dataset, split, method and subtype."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Analysis, Config
from ..functions.expressions import finite
from ..schemas import IDENTITY, OPTIONAL


def empty_results(spark: SparkSession, analysis: Analysis) -> DataFrame:
    kinds = ["dataset string", "fold int", "method string", "config_type string", "method_subtype string"]
    return spark.createDataFrame([], ", ".join(kinds + [f"{m} double" for m in analysis.metrics]))


def kept_methods(methods: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Methods whose name holds none of the patterns."""
    return [m for m in methods if not any(p in m for p in patterns)]


def read_results(spark: SparkSession, paths: dict[str, str] | str, config: Config, datasets: DataFrame | Sequence[str] | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """Results of one parquet folder per method, or of one table.

    Excluded methods are never opened; the other filters are predicates that reach the scan."""
    if isinstance(paths, str):
        return select_results(spark.read.parquet(paths), config.analysis, datasets, methods)
    wanted = kept_methods(list(methods) if methods is not None else list(paths), config.analysis.exclude_methods_containing)
    frames = [spark.read.parquet(paths[m]) for m in wanted]
    if not frames:
        return empty_results(spark, config.analysis)
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return select_results(rows, config.analysis, datasets)


def select_results(rows: DataFrame, analysis: Analysis, datasets: DataFrame | Sequence[str] | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """The configured subtypes, datasets and methods; needed and optional columns only; metrics of imputed rows are missing."""
    needed = [*IDENTITY, *analysis.metrics]
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"results lack the columns {missing}")
    rows = rows.select(*needed, *(c for c in OPTIONAL if c in rows.columns)).where(F.col("method_subtype").isin(*analysis.method_variant))
    for p in analysis.exclude_methods_containing:
        rows = rows.where(~F.col("method").contains(p))
    if methods is not None:
        rows = rows.where(F.col("method").isin(*methods))
    if isinstance(datasets, DataFrame):
        rows = rows.join(datasets.select("dataset").distinct(), "dataset", "left_semi")
    elif datasets is not None:
        rows = rows.where(F.col("dataset").isin(*datasets)) if datasets else rows.where("false")
    imputed = F.coalesce(F.col("imputed").cast("boolean"), F.lit(False)) if "imputed" in rows.columns else F.lit(False)
    return rows.withColumns({m: F.when(~imputed, finite(F.col(m))) for m in analysis.metrics})


def decode_splits(rows: DataFrame, folds_per_repeat: int = 3) -> DataFrame:
    """``split_id, repeat, fold`` from the encoded split number in ``fold``."""
    if folds_per_repeat <= 0:
        raise ValueError("folds_per_repeat must be positive")
    split = F.col("fold").cast("int")
    return rows.withColumns({"split_id": split, "repeat": F.floor(split / folds_per_repeat).cast("int"), "fold": F.pmod(split, F.lit(folds_per_repeat)).cast("int")})
