"""The analysis table: gaps joined with descriptors, at split or dataset level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_numeric, std_error, strict_mean
from ..schemas import GAP_NUMBERS, GROUP, IRREGULARITY, SPLIT
from .irregularity import COMPOSITE, composite


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df``, after a job that raises if a key repeats (with at most ten examples)."""
    bad = repeated_keys(df, keys).limit(10).collect()
    if bad:
        raise ValueError(f"{name}: repeated keys {[tuple(r)[:-1] for r in bad]}")
    return df


def joined(gaps: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Gaps of splits that have descriptors."""
    return descriptors.join(gaps, SPLIT)


def dataset_level(gaps: DataFrame, descriptors: DataFrame, components: Sequence[str] = tuple(IRREGULARITY)) -> DataFrame:
    """One row per dataset and comparison: mean gaps with deviation and standard error, strict means of the descriptors, and the
    composite of unique datasets."""
    features = [f.name for f in descriptors.schema.fields if is_numeric(f.dataType) and f.name not in SPLIT and f.name != COMPOSITE]
    spread = [g(c).alias(f"{c}_{n}") for c in ("delta_raw", "delta_norm") for n, g in (("std", lambda c: F.stddev_samp(c)), ("sem", lambda c: std_error(F.col(c))))]
    table = joined(gaps, descriptors).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_splits"), *(F.avg(c).alias(c) for c in GAP_NUMBERS), *spread, *(strict_mean(F.col(f)).alias(f) for f in features))
    if not any(c in features for c in components):
        return table
    return table.join(_composites(table, components), "dataset", "left")


def _composites(table: DataFrame, components: Sequence[str]) -> DataFrame:
    """``dataset, irregularity``: datasets count once, however many comparisons they take part in."""
    have = [c for c in components if c in table.columns]
    first = table.groupBy("dataset").agg(F.min(F.struct(*GROUP[1:], *have)).alias("one")).select("dataset", *(F.col(f"one.{c}").alias(c) for c in have))
    return composite(first, have).select("dataset", COMPOSITE)


def split_level(gaps: DataFrame, descriptors: DataFrame, components: Sequence[str] = tuple(IRREGULARITY)) -> DataFrame:
    """One row per split and comparison; the composite is that of the dataset.  Splits of a dataset are not independent."""
    rows = joined(gaps, descriptors.drop(COMPOSITE))
    if not any(c in descriptors.columns for c in components):
        return rows
    return rows.join(_composites(dataset_level(gaps, descriptors, ()), components), "dataset", "left")


def analysis_table(gaps: DataFrame, descriptors: DataFrame, unit: str = "dataset", components: Sequence[str] = tuple(IRREGULARITY)) -> DataFrame:
    return split_level(gaps, descriptors, components) if unit == "fold" else dataset_level(gaps, descriptors, components)


def with_task_type(table: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds ``task_type`` from the metadata (one row per dataset)."""
    kinds = metadata.groupBy("dataset").agg(F.min(F.lower("problem_type")).alias("task_type"))
    return table.join(kinds, "dataset", "left")


def with_unit(table: DataFrame, *columns: str) -> DataFrame:
    """Adds ``unit``, the id of the unit of analysis."""
    return table.withColumn("unit", F.concat_ws("|", *columns))


def gaps_with_descriptors(gaps: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Every gap row, with descriptors where there are any: the table of the split-level export."""
    return gaps.join(descriptors, SPLIT, "left")
