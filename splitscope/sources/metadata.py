"""Task metadata: one row per dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise_metadata(meta: DataFrame) -> DataFrame:
    """``dataset, tid, problem_type, n_repeats, n_folds`` from whichever of the accepted columns exist."""
    have = lambda *names: F.coalesce(*(F.col(n) for n in names if n in meta.columns), F.lit(None))
    if not {"dataset", "name"} & set(meta.columns):
        raise ValueError("metadata lacks a dataset or name column")
    return meta.select(
        have("dataset", "name").cast("string").alias("dataset"), have("tid", "task_id").cast("long").alias("tid"), F.lower(have("problem_type").cast("string")).alias("problem_type"),
        F.coalesce(have("n_repeats").cast("int"), F.lit(1)).alias("n_repeats"), F.coalesce(have("n_folds").cast("int"), F.lit(3)).alias("n_folds"),
    )


def metadata_of(meta: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Rows whose dataset or name is asked for."""
    asked = F.lit(False)
    for c in ("dataset", "name"):
        if c in meta.columns:
            asked = asked | F.coalesce(F.col(c).isin(*datasets), F.lit(False))
    return meta.where(asked)


def without_problem_types(datasets: DataFrame, meta: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Datasets whose metadata names none of the excluded problem types (datasets without metadata stay)."""
    if not excluded:
        return datasets
    gone = normalise_metadata(meta).where(F.col("problem_type").isin(*excluded)).select("dataset").distinct()
    return datasets.join(gone, "dataset", "left_anti")


def splits_of(meta: DataFrame) -> DataFrame:
    """One row per dataset, repeat and fold.  Datasets with several samples in a split are an error."""
    if "n_samples" in meta.columns:  # checked row by row as the plan runs
        only = F.when(F.coalesce(F.col("n_samples").cast("int"), F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a split must have exactly one sample")).cast("boolean"))
        meta = meta.where(only)
    m = normalise_metadata(meta)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return m.where("n_repeats > 0 and n_folds > 0").withColumn("repeat", each("n_repeats")).withColumn("fold", each("n_folds")).select("dataset", "repeat", "fold", "tid", "problem_type")


def problem_types_payload(meta: DataFrame) -> DataFrame:
    """Distinct ``dataset, problem_type`` in order: part of a stage's identity."""
    return normalise_metadata(meta).select("dataset", "problem_type").distinct().orderBy(F.asc_nulls_last("dataset"), F.asc_nulls_last("problem_type"))


def sample_datasets(meta: DataFrame, size: int, seed: int = 0, excluded: Sequence[str] = ()) -> DataFrame:
    """A repeatable sample of datasets, by seeded hash: the operator is a sample, so the limit is its feature."""
    names = normalise_metadata(meta).select("dataset").distinct()
    if excluded:
        names = names.where(~F.col("dataset").isin(*excluded))
    return names.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "dataset")), "dataset").limit(size)
