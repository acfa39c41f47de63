"""Pairwise gaps: the best method of each family per split, chosen on one metric and scored on another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Comparison, Family
from ..schemas import GAP_COLUMNS, GAP_SCHEMA
from ..sources.results import decode_splits

_SPEC = "comparison_name string, group_a_name string, group_b_name string, group_a_label string, group_b_label string, expected_direction string, side string, config_type string"
_NAMES = [x.split()[0] for x in _SPEC.split(", ")][:6]


def normalised_error(error: Column, task) -> Column:
    """0 at the best error of the task (a window), 1 at its median and beyond."""
    low, mid = F.min(error).over(task), F.percentile(error, F.lit(0.5)).over(task)
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(error - low, mid - low)))
    return F.when(error.isNull(), None).when(mid > low, F.round(inside, 12)).when(error == low, F.lit(0.0)).otherwise(F.lit(1.0))


def members(spark: SparkSession, comparisons: Sequence[Comparison]) -> DataFrame:
    """One row per comparison, side and config type: as small as the configuration."""
    rows = [(c.name, c.a.name, c.b.name, c.a.label, c.b.label, c.expected_direction, side, t) for c in comparisons for side, g in (("a", c.a), ("b", c.b)) for t in sorted(g.config_types)]
    return spark.createDataFrame(rows, _SPEC)


def candidates(results: DataFrame, comparisons: Sequence[Comparison], error: str = "metric_error", selection: str | None = None, folds_per_repeat: int = 3) -> DataFrame:
    """Every result that competes for a side of a comparison, with both metrics raw and normalised.

    All methods of a split take part in the normalisation, whatever their family.  A config type of several families competes in
    each."""
    selection = selection or error
    task = Window.partitionBy("dataset", "split_id")
    rows = decode_splits(results, folds_per_repeat)
    rows = rows.withColumn("sel_norm", normalised_error(F.col(selection), task))
    rows = rows.withColumn("eval_norm", F.col("sel_norm") if selection == error else normalised_error(F.col(error), task))
    rows = rows.select("dataset", "split_id", "repeat", "fold", "method", "method_subtype", "config_type", F.col(selection).alias("sel"), F.col(error).alias("eval"), "sel_norm", "eval_norm")
    complete = rows.where("sel is not null and eval is not null and sel_norm is not null and eval_norm is not null")
    return complete.join(F.broadcast(members(results.sparkSession, comparisons)), "config_type")


def _best(found: DataFrame) -> DataFrame:
    """``best_a, best_b`` per split and comparison.  The keys hold those of the normalisation, so nothing is shuffled again."""
    entry = F.struct("sel_norm", "sel", "method", "method_subtype", "eval", "eval_norm")
    best = lambda s: F.min(F.when(F.col("side") == s, entry)).alias(f"best_{s}")
    return found.groupBy("dataset", "split_id", "repeat", "fold", *_NAMES).agg(best("a"), best("b"))


def pairwise_gaps(results: DataFrame, comparisons: Sequence[Comparison], error: str = "metric_error", selection: str | None = None, folds_per_repeat: int = 3) -> DataFrame:
    """The gap table: positive gaps mean that family a is worse.  Splits without a candidate on either side are left out."""
    if not comparisons:
        return results.sparkSession.createDataFrame([], GAP_SCHEMA)
    found = _best(candidates(results, comparisons, error, selection, folds_per_repeat)).where("best_a is not null and best_b is not null")
    for s in "ab":
        found = found.withColumns({f"best_{s}_method": F.col(f"best_{s}.method"), f"best_{s}_error": F.col(f"best_{s}.eval"), f"best_{s}_norm_error": F.col(f"best_{s}.eval_norm")})
    found = found.withColumns({"delta_raw": F.col("best_a_error") - F.col("best_b_error"), "delta_norm": F.col("best_a_norm_error") - F.col("best_b_norm_error")})
    return found.select(*GAP_COLUMNS)


def best_in_family(results: DataFrame, family: Family, error: str = "metric_error", selection: str | None = None, folds_per_repeat: int = 3) -> DataFrame:
    """``dataset, repeat, fold, method, error, norm_error``: the best member of one family per split."""
    found = _best(candidates(results, [Comparison("best", family, family)], error, selection, folds_per_repeat))
    return found.select("dataset", "repeat", "fold", F.col("best_a.method").alias("method"), F.col("best_a.eval").alias("error"), F.col("best_a.eval_norm").alias("norm_error"))


def missing_families(results: DataFrame, comparisons: Sequence[Comparison], error: str = "metric_error", selection: str | None = None, folds_per_repeat: int = 3, examples: int = 3) -> DataFrame:
    """``comparison_name, group_name, n_missing, examples``: splits where one side has a candidate and the other has none."""
    found = _best(candidates(results, comparisons, error, selection, folds_per_repeat)).where("best_a is null or best_b is null")
    rows = found.select("comparison_name", F.when(F.col("best_a").isNull(), F.col("group_a_name")).otherwise(F.col("group_b_name")).alias("group_name"), "dataset", "repeat", "fold")
    key = ["comparison_name", "group_name"]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("dataset", "repeat", "fold"))).where(F.col("nth") <= examples)
    shown = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "dataset", "repeat", "fold"))), lambda x: F.concat(x["dataset"], F.lit("/r"), x["repeat"].cast("string"), F.lit("/f"), x["fold"].cast("string"))), ", ").alias("examples"))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_missing")).join(shown, key)


def absent_members(results: DataFrame, families: dict[str, Family]) -> DataFrame:
    """``group_name, config_type`` of configured types that the results do not hold."""
    rows = [(g.name, t) for g in families.values() for t in sorted(g.config_types)]
    wanted = results.sparkSession.createDataFrame(rows, "group_name string, config_type string")
    return wanted.join(results.select("config_type").distinct(), "config_type", "left_anti").select("group_name", "config_type")


def value_counts(results: DataFrame, *columns: str) -> DataFrame:
    return results.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Splits, mean, deviation and extremes of the normalised gap per comparison and dataset."""
    d = F.col("delta_norm")
    return gaps.groupBy("comparison_name", "dataset").agg(F.count(F.lit(1)).alias("n_splits"), F.avg(d).alias("delta_mean"), F.stddev_samp(d).alias("delta_std"), F.min(d).alias("delta_min"), F.max(d).alias("delta_max"), F.avg((d > 0).cast("double")).alias("a_worse_share"))
