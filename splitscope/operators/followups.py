"""Follow-up diagnostics on one-row-per-dataset tables: adjusted fits, collinearity, verdicts and plot tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_number
from .features import strong_pairs
from .kernels import rho_for_p, rho_for_power
from .leastsquares import matrix_rank, ols_models
from .ranks import rank_correlations

__all__ = ["adjusted_change", "association_summary", "detectable_rho", "error_table", "frame_summary", "high_pairs", "hypothesis_verdicts", "interpretation", "matrix_rank", "nominal", "ols_models", "scatter_table", "scenario_difference"]
HIGH_PAIR = 0.7


def adjusted_change(fits: DataFrame, base: str, full: str) -> DataFrame:
    """How much the adjusted R2 grows from one model to the other."""
    one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return fits.agg(one(base, "adjusted_r2").alias("base_adjusted_r2"), one(full, "adjusted_r2").alias("full_adjusted_r2"), one(full, "max_vif").alias("max_vif")).withColumn("change", F.col("full_adjusted_r2") - F.col("base_adjusted_r2"))


def high_pairs(long: DataFrame, threshold: float = HIGH_PAIR, unit: str = "dataset") -> DataFrame:
    return strong_pairs(rank_correlations(long, unit), threshold)


def interpretation(fits: DataFrame, associations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per feature: univariate and adjusted direction, whether they agree, and the features that say nearly the same."""
    both = pairs.select(F.col("a").alias("feature"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("feature"), F.col("a").alias("other")))
    twins = both.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("other")), ", ").alias("redundant_with"))
    sign = lambda c: F.when(F.col(c) > 0, "positive").when(F.col(c) < 0, "negative").when(F.col(c) == 0, "zero").otherwise("unknown")
    rows = associations.select("feature", "spearman_r").join(fits.select(F.col("predictor").alias("feature"), "coefficient"), "feature", "left").join(twins, "feature", "left")
    rows = rows.withColumns({"univariate_direction": sign("spearman_r"), "adjusted_direction": sign("coefficient")})
    return rows.withColumn("directions_agree", F.col("univariate_direction") == F.col("adjusted_direction"))


def hypothesis_verdicts(hypotheses: DataFrame, tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Hypotheses (``feature, expected_sign``) against the tested associations."""
    rows = hypotheses.join(tested.select("feature", "spearman_r", "p_value", "p_value_bh"), "feature", "left")
    agrees = F.signum("spearman_r") == F.signum("expected_sign")
    verdict = F.when(F.col("spearman_r").isNull(), "not_tested").when(agrees & (F.col("p_value_bh") < alpha), "supported").when(agrees & (F.col("p_value") < alpha), "nominally_supported").when(agrees, "same_direction").when(F.col("p_value_bh") < alpha, "contradicted").otherwise("opposite_direction")
    return rows.withColumn("verdict", verdict)


def scatter_table(table: DataFrame, feature: str, target: str = "delta_norm") -> DataFrame:
    """``dataset, x, y`` of the complete rows."""
    return table.select("dataset", as_number(table.schema[feature]).alias("x"), as_number(table.schema[target]).alias("y")).where("x is not null and y is not null")


def scenario_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two runs side by side with the change of each value."""
    a = left.select(*keys, *(F.col(v).alias(f"{v}_left") for v in values))
    b = right.select(*keys, *(F.col(v).alias(f"{v}_right") for v in values))
    return a.join(b, list(keys)).withColumns({f"{v}_change": F.col(f"{v}_right") - F.col(f"{v}_left") for v in values})


def detectable_rho(n: int, alpha: float = 0.05, power: float = 0.8) -> dict[str, float]:
    """The least significant correlation, and the one found with the given power."""
    return {"rho_significant": rho_for_p(n, alpha), "rho_power": rho_for_power(n, alpha, power)}


def frame_summary(table: DataFrame) -> DataFrame:
    """Rows, columns and datasets of a table."""
    units = F.count_distinct("dataset") if "dataset" in table.columns else F.lit(None).cast("long")
    return table.agg(F.count(F.lit(1)).alias("rows"), units.alias("datasets")).withColumn("columns", F.lit(len(table.columns)))


def association_summary(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Counts of tested, nominally significant and corrected associations."""
    some = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return tested.agg(F.count(F.lit(1)).alias("n_features"), F.count("p_value").alias("n_tested"), some(F.col("p_value") < alpha).alias("n_nominal"), some(F.col("p_value_bh") < alpha).alias("n_corrected"))


def nominal(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tested.where(F.col("p_value") < alpha).orderBy("p_value", "feature")


def error_table(predictions: DataFrame) -> DataFrame:
    """The table behind the error plots: absolute errors and signs per model and dataset, with the model's place by mean error."""
    rows = predictions.withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    mean = rows.groupBy("model").agg(F.avg("abs_error").alias("mae"))
    order = mean.withColumn("place", F.row_number().over(Window.orderBy(F.round("mae", 12), "model")))  # one row per model
    return rows.join(F.broadcast(order), "model").select("model", "place", "dataset", "y_true", "y_pred", "abs_error", F.when(F.col("y_true") != 0, F.signum("y_true") == F.signum("y_pred")).alias("sign_correct"))
