"""Sensitivity: do robust features keep their sign beside fixed controls in a rank regression?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_number, average_rank, correlation, resample_index
from ..sources.scratch import written
from .associations import ALPHA, LEAST_REPLICATES, MIN_N, REPEATS, SEED, SIGN_LIMIT, assert_one_row_per_unit
from .features import complete_cases
from .leastsquares import rank_fits

MAX_FEATURES, MAX_PREDICTORS = 3, 8
# Controls and the column names under which they may come.
GENERAL_CONTROLS = (("n_samples", ("n_samples", "n_instances", "n_rows", "n")), ("n_features", ("n_features", "n_columns", "n_attrs", "n_attr", "d")), ("feature_sample_ratio", ("d_over_n", "n_features_over_n_samples", "features_per_sample")))
CLASS_CONTROLS = (("n_classes", ("n_classes", "nr_classes")), ("class_imbalance_ratio", ("class_imbalance_ratio", "imbalance_ratio", "majority_minority_ratio")))
LOG_CONTROLS = (("log_n", ("log_n",)), ("log_d", ("log_d",)), ("d_over_n", ("d_over_n",)), ("cat_fraction", ("cat_fraction",)), ("feature_missing_fraction", ("feature_missing_fraction",)))
_CONTROL = "control string, source_column string, model_column string, included boolean, reason string"
_PARTIAL = "feature string, n long, rho double, partial_rho double"
RESULT = "analysis_table string, feature string, feature_family string, n int, univariate_spearman_rho double, adjusted_rank_coefficient double, adjusted_ci_low double, adjusted_ci_high double, adjusted_bootstrap_sign_consistency double, adjusted_bootstrap_repeats long, adjusted_direction_matches_univariate boolean, adjusted_direction_stable boolean, predictors_in_model int, controls_in_model string, condition_number double"


def feature_family(feature):
    """External features are one family per raw feature; others are their own."""
    return F.when(feature.startswith("pymfe__"), F.substring_index(feature, ".", 1)).otherwise(feature)


def family_representatives(robust: DataFrame, max_features: int) -> DataFrame:
    """``feature, feature_family, selection_status, nth``: the strongest feature of each family, as many as the model may hold."""
    order = [F.desc(F.round("abs_spearman_rho", 12)), F.desc("bootstrap_sign_consistency"), F.asc("feature")]
    rows = robust.withColumn("feature_family", feature_family(F.col("feature"))).withColumn("place", F.row_number().over(Window.partitionBy("feature_family").orderBy(*order)))
    first = rows.where("place = 1").withColumn("nth", F.row_number().over(Window.orderBy(*order))).select("feature_family", "nth")  # one row per family
    out = rows.join(first, "feature_family")
    chosen = F.col("nth") <= max_features
    status = F.when(chosen & (F.col("place") == 1), "selected").when(chosen, "same_family_as_selected").otherwise("excluded_by_model_cap")
    return out.select("feature", "feature_family", status.alias("selection_status"), "nth")


def available_controls(table: DataFrame, candidates=GENERAL_CONTROLS, min_n: int = MIN_N) -> list[tuple]:
    """Control, source column, model column, included, reason: decided by one aggregation over the first present alias of each."""
    present = {c: next((a for a in names if a in table.columns), None) for c, names in candidates}
    cols = {c: as_number(table.schema[a]) for c, a in present.items() if a}
    r = table.agg(*(x for c, v in cols.items() for x in (F.count(v).alias(f"n_{c}"), (F.min(v) < F.max(v)).alias(f"v_{c}")))).first() if cols else None
    out = []
    for c, a in present.items():
        if a is None:
            out.append((c, None, None, False, "not_available"))
        elif r[f"n_{c}"] < min_n or not r[f"v_{c}"]:
            out.append((c, a, None, False, "insufficient_variation_or_n"))
        else:
            out.append((c, a, f"control__{c}", True, "fixed_a_priori"))
    return out


def rank_zscores(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z-scores of their average ranks; NULL throughout a constant column."""
    ranked = table
    for k, c in enumerate(columns):
        ranked = ranked.withColumn(f"__r{k}", average_rank(c))
    numbers = range(len(columns))
    one = ranked.agg(*(F.avg(f"__r{k}").alias(f"__m{k}") for k in numbers), *(F.nullif(F.stddev_pop(f"__r{k}"), F.lit(0.0)).alias(f"__s{k}") for k in numbers))
    z = {c: F.try_divide(F.col(f"__r{k}") - F.col(f"__m{k}"), F.col(f"__s{k}")) for k, c in enumerate(columns)}
    return ranked.crossJoin(F.broadcast(one)).withColumns(z).drop(*(f"__{x}{k}" for k in numbers for x in "rms"))  # one row


def bootstrap_fits(rows: DataFrame, predictors: Sequence[str], target: str, seed: int, repeats: int = REPEATS, min_n: int = MIN_N) -> DataFrame:
    """``rep, predictor, coefficient, n, predictors, condition``: the fit of the rows (rep -1) and of each resample, from sums of rank products."""
    pos = F.row_number().over(Window.orderBy("dataset")) - 1  # one row per dataset
    data = written(rows.select("dataset", target, *predictors).withColumns({"pos": pos.cast("long"), "size": F.count(F.lit(1)).over(Window.partitionBy())}), "resampled")
    grid = data.select("pos", "size", F.explode(F.sequence(F.lit(-1), F.lit(repeats - 1))).alias("rep"))
    index = F.when(F.col("rep") < 0, F.col("pos")).otherwise(resample_index(F.col("size"), F.lit(seed), F.col("rep"), F.col("pos")))
    times = grid.groupBy("rep", index.cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("times"))
    return rank_fits(times.join(data.drop("size", "dataset"), "pos"), predictors, target, min_n)


def sensitivity(table: DataFrame, robust: DataFrame, name: str, target: str = "delta_norm", controls_from: DataFrame | None = None, classification: bool = False, candidates=GENERAL_CONTROLS, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The adjusted coefficients of the chosen features, the feature report and the control report."""
    spark = table.sparkSession
    # tables of one row per dataset or feature that several jobs read: written so that the plan below them runs once
    table, robust = written(table, "analysis"), written(robust, "robust")
    source = table if controls_from is None else written(controls_from, "controls")
    assert_one_row_per_unit(table, name)
    if controls_from is not None:
        assert_one_row_per_unit(source, f"{name} controls")
    controls = available_controls(source, (*candidates, *(CLASS_CONTROLS if classification else ())))
    used = [(a, m) for _, a, m, ok, _ in controls if ok]
    room = max(0, min(MAX_FEATURES, MAX_PREDICTORS - len(used)))
    report = family_representatives(robust, room)
    chosen = [r["feature"] for r in report.where("selection_status = 'selected'").orderBy("nth").collect()]  # at most MAX_FEATURES
    control_report = spark.createDataFrame(controls, _CONTROL).withColumn("analysis_table", F.lit(name))
    report = report.drop("nth").withColumn("analysis_table", F.lit(name))
    missing = [f for f in chosen if f not in table.columns]
    if missing:
        raise KeyError(f"{name} has no columns {missing}")
    if not chosen:
        return spark.createDataFrame([], RESULT), report, control_report
    extra = source.select("dataset", *(as_number(source.schema[a]).alias(m) for a, m in used))
    predictors = [*chosen, *(m for _, m in used)]
    clean = complete_cases(table.select("dataset", target, *chosen).join(extra, "dataset", "left"), [target, *predictors])
    fits = bootstrap_fits(clean, predictors, target, seed + sum((k + 1) * ord(c) for k, c in enumerate(name)), repeats)
    fits = written(fits, "fits")
    whole = fits.where("rep = -1").select("predictor", F.col("coefficient").alias("observed"), "n", "predictors", "condition")
    if whole.isEmpty():
        raise ValueError(f"{name}: too few complete cases for the model")
    q = F.percentile("coefficient", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2)))
    boots = fits.where("rep >= 0").join(whole.select("predictor", "observed"), "predictor").groupBy("predictor").agg(F.count(F.lit(1)).alias("k"), q.alias("q"), F.avg((F.signum("coefficient") == F.signum("observed")).cast("double")).alias("same"), F.max("observed").alias("o"))
    enough = lambda c: F.when((F.col("k") >= LEAST_REPLICATES) & (F.col("o") != 0), c)
    rho = robust.select(F.col("feature").alias("predictor"), F.col("spearman_rho").alias("rho"))
    inside = F.array_join(F.array(*(F.lit(m) for _, m in used)), ", ") if used else F.lit("")
    out = whole.join(boots, "predictor", "left").join(rho, "predictor").where(F.col("predictor").isin(*chosen))
    matches = F.signum("observed") == F.signum("rho")
    return out.select(
        F.lit(name).alias("analysis_table"), F.col("predictor").alias("feature"), feature_family(F.col("predictor")).alias("feature_family"), "n", F.col("rho").alias("univariate_spearman_rho"), F.col("observed").alias("adjusted_rank_coefficient"),
        enough(F.col("q")[0]).alias("adjusted_ci_low"), enough(F.col("q")[1]).alias("adjusted_ci_high"), enough(F.col("same")).alias("adjusted_bootstrap_sign_consistency"), F.coalesce("k", F.lit(0)).alias("adjusted_bootstrap_repeats"),
        matches.alias("adjusted_direction_matches_univariate"), F.coalesce(matches & (enough(F.col("same")) >= SIGN_LIMIT), F.lit(False)).alias("adjusted_direction_stable"), F.col("predictors").alias("predictors_in_model"), inside.alias("controls_in_model"), F.col("condition").alias("condition_number"),
    ), report, control_report


def residual_rank_correlation(table: DataFrame, feature: str, controls: Sequence[str], target: str = "delta_norm") -> DataFrame:
    """``feature, n, rho, partial_rho``: the rank correlation before and after both sides lose what the controls' ranks explain."""
    clean = written(complete_cases(table, [target, feature, *controls]).select("dataset", target, feature, *controls), "ranked")  # read by two jobs
    names = [target, feature, *controls]
    z = rank_zscores(clean, names)
    # all sums of products are one row: the residuals of both sides come from the normal equations of the controls' ranks
    sums = z.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), F.count(F.lit(1)).alias("n")).first()
    s = lambda i, j: sums[f"s{min(i, j)}_{max(i, j)}"]
    live = [k for k in range(2, len(names)) if s(k, k)]  # constant controls explain nothing
    flat = not s(0, 0) or not s(1, 1)
    solve = lambda k: np.linalg.lstsq(np.array([[s(i, j) for j in live] for i in live]), np.array([s(i, k) for i in live]), rcond=None)[0] if live else []
    rest = lambda k: F.round(F.col(names[k]) - sum((F.lit(float(b)) * F.col(names[c]) for c, b in zip(live, solve(k), strict=True)), F.lit(0.0)), 12)
    spark = table.sparkSession
    if flat:
        return spark.createDataFrame([(feature, sums["n"], None, None)], _PARTIAL)
    left = z.select(rest(0).alias("x"), rest(1).alias("y")).select(average_rank("x").alias("rx"), average_rank("y").alias("ry"))  # one row per dataset
    varies = F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), correlation(F.col("rx"), F.col("ry")))
    return left.agg(varies.alias("partial_rho")).select(F.lit(feature).alias("feature"), F.lit(sums["n"]).cast("long").alias("n"), F.lit(float(s(0, 1))).alias("rho"), "partial_rho")
