"""Predictive models: every dataset is predicted by models trained on all others."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_number, average_rank, correlation, resample_index
from ..schemas import CONTEXT
from .associations import assert_one_row_per_unit
from .features import long_form, usable
from .kernels import predict, spearman
from .sensitivity import CLASS_CONTROLS, GENERAL_CONTROLS

MIN_N = 30
TOP_COEFFICIENTS = 20
CHUNKS = 16  # groups of held-out datasets per model
_PREDICTION = "model string, model_family string, dataset string, y_true double, y_pred double, alpha double, coefficients array<double>"


def control_columns(table: DataFrame, classification: bool, fit: set[str]) -> tuple[list[str], DataFrame]:
    """The first usable alias of each control, and the report."""
    rows = [(c, next((a for a in names if a in table.columns and a in fit), None)) for c, names in (*GENERAL_CONTROLS, *(CLASS_CONTROLS if classification else ()))]
    report = table.sparkSession.createDataFrame([(c, a, a is not None) for c, a in rows], "control string, selected_column string, available boolean")
    return [a for _, a in rows if a], report


def model_specs(features: Sequence[str], controls: Sequence[str], robust: Sequence[str] = (), boosted: bool = True) -> list[tuple[str, str, list[str]]]:
    """``(model, family, predictors)``: the mean, and each family on controls, features and both (robust features too, where given)."""
    specs = [("mean_baseline", "mean", [])]
    if controls:
        specs.append(("ridge_controls", "ridge", [*controls]))
    sets = [("meta_features", [*features])] + ([("robust_features", [*robust])] if robust else [])
    for family, label in (("ridge", "ridge"), ("tree", "decision_tree"), *((("stumps", "boosted_stumps"),) if boosted else ())):
        for name, cols in sets:
            specs.append((f"{label}_{name}", family, cols))
            if controls:
                specs.append((f"{label}_controls_plus_{name}", family, [*controls, *(c for c in cols if c not in controls)]))
    return specs


def leave_one_out(table: DataFrame, specs: Sequence[tuple[str, str, list[str]]], target: str = "delta_norm", chunks: int = CHUNKS) -> DataFrame:
    """Predictions of every dataset for every model.

    Each (model, chunk) group holds the matrix of all datasets - one row per dataset, as wide as its predictors - and predicts its share of them, so
    models and folds run in parallel and nothing passes through the driver."""
    spark = table.sparkSession
    columns = sorted({c for _, _, p in specs for c in p})
    at = {c: k for k, c in enumerate(columns)}
    y = as_number(table.schema[target])
    data = table.select(F.col("dataset").cast("string").alias("dataset"), y.alias("y"), F.array(*(as_number(table.schema[c]) for c in columns)).cast("array<double>").alias("x")).where("y is not null")
    grid = spark.createDataFrame([(m, f, [at[c] for c in p], k) for m, f, p in specs for k in range(chunks)], "model string, model_family string, columns array<int>, chunk int")
    rows = data.withColumn("mine", F.pmod(F.crc32("dataset"), F.lit(chunks)).cast("int"))
    rows = rows.withColumn("model", F.explode(F.array(*(F.lit(m) for m, _, _ in specs)))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = rows.join(F.broadcast(grid), ["model", "chunk"])  # as small as the specification

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dataset", kind="stable")
        use = np.array(pdf["columns"].iloc[0], dtype=int)
        x = np.array([np.array([np.nan if v is None else v for v in r], dtype=float)[use] for r in pdf["x"]]).reshape(len(pdf), len(use))
        y, names, chunk = pdf["y"].to_numpy(float), pdf["dataset"].to_numpy(), pdf["chunk"].iloc[0]
        model, family, out = pdf["model"].iloc[0], pdf["model_family"].iloc[0], []
        for k in np.flatnonzero(pdf["mine"].to_numpy() == chunk).tolist():
            rest = np.arange(len(y)) != k
            if not rest.any():
                continue
            p, alpha, coef = predict(family, x[rest], y[rest], x[k : k + 1])
            out.append((model, family, names[k], y[k], float(p[0]), None if np.isnan(alpha) else alpha, None if coef is None else coef.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PREDICTION.split(", ")])

    return rows.groupBy("model", "chunk").applyInPandas(run, _PREDICTION)


def coefficients(predictions: DataFrame, specs: Sequence[tuple[str, str, list[str]]]) -> DataFrame:
    """``model, held_out_dataset, predictor, coefficient, alpha`` of the models that have coefficients."""
    names = predictions.sparkSession.createDataFrame([(m, p) for m, _, p in specs], "model string, predictors array<string>")
    rows = predictions.where("coefficients is not null").join(F.broadcast(names), "model")
    return rows.select("model", F.col("dataset").alias("held_out_dataset"), "alpha", F.inline(F.arrays_zip("predictors", "coefficients"))).withColumnsRenamed({"predictors": "predictor", "coefficients": "coefficient"})


def mean_baseline(table: DataFrame, target: str = "delta_norm") -> DataFrame:
    """The mean of all others, in one aggregation: (sum - y) / (n - 1)."""
    y = table.select("dataset", as_number(table.schema[target]).alias("y_true")).where("y_true is not null")
    one = y.agg(F.sum("y_true").alias("s"), F.count(F.lit(1)).alias("n"))
    return y.crossJoin(F.broadcast(one)).select("dataset", "y_true", F.try_divide(F.col("s") - F.col("y_true"), F.col("n") - 1).alias("y_pred"))  # one row


def sign_baseline(table: DataFrame, target: str = "delta_norm") -> DataFrame:
    """The majority sign of all others, positive on ties."""
    y = table.select("dataset", as_number(table.schema[target]).alias("y_true")).where("y_true is not null")
    one = y.agg(F.sum(F.signum("y_true")).alias("s"))
    rest = F.col("s") - F.signum("y_true")
    return y.crossJoin(F.broadcast(one)).select("dataset", "y_true", F.when(rest >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("y_pred"))  # one row


def single_ols(table: DataFrame, feature: str, target: str = "delta_norm") -> DataFrame:
    """Leave-one-out predictions of a line through one feature, from sums without the row."""
    d = table.select("dataset", as_number(table.schema[feature]).alias("x"), as_number(table.schema[target]).alias("y_true")).where("x is not null and y_true is not null")
    x, y = F.col("x"), F.col("y_true")
    one = d.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"))
    r = d.crossJoin(F.broadcast(one))  # one row
    n = F.col("n")
    dx, dy = x - F.col("mx"), y - F.col("my")
    vx, cxy = n * F.col("v") - dx * dx * F.try_divide(n, n - 1), n * F.col("c") - dx * dy * F.try_divide(n, n - 1)
    mx, my = F.try_divide(F.col("sx") - x, n - 1), F.try_divide(F.col("sy") - y, n - 1)
    flat = vx <= 1e-12 * n * (F.col("v") + 1e-300)
    return r.select("dataset", "y_true", (my + F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cxy, vx) * (x - mx))).alias("y_pred"))


def clip(predictions: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Predictions within the bounds of the target, and whether they were moved."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), F.col("y_pred")))
    return predictions.withColumn("clipped", F.col("y_pred") != inside).withColumn("y_pred", inside)


def with_sign(predictions: DataFrame) -> DataFrame:
    """Whether the sign is right; NULL for a target of zero.  Also the absolute error."""
    right = F.when(F.col("y_true") != 0, F.signum("y_true") == F.signum("y_pred"))
    return predictions.withColumns({"abs_error": F.abs(F.col("y_true") - F.col("y_pred")), "sign_correct": right})


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """n, errors, out-of-sample R2, correlations, sign accuracy and median penalty per group."""
    rows = with_sign(predictions)
    rows = rows.withColumns({"ra": average_rank("y_true", *by), "rb": average_rank("y_pred", *by)})
    e, y = F.col("y_true") - F.col("y_pred"), F.col("y_true")
    alpha = F.percentile("alpha", F.lit(0.5)) if "alpha" in predictions.columns else F.lit(None).cast("double")
    clipped = F.sum(F.col("clipped").cast("long")) if "clipped" in predictions.columns else F.lit(None).cast("long")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0)))).alias("oos_r2"),
        correlation(F.col("ra"), F.col("rb")).alias("spearman_pred_obs"), correlation(y, F.col("y_pred")).alias("pearson_pred_obs"), F.avg(F.col("sign_correct").cast("double")).alias("sign_accuracy"), alpha.alias("median_alpha"), clipped.alias("n_clipped"),
    )


def with_baseline_delta(table: DataFrame, *by: str, baseline: str = "mean_baseline") -> DataFrame:
    """How much smaller the errors are than the baseline's."""
    w = Window.partitionBy(*by)
    base = lambda c: F.max(F.when(F.col("model") == baseline, F.col(c))).over(w)
    return table.withColumns({"delta_mae_vs_baseline": base("mae") - F.col("mae"), "delta_rmse_vs_baseline": base("rmse") - F.col("rmse")})


def coefficient_summary(coefs: DataFrame, features: DataFrame | None = None, top_n: int = TOP_COEFFICIENTS) -> DataFrame:
    """Median, spread and sign shares of each coefficient over folds; the ``top_n`` largest per model (a report)."""
    c = F.col("coefficient")
    rows = coefs if features is None else coefs.join(features.select(F.col("feature").alias("predictor")), "predictor", "left_semi")
    q = F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    one = rows.groupBy("model", "predictor").agg(q.alias("q"), F.percentile(F.abs(c), F.lit(0.5)).alias("median_abs_standardized_coefficient"), F.avg((c > 0).cast("double")).alias("positive_fold_share"), F.avg((c < 0).cast("double")).alias("negative_fold_share"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.round("median_abs_standardized_coefficient", 12)), "predictor"))
    return one.withColumn("place", place).where(F.col("place") <= top_n).select(
        "model", "predictor", F.col("q")[1].alias("median_standardized_coefficient"), "median_abs_standardized_coefficient", F.col("q")[0].alias("q05_standardized_coefficient"), F.col("q")[2].alias("q95_standardized_coefficient"),
        "positive_fold_share", "negative_fold_share", F.greatest("positive_fold_share", "negative_fold_share").alias("coefficient_sign_consistency"),
    )


def best_models(table: DataFrame, *by: str) -> DataFrame:
    """Per group: the model with the least mean error and the one with the best sign accuracy."""
    first = lambda why, *order: table.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth = 1").drop("nth").withColumn("criterion", F.lit(why))
    return first("mae", F.asc_nulls_last(F.round("mae", 12)), "model").unionByName(first("sign_accuracy", F.desc_nulls_last(F.round("sign_accuracy", 12)), F.asc_nulls_last(F.round("mae", 12)), "model"))


def bootstrap_mean(rows: DataFrame, value: str, order: str, *by: str, repeats: int = 5000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean of a value per group with its bootstrap interval."""
    w = Window.partitionBy(*by)
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), order).withColumns({"pos": F.row_number().over(w.orderBy(order)) - 1, "size": F.count(F.lit(1)).over(w)})
    draws = v.select(*by, "pos", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    draws = draws.select(*by, "rep", resample_index(F.col("size"), F.lit(seed), F.col("rep"), F.col("pos")).cast("int").alias("pos"))
    means = draws.join(v.select(*by, "pos", "v"), [*by, "pos"]).groupBy(*by, "rep").agg(F.avg("v").alias("m"))
    q = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return v.groupBy(*by).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).join(q, [*by]).select(*by, "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def predictive_models(table: DataFrame, name: str, classification: bool = False, context: Sequence[str] = (), robust: Sequence[str] = (), target: str = "delta_norm", boosted: bool = True) -> dict[str, DataFrame]:
    """``metrics, predictions, coefficients, controls, guard`` of the whole model grid."""
    if target not in table.columns:
        raise KeyError(f"{name} has no column {target}")
    assert_one_row_per_unit(table, name)
    spark = table.sparkSession
    outside = {*CONTEXT, *context, "unit", target}
    columns = [c for c in table.columns if c not in outside]
    fit = {r["feature"] for r in usable(long_form(table, columns)).collect()}  # one row per column
    controls, report = control_columns(table, classification, fit)
    features = [c for c in columns if c in fit and c not in controls]
    rows = table.where(as_number(table.schema[target]).isNotNull())
    n = rows.count()
    specs = model_specs(features, controls, [c for c in robust if c in fit], boosted)
    predictions = leave_one_out(rows, specs if n >= MIN_N else [], target) if n >= MIN_N else spark.createDataFrame([], _PREDICTION)
    shape = spark.createDataFrame([(m, f, len(p)) for m, f, p in specs], "model string, model_family string, n_predictors int")
    table_of = lambda df: df.select(F.lit(name).alias("analysis_table"), "*")
    scored = with_baseline_delta(shape.join(metrics(predictions, "model"), "model", "left").fillna(0, ["n"]))
    kept = spark.createDataFrame([(f,) for f in features], "feature string")
    guard = spark.createDataFrame([(name, "dataset", n, len(features), len(controls), boosted)], "analysis_table string, independent_unit string, n_modeling_rows long, n_feature_predictors int, n_control_predictors int, boosted boolean")
    return {"metrics": table_of(scored), "predictions": table_of(predictions.drop("coefficients")), "coefficients": table_of(coefficient_summary(coefficients(predictions, specs), kept)), "controls": table_of(report), "guard": guard}


def nested_top_feature(table: DataFrame, features: Sequence[str], target: str = "delta_norm", least: int = 3) -> DataFrame:
    """Leave-one-out ridge on the one feature that correlates most with the target among the others: the choice is made inside each
    fold.  ``dataset, feature, y_true, y_pred``."""
    names = sorted(features)
    y = as_number(table.schema[target])
    data = table.select(F.col("dataset").cast("string").alias("dataset"), y.alias("y"), F.array(*(as_number(table.schema[c]) for c in names)).alias("x")).where("y is not null")
    rows = data.withColumn("mine", F.pmod(F.crc32("dataset"), F.lit(CHUNKS)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dataset", kind="stable")
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], dtype=float)
        y, out = pdf["y"].to_numpy(float), []
        for k in np.flatnonzero(pdf["mine"].to_numpy() == pdf["chunk"].iloc[0]).tolist():
            rest = np.arange(len(y)) != k
            best, f = -1.0, 0
            for j in range(len(names)):
                ok = rest & ~np.isnan(x[:, j])
                r = spearman(x[ok, j], y[ok]) if ok.sum() >= least else None
                if r is not None and abs(r) > best + 1e-12:
                    best, f = abs(r), j
            p, _, _ = predict("ridge", x[rest][:, [f]], y[rest], x[k : k + 1][:, [f]])
            out.append((pdf["dataset"].iloc[k], names[f], y[k], float(p[0])))
        return pd.DataFrame(out, columns=["dataset", "feature", "y_true", "y_pred"])

    return rows.groupBy("chunk").applyInPandas(run, "dataset string, feature string, y_true double, y_pred double")


def feature_lift(table: DataFrame, feature: str, controls: Sequence[str], family: str = "ridge", target: str = "delta_norm") -> DataFrame:
    """Errors with the controls alone and with the feature added, on the same complete rows."""
    from .features import complete_cases

    rows = complete_cases(table, [target, feature, *controls])
    got = metrics(leave_one_out(rows, [("controls", family, [*controls]), ("controls_plus_feature", family, [*controls, feature])], target), "model")
    w = Window.partitionBy()
    base = F.max(F.when(F.col("model") == "controls", F.col("mae"))).over(w)
    return got.select(F.lit(feature).alias("feature"), "model", "n", "mae", "rmse", "sign_accuracy", (base - F.col("mae")).alias("mae_lift"))

