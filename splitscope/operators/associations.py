"""Associations of features with the gap: correlation, corrected p values, bootstrap intervals and rank stability.

Everything runs in long form, one row per (unit, feature): the plan does not grow with the number of features.  Units are datasets,
so the tables are small; replicates multiply them and are spread by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import as_number, average_rank, correlation, one_sided_p, resample_index, two_sided_p, with_step_down, with_step_up
from ..sources.scratch import written
from .features import long_form, predictors
from .ranks import leave_one_out

MIN_N = 30
ALPHA = 0.05
REPEATS = 500
TOP_K = 25
SEED = 20260424
Q_LIMIT = 0.05
SIGN_LIMIT = 0.90
LEAST_REPLICATES = 20
ROBUST_NAMES = {"spearman_r": "spearman_rho", "abs_spearman_r": "abs_spearman_rho", "p_value_bh": "bh_q_value", "ci_low": "bootstrap_ci_low", "ci_high": "bootstrap_ci_high"}


def assert_one_row_per_unit(table: DataFrame, name: str, unit: str = "dataset") -> None:
    """Raises unless every unit has one row; shows at most ten that do not."""
    if unit not in table.columns:
        raise KeyError(f"{name} has no column {unit}")
    bad = [r[0] for r in repeated_units(table, unit).limit(10).collect()]
    if bad:
        raise ValueError(f"{name} has several rows for {bad}: aggregate them, or choose a finer unit")


def repeated_units(table: DataFrame, unit: str = "dataset") -> DataFrame:
    return table.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def observations(table: DataFrame, features: Sequence[str], target: str = "delta_norm", unit: str = "dataset") -> DataFrame:
    """``unit, feature, x, y`` of all rows, missing values included."""
    y = as_number(table.schema[target])
    return long_form(table.withColumns({"__y": y, "__u": F.col(unit).cast("string")}), features, "__u", "__y").select(F.col("__u").alias("unit"), "feature", F.col("value").alias("x"), F.col("__y").alias("y"))


def correlate(pairs: DataFrame, by: Sequence[str], method: str = "spearman") -> DataFrame:
    """``by..., n, x_unique, y_unique, r`` over complete pairs; r is NULL where a side is constant."""
    if method == "spearman":
        pairs = pairs.withColumns({"cx": average_rank("x", *by), "cy": average_rank("y", *by)})
    else:
        pairs = pairs.withColumns({"cx": F.col("x"), "cy": F.col("y")})
    # distinct values without a distinct aggregate: the first row of each value counts one
    first = lambda v: (F.row_number().over(W.partitionBy(*by, v).orderBy("unit")) == 1).cast("long")
    pairs = pairs.withColumns({"fx": first("x"), "fy": first("y")})
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("fx").alias("feature_n_unique"), F.sum("fy").alias("target_n_unique"), correlation(F.col("cx"), F.col("cy")).alias("r"))


def test_associations(obs: DataFrame, features: Sequence[str], name: str, min_n: int = MIN_N, method: str = "spearman", alpha: float = ALPHA) -> DataFrame:
    """One row per feature: correlation, p, Benjamini-Hochberg q, effect rank, and the reason where nothing is tested."""
    spark = obs.sparkSession
    found = correlate(obs.where("x is not null and y is not null"), ["feature"], method)
    rows = spark.createDataFrame([(f,) for f in features], "feature string").join(found, "feature", "left").fillna(0, ["n", "feature_n_unique", "target_n_unique"])
    reason = F.when(F.col("n") < min_n, f"n < {min_n}").when(F.col("feature_n_unique") < 2, "feature has <2 observed values").when(F.col("target_n_unique") < 2, "target has <2 observed values").otherwise("tested")
    rows = rows.withColumn("reason", reason).withColumn("spearman_r", F.when(F.col("reason") == "tested", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))))).drop("r", "target_n_unique")
    rows = rows.withColumn("p_value", F.when(F.col("spearman_r").isNotNull(), two_sided_p(F.col("spearman_r"), F.greatest(F.lit(3), F.col("n")))))
    rows = with_step_up(rows, "p_value", "p_value_bh", [])
    rows = rows.withColumns({"abs_spearman_r": F.abs("spearman_r"), "bh_reject": F.coalesce(F.col("p_value_bh") <= alpha, F.lit(False)), "table": F.lit(name)})
    rank = F.row_number().over(W.orderBy(F.desc_nulls_last(F.round("abs_spearman_r", 12)), "feature"))  # one row per feature
    return rows.withColumn("effect_rank", rank)


def replicates(n: int, first: int = 0):
    return F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))


def bootstrap_intervals(obs: DataFrame, tested: DataFrame, repeats: int = REPEATS, alpha: float = ALPHA, seed: int = SEED, method: str = "spearman") -> DataFrame:
    """``feature, ci_low, ci_high, bootstrap_sign_consistency, bootstrap_repeats_used``: every feature resamples its own complete pairs."""
    rows = obs.where("x is not null and y is not null").join(tested.select("feature", F.col("spearman_r").alias("observed")), "feature").where("observed is not null")
    w = W.partitionBy("feature")
    rows = rows.withColumns({"pos": F.row_number().over(w.orderBy("unit")) - 1, "size": F.count(F.lit(1)).over(w)})
    draws = rows.select("feature", "pos", "size", replicates(repeats).alias("rep"))
    draws = draws.select("feature", "rep", F.col("pos").cast("string").alias("unit"), resample_index(F.col("size"), F.lit(seed), F.col("feature"), F.col("rep"), F.col("pos")).alias("pos"))
    got = correlate(draws.join(rows.select("feature", "pos", "x", "y"), ["feature", "pos"]), ["feature", "rep"], method).where("r is not null")
    got = got.join(tested.select("feature", F.col("spearman_r").alias("observed")), "feature")
    q = F.percentile("r", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    same = F.avg((F.signum("r") == F.signum("observed")).cast("double"))
    one = got.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), q.alias("q"), same.alias("same"), F.max("observed").alias("observed"))
    enough = lambda c: F.when(F.col("k") >= LEAST_REPLICATES, c)
    return one.select("feature", enough(F.col("q")[0]).alias("ci_low"), enough(F.col("q")[1]).alias("ci_high"), enough(F.when(F.col("observed") != 0, F.col("same"))).alias("bootstrap_sign_consistency"), F.col("k").alias("bootstrap_repeats_used"))


def rank_stability(obs: DataFrame, tested: DataFrame, min_n: int = MIN_N, repeats: int = REPEATS, top_k: int = TOP_K, seed: int = SEED + 100_000, method: str = "spearman") -> DataFrame:
    """``feature, bootstrap_rank_median, q05, q95, bootstrap_top_k_frequency`` of the ``top_k`` strongest features: all features are ranked
    on the same resample of units in each replicate."""
    known = tested.where("spearman_r is not null").select("feature", "effect_rank")
    units = obs.select("unit").distinct()
    order = units.withColumns({"pos": F.row_number().over(W.orderBy("unit")) - 1, "size": F.count(F.lit(1)).over(W.partitionBy())})  # one row per unit
    draws = order.select("pos", "size", replicates(repeats).alias("rep")).select("rep", F.col("pos").alias("draw"), resample_index(F.col("size"), F.lit(seed), F.col("rep"), F.col("pos")).alias("pos"))
    drawn = draws.join(order.select("pos", "unit"), "pos").select("rep", "draw", "unit")
    rows = drawn.join(obs.where("x is not null and y is not null").join(known, "feature", "left_semi"), "unit").select("rep", "feature", F.col("draw").cast("string").alias("unit"), "x", "y")
    got = correlate(rows, ["rep", "feature"], method).where((F.col("n") >= min_n) & F.col("r").isNotNull()).join(known, "feature")
    got = got.withColumn("rank", F.row_number().over(W.partitionBy("rep").orderBy(F.desc(F.round(F.abs("r"), 12)), "effect_rank")))
    tracked = known.withColumn("nth", F.row_number().over(W.orderBy("effect_rank"))).where(F.col("nth") <= top_k).select("feature")
    q = F.percentile("rank", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    one = got.join(tracked, "feature", "left_semi").groupBy("feature").agg(F.count(F.lit(1)).alias("k"), q.alias("q"), F.avg((F.col("rank") <= top_k).cast("double")).alias("hit"))
    enough = lambda c: F.when(F.col("k") >= LEAST_REPLICATES, c)
    out = one.select("feature", enough(F.col("q")[1]).alias("bootstrap_rank_median"), enough(F.col("q")[0]).alias("bootstrap_rank_q05"), enough(F.col("q")[2]).alias("bootstrap_rank_q95"), enough(F.col("hit")).alias("bootstrap_top_k_frequency"))
    return tracked.join(out, "feature", "left")


def associations(table: DataFrame, name: str, features: Sequence[str] | None = None, target: str = "delta_norm", unit: str = "dataset", min_n: int = MIN_N, repeats: int = REPEATS, ci_top_k: int | None = None, top_k: int = TOP_K, alpha: float = ALPHA, seed: int = SEED, method: str = "spearman", check: bool = True, ci_alpha: float | None = None) -> DataFrame:
    """The whole association table.  ``check`` runs the guard of one row per unit first.

    Observations and tests are written, as both bootstraps read them several times: the plan below ``table`` runs once and is in no other plan."""
    if target not in table.columns:
        raise KeyError(f"{name} has no column {target}")
    if check:
        assert_one_row_per_unit(table, name, unit)
    features = predictors(table, target) if features is None else list(features)
    missing = sorted(set(features) - set(table.columns))
    if missing:
        raise KeyError(f"{name} has no columns {missing}")
    obs = written(observations(table, features, target, unit), "observations")
    tested = written(test_associations(obs, features, name, min_n, method, alpha), "tested")
    chosen = tested if ci_top_k is None else tested.where(F.col("effect_rank") <= ci_top_k)
    out = tested.join(bootstrap_intervals(obs, chosen, repeats, alpha if ci_alpha is None else ci_alpha, seed, method), "feature", "left").fillna(0, ["bootstrap_repeats_used"])
    return out.join(rank_stability(obs, tested, min_n, repeats, top_k, seed + 100_000, method), "feature", "left")


def robust_associations(table: DataFrame, name: str, q_limit: float = Q_LIMIT, sign_limit: float = SIGN_LIMIT, top_n: int = TOP_K, q: str = "p_value_bh") -> DataFrame:
    """The strongest associations that pass the corrected test (column ``q``) with a stable sign (a report of ``top_n`` rows)."""
    kept = table.withColumn("p_value_bh", F.col(q)).where((F.col("p_value_bh") < q_limit) & (F.col("bootstrap_sign_consistency") >= sign_limit))
    top = kept.orderBy(F.desc(F.round("abs_spearman_r", 12)), F.desc("bootstrap_sign_consistency"), "feature").limit(top_n)
    columns = ["feature", "n", "spearman_r", "abs_spearman_r", "p_value_bh", "ci_low", "ci_high", "bootstrap_sign_consistency", "bootstrap_rank_median", "bootstrap_rank_q05", "bootstrap_rank_q95", "bootstrap_top_k_frequency"]
    return top.select(F.lit(name).alias("analysis_table"), *columns).withColumnsRenamed(ROBUST_NAMES)


def corrected(tested: DataFrame, method: str | None = "bh", direction: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """p values turned to an expected direction, and corrected by ``bh``, ``holm`` or not at all."""
    rows = tested.withColumn("p_directed", one_sided_p(F.col("p_value"), F.col("spearman_r"), F.lit(direction).cast("string")))
    if method is None:
        return rows.withColumn("p_adjusted", F.col("p_directed"))
    return (with_step_up if method == "bh" else with_step_down)(rows, "p_directed", "p_adjusted", list(by))


def leave_one_out_range(obs: DataFrame, method: str = "spearman") -> DataFrame:
    """Per feature: extremes of the correlation when one unit is left out, the share with the sign of the whole, and the unit that matters
    most."""
    got = leave_one_out(obs.where("x is not null and y is not null"), method).where("r is not null and rho is not null")
    change = F.round(F.abs(F.col("r") - F.col("rho")), 12)
    return got.groupBy("feature").agg(F.max("rho").alias("rho"), F.min("r").alias("rho_min"), F.max("r").alias("rho_max"), F.avg((F.signum("r") == F.signum("rho")).cast("double")).alias("same_sign_share"), F.max_by("without", F.struct(change, "without")).alias("most_influential"))
