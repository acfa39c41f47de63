"""Features of the analysis table: numeric predictors, filters that do not look at the target, reports and redundancy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_number, is_numeric, strict_mean
from ..schemas import CLASS_FEATURES, CLASSIFICATION, NOT_PREDICTORS
from ..sources.scratch import written
from .external import CLASS_ONLY as EXTERNAL_CLASS_ONLY
from .external import raw_feature
from .ranks import fallen, rank_correlations

MAX_MISSING = 0.20
TOP_SHARE = 0.95
RELATIVE_SPAN = 1e-12
REDUNDANT = 0.95
_REPORT = "table string, stage string, feature string, missing_fraction double, n_non_missing long, n_unique long, top_share double, reason string"


def is_class_only(feature: str) -> bool:
    """Features that exist for classification problems alone."""
    return feature in CLASS_FEATURES or raw_feature(feature) in EXTERNAL_CLASS_ONLY


def predictors(table: DataFrame, target: str = "delta_norm", classification: bool = True) -> list[str]:
    """Columns that may predict: numbers, and texts that hold a number somewhere (one job, only if there are text columns)."""
    fields = [f for f in table.schema.fields if f.name != target and f.name not in NOT_PREDICTORS and not f.name.startswith("best_")]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    parsed = set()
    if texts:
        r = table.agg(*(F.count(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in texts)).first()
        parsed = {c for c in texts if r[c]}
    out = [f.name for f in fields if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) or f.name in parsed]
    return [c for c in out if classification or not is_class_only(c)]


def coerce(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features as finite doubles."""
    return table.withColumns({c: as_number(table.schema[c]) for c in features})


def task_matrices(table: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All datasets without class features, and the classification datasets with all features."""
    context = [c for c in table.columns if c not in features]
    general = table.select(*context, *(c for c in features if not is_class_only(c)))
    return general, table.where(F.lower("task_type").isin(*CLASSIFICATION)).select(*context, *features)


def long_form(table: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """``keep..., feature, value``: one row per row and feature."""
    if not features:
        return table.select(*keep, F.lit("").alias("feature"), F.lit(None).cast("double").alias("value")).where("false")
    cell = lambda c: F.struct(F.lit(c).alias("feature"), as_number(table.schema[c]).alias("value"))
    return table.select(*keep, F.inline(F.array(*map(cell, features))))


def feature_statistics(long: DataFrame) -> DataFrame:
    """Per feature: rows, values, distinct values, span, median size and the share of the most frequent value to 12 digits."""
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k"))
    rounded = counts.groupBy("feature", F.round("value", 12).alias("v")).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("u"), F.min("value").alias("low"), F.max("value").alias("high"))
    top = rounded.groupBy("feature").agg(F.sum("u").alias("n_unique"), F.max("k").alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
    base = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_non_missing"), F.percentile(F.abs("value"), F.lit(0.5)).alias("median_abs"))
    out = base.join(top, "feature", "left")
    return out.select(
        "feature", (1 - F.col("n_non_missing") / F.col("n_rows")).alias("missing_fraction"), "n_non_missing", F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.try_divide(F.col("top"), F.col("n_non_missing")).alias("top_share"), (F.col("high") - F.col("low")).alias("span"), F.greatest(F.lit(1.0), F.col("median_abs")).alias("scale"),
    )


def filter_report(stats: DataFrame, name: str, max_missing: float = MAX_MISSING, top_share: float = TOP_SHARE) -> DataFrame:
    """The features to drop and why: too many missing values first, then constant or nearly constant ones."""
    high = F.col("missing_fraction") > max_missing
    reason = (
        F.when(high, F.lit(f"> {max_missing:.0%} missing")).when(F.col("n_non_missing") == 0, "all_missing_after_inf_replacement").when(F.col("n_unique") <= 1, "exact_constant")
        .when(F.col("span") <= RELATIVE_SPAN * F.col("scale"), "numerical_constant").when(F.col("top_share") >= top_share, f"dominant_value_share_ge_{top_share:.2f}")
    )
    low = lambda c: F.when(~high, F.col(c))
    return stats.withColumn("reason", reason).where("reason is not null").select(
        F.lit(name).alias("table"), F.when(high, "high_missingness").otherwise("near_constant").alias("stage"), "feature", "missing_fraction",
        low("n_non_missing").alias("n_non_missing"), low("n_unique").alias("n_unique"), low("top_share").alias("top_share"), "reason",
    )


def preprocess(table: DataFrame, features: Sequence[str], name: str, context: Sequence[str] = (), filter_table: DataFrame | None = None, max_missing: float = MAX_MISSING) -> tuple[DataFrame, DataFrame]:
    """The table without the features that the filter population (by default the table itself) gives reason to drop, and the report.

    The report holds one row per dropped column, so the decision is as small as the schema."""
    source = table if filter_table is None else filter_table
    features = [c for c in features if c in table.columns and c in source.columns]
    report = filter_report(feature_statistics(long_form(source, features)), name, max_missing)
    gone = {r["feature"] for r in report.select("feature").collect()}
    kept = [c for c in features if c not in gone]
    return coerce(table, kept).select(*(c for c in context if c in table.columns), *kept), report


def filter_reference(table: DataFrame, features: Sequence[str], classification_only: bool = False) -> DataFrame:
    """One row per dataset for filtering: strict means over its rows, and the task type."""
    rows = table.where(F.lower("task_type").isin(*CLASSIFICATION)) if classification_only else table
    kind = F.min("task_type").alias("task_type") if "task_type" in table.columns else F.lit(None).cast("string").alias("task_type")
    return rows.groupBy("dataset").agg(kind, *(strict_mean(as_number(table.schema[c])).alias(c) for c in features))


def missing_sweep(stats: DataFrame, name: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: features kept and dropped by missingness (thresholds are exploded beside each feature)."""
    rows = stats.select("missing_fraction", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    drop = F.col("missing_fraction") > F.col("threshold")
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_features"), F.sum(drop.cast("long")).alias("n_dropped"), F.sum((~drop).cast("long")).alias("n_kept")).select(F.lit(name).alias("table"), "threshold", "n_features", "n_dropped", "n_kept")


def missing_by_dataset(long: DataFrame) -> DataFrame:
    """Per dataset: features, missing ones and their share."""
    gone = F.col("value").isNull().cast("long")
    return long.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_features"), F.sum(gone).alias("n_missing"), F.avg(gone).alias("missing_share"))


def strong_pairs(pairs: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """Pairs whose absolute correlation reaches the threshold, strongest first."""
    r = F.round(F.abs("r"), 12)
    return pairs.select("a", "b", "n", r.alias("abs_spearman")).where(F.col("abs_spearman") >= threshold).orderBy(F.desc("abs_spearman"), "a", "b")


def reduce_redundant(table: DataFrame, features: Sequence[str], name: str, context: Sequence[str] = (), threshold: float = REDUNDANT) -> tuple[DataFrame, DataFrame]:
    """The table without features that another one repeats, and the report.

    Pairs come strongest first; of a pair of survivors the one with fewer missing values, then more distinct values, then the
    smaller name stays.  The report holds one row per dropped column."""
    long = long_form(table, features, "dataset")
    stats = written(feature_statistics(long).select("feature", "missing_fraction", "n_unique"), "statistics")
    of = lambda s: stats.select(F.col("feature").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("missing_fraction", "n_unique")))
    pairs = strong_pairs(rank_correlations(long), threshold).join(of("a"), "a").join(of("b"), "b")
    order = lambda s: F.struct(F.col(f"{s}_missing_fraction"), -F.col(f"{s}_n_unique"), F.col(s))
    first = order("a") < order("b")
    found = fallen(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), "abs_spearman", "a", "b"))
    report = found.join(of("dropped"), "dropped").join(of("kept"), "kept").select(
        F.lit(name).alias("table"), F.lit("redundancy").alias("stage"), F.col("dropped").alias("dropped_feature"), F.col("kept").alias("kept_feature"), "abs_spearman",
        "dropped_missing_fraction", "kept_missing_fraction", "dropped_n_unique", "kept_n_unique", F.lit(f"abs_spearman >= {threshold:.2f}").alias("reason"),
    )
    gone = {r[0] for r in found.select("dropped").collect()}
    return table.select(*(c for c in context if c in table.columns), *(c for c in features if c not in gone)), report


def complete_cases(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a finite number in every column."""
    rows = coerce(table, columns)
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True)))


def usable(long: DataFrame, least: int = 3) -> DataFrame:
    """``feature`` of those with at least ``least`` values that are not all equal."""
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where((F.col("n") >= least) & (F.col("low") < F.col("high"))).select("feature")
