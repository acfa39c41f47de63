"""Irregularity of a split: five components and their weighted composite over datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import sample_skewness
from ..schemas import IRREGULARITY, SPLIT
from ..sources.splits import SplitRows
from .descriptors import profiles
from .pairs import moments

COMPOSITE = "irregularity"


def profile_components(profile: DataFrame) -> DataFrame:
    """The components that are aggregates over the profiles of varying numeric features."""
    p = profile.where("kind = 'num' and n_distinct > 1").groupBy(*SPLIT)
    q = F.percentile("hmean", F.array(F.lit(0.25), F.lit(0.75)))
    skew = lambda x: F.when(F.min(x) < F.max(x), sample_skewness(x, None))
    out = p.agg(
        skew(F.col("std")).alias("irreg_std_skew"), skew(F.col("high") - F.col("low")).alias("irreg_range_skew"), F.when(F.count("hmean") >= 2, q).alias("q"), F.stddev_samp("kurt").alias("irreg_kurtosis_std"),
    )
    return out.select(*SPLIT, "irreg_std_skew", "irreg_range_skew", (F.col("q")[1] - F.col("q")[0]).alias("irreg_iqr_hmean"), "irreg_kurtosis_std")


def smallest_eigenvalue(sr: SplitRows, profile: DataFrame) -> DataFrame:
    """``irreg_min_cov_eig``: columns are standardised by all their values, the covariance is over rows without a missing number."""
    names = sr.numeric
    sd = profile.where("kind = 'num' and n_distinct > 1").select(*SPLIT, "feature", "std_pop")
    constant = profile.where("kind = 'num' and n_distinct <= 1").select(*SPLIT).distinct()
    # rows are whole over the varying features; where a split has constant ones, its rows are judged without them
    parts = [moments(replace(sr.only(sr.keys().join(constant, SPLIT, "left_anti")), features=names), whole=True)]
    mixed = sr.only(constant).expanded()
    dead = profile.where("kind = 'num' and n_distinct <= 1").groupBy(*SPLIT).agg(F.collect_set("feature").alias("dead"))  # at most the features of a split
    filled = SplitRows(mixed.rows, names).numbers().join(dead, SPLIT).select(*SPLIT, *(F.when(F.array_contains("dead", f), F.lit(0.0)).otherwise(F.col(f)).alias(f) for f in names))
    parts.append(moments(SplitRows(filled, names), whole=True))
    pairs = reduce(DataFrame.unionByName, parts)
    for side in "ab":
        pairs = pairs.join(sd.select(*SPLIT, F.col("feature").alias(side), F.col("std_pop").alias(f"sd_{side}")), [*SPLIT, side])
    cov = pairs.where("n >= 2").select(*SPLIT, "a", "b", F.try_divide(F.col("sp") / (F.col("n") - 1), F.col("sd_a") * F.col("sd_b")).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        features = sorted({*pdf["a"], *pdf["b"]})
        at = {f: k for k, f in enumerate(features)}
        m = np.zeros((len(features), len(features)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["c"].to_numpy()
        low = float(np.linalg.eigvalsh(m).min()) if len(features) >= 2 and np.isfinite(m).all() else None
        return pd.DataFrame([[*pdf[SPLIT].iloc[0], low]], columns=[*SPLIT, "irreg_min_cov_eig"])

    return cov.groupBy(*SPLIT).applyInPandas(run, "dataset string, repeat int, fold int, irreg_min_cov_eig double")


def irregularity(sr: SplitRows, profile: DataFrame | None = None) -> DataFrame:
    """The five components of each split."""
    profile = profiles(sr) if profile is None else profile
    return sr.keys().drop("kind").join(profile_components(profile), SPLIT, "left").join(smallest_eigenvalue(sr, profile), SPLIT, "left").select(*SPLIT, *IRREGULARITY)


def composite(table: DataFrame, components: Sequence[str] = tuple(IRREGULARITY), out: str = COMPOSITE) -> DataFrame:
    """``table`` (one row per dataset) with the weighted sum of the components' z-scores.

    The weights of missing components pass to the others of the row; a row without any has none.  Means and deviations are one
    row, joined by broadcast, so no window gathers the table."""
    unknown = [c for c in components if c not in IRREGULARITY]
    if unknown:
        raise ValueError(f"unknown irregularity components {unknown}")
    have = [c for c in components if c in table.columns]
    if not have:
        return table.withColumn(out, F.lit(None).cast("double"))
    one = table.agg(*(F.avg(c).alias(f"__m_{c}") for c in have), *(F.nullif(F.stddev_pop(c), F.lit(0.0)).alias(f"__s_{c}") for c in have))
    z = {c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in have}
    total = sum(abs(IRREGULARITY[c]) for c in have)
    weighted = reduce(lambda a, b: a + b, (F.coalesce(IRREGULARITY[c] * z[c], F.lit(0.0)) for c in have))
    used = reduce(lambda a, b: a + b, (F.when(z[c].isNotNull(), F.lit(abs(IRREGULARITY[c]))).otherwise(0.0) for c in have))
    return table.crossJoin(F.broadcast(one)).withColumn(out, weighted * F.try_divide(F.lit(total), F.nullif(used, F.lit(0.0)))).drop(*one.columns)
