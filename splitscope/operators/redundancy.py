"""Redundancy of the numeric features of a split: pairwise correlations and the spread of their eigenvalues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SPLIT
from ..sources.splits import SplitRows
from .descriptors import profiles
from .pairs import MAX_FEATURES, correlations

HIGH_CORRELATION = 0.9
_RANK = "dataset string, repeat int, fold int, effective_rank double, participation_ratio double"


def varying_features(profile: DataFrame) -> DataFrame:
    """``split, feature`` of numeric features with two values or more, in splits with 2 to ``MAX_FEATURES`` of them."""
    many = profile.where("kind = 'num' and n_distinct > 1").select(*SPLIT, "feature")
    fit = many.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("k")).where((F.col("k") >= 2) & (F.col("k") <= MAX_FEATURES)).drop("k")
    return many.join(fit, SPLIT, "left_semi")


def correlation_summary(pairs: DataFrame) -> DataFrame:
    r = F.abs("r")
    return pairs.where("r is not null").groupBy(*SPLIT).agg(F.avg(r).alias("mean_abs_corr"), F.max(r).alias("max_abs_corr"), F.avg((r > HIGH_CORRELATION).cast("double")).alias("high_corr_pair_fraction"))


def eigen_spread(values: np.ndarray) -> tuple[float | None, float | None]:
    """Exponential of the entropy of the eigenvalue shares, and the participation ratio."""
    v = np.clip(values, 0.0, None)
    total = v.sum()
    if total <= 0:
        return None, None
    p = v[v > 0] / total
    return float(np.exp(-(p * np.log(p)).sum())), float(total**2 / (v**2).sum())


def correlation_rank(pairs: DataFrame) -> DataFrame:
    """Effective rank and participation ratio; a group is one split's matrix of at most ``MAX_FEATURES`` columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {f: k for k, f in enumerate(names)}
        m = np.eye(len(names))
        i, j, r = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy(), pdf["r"].fillna(0.0).to_numpy()
        m[i, j] = m[j, i] = r
        rank, ratio = eigen_spread(np.linalg.eigvalsh(m))
        return pd.DataFrame([[*pdf[SPLIT].iloc[0], rank, ratio]], columns=[*SPLIT, "effective_rank", "participation_ratio"])

    return pairs.groupBy(*SPLIT).applyInPandas(run, _RANK)


def redundancy(sr: SplitRows, profile: DataFrame | None = None) -> DataFrame:
    """All redundancy descriptors of each split; NULL below 2 and above ``MAX_FEATURES`` varying numeric features."""
    profile = profiles(sr, shape=False) if profile is None else profile
    pairs = correlations(sr, varying_features(profile))
    return sr.keys().drop("kind").join(correlation_summary(pairs), SPLIT, "left").join(correlation_rank(pairs), SPLIT, "left")
