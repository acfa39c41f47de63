"""External descriptors that need a class: information shared with the class, scatter within and between classes.

Everything starts from counts of (feature, value, class) or from cross products by class, both of which are added up by fold before they reach a
split.  Definitions are the textbook ones; a row counts where value and class are known, and for scatter where no number is missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SPLIT
from ..sources.splits import SplitRows
from .descriptors import class_label
from .pairs import MAX_FEATURES, moments

INFORMATION = ("joint_ent", "mut_inf", "class_conc")
SINGLE_INFORMATION = ("class_ent", "eq_num_attr", "ns_ratio")
SCATTER = ("gravity", "lh_trace", "nr_disc", "p_trace", "roy_root", "sd_ratio", "w_lambda")
SINGULAR = 1e-12  # share of the greatest eigenvalue below which a matrix counts as singular


def contingency(sr: SplitRows) -> DataFrame:
    """``split, feature, value, y, k``: how often a category meets a class."""
    y = class_label(sr)
    if y is None or not sr.categorical:
        return sr.keys().select(*SPLIT, F.lit("").alias("feature"), F.lit("").alias("value"), F.lit("").alias("y"), F.lit(0).cast("long").alias("k")).where("false")
    met = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in sr.categorical))
    known = sr.rows.select(*sr.key, y.alias("y"), F.inline(met)).where("y is not null and value is not null")
    parts = known.groupBy(*sr.key, "feature", "value", "y").agg(F.count(F.lit(1)).alias("k"))
    return sr.to_splits(parts).groupBy(*SPLIT, "feature", "value", "y").agg(F.sum("k").alias("k"))


def information(counts: DataFrame) -> DataFrame:
    """``split, feature, n, attr, joint_ent, mut_inf, class_conc`` of every categorical column, all from :func:`contingency`."""
    k, by = F.col("k"), [*SPLIT, "feature"]
    rows = counts.groupBy(*by, "value").agg(F.sum(k).alias("n"), F.sum(k * F.log2(k)).alias("j"), F.sum(k * k).alias("s"))
    rows = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("j").alias("j"), F.sum(F.col("n") * F.log2("n")).alias("x"), F.sum(F.col("s") / F.col("n")).alias("s"))
    columns = counts.groupBy(*by, "y").agg(F.sum(k).alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.log2("m")).alias("y"), F.sum(F.col("m") * F.col("m")).alias("q"))
    n = F.col("n")
    entropy = lambda c: F.log2(n) - F.col(c) / n
    guess = F.col("q") / (n * n)
    out = rows.join(columns, by).withColumns({"attr": entropy("x"), "joint_ent": entropy("j")})
    return out.select(*by, "n", "attr", "joint_ent", (F.col("attr") + entropy("y") - F.col("joint_ent")).alias("mut_inf"), F.try_divide(F.col("s") / n - guess, 1 - guess).alias("class_conc"))


def class_counts(sr: SplitRows) -> DataFrame:
    """``split, y, k``: rows of each class."""
    y = class_label(sr)
    if y is None:
        return sr.keys().select(*SPLIT, F.lit("").alias("y"), F.lit(0).cast("long").alias("k")).where("false")
    parts = sr.rows.select(*sr.key, y.alias("y")).where("y is not null").groupBy(*sr.key, "y").agg(F.count(F.lit(1)).alias("k"))
    return sr.to_splits(parts).groupBy(*SPLIT, "y").agg(F.sum("k").alias("k"))


def class_information(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``split, class_ent, eq_num_attr, ns_ratio``: entropy of the class, how many average columns would tell it, and noise over signal."""
    k, n = F.col("k"), F.sum("k")
    own = classes.groupBy(*SPLIT).agg((F.log2(n) - F.sum(k * F.log2(k)) / n).alias("class_ent"))
    mean = found.groupBy(*SPLIT).agg(F.avg("mut_inf").alias("told"), F.avg("attr").alias("held"))
    out = own.join(mean, SPLIT, "left")
    return out.select(*SPLIT, "class_ent", F.try_divide("class_ent", "told").alias("eq_num_attr"), F.try_divide(F.col("held") - F.col("told"), F.col("told")).alias("ns_ratio"))


def class_products(sr: SplitRows) -> DataFrame:
    """Cross products of whole rows by split and class (``y``); splits of more than ``MAX_FEATURES`` numbers have none."""
    y = class_label(sr)
    by = F.lit(None).cast("string") if y is None else y
    wide = len(sr.numeric) > MAX_FEATURES
    return moments(sr, whole=True, by=by).where(F.col("y").isNotNull() & F.lit(not wide))


def scatter(products: DataFrame) -> DataFrame:
    """``split, a, b, within, between, n, q``: scatter of pairs of columns within and between classes."""
    n = F.col("n")
    mean = lambda c: F.try_divide(F.sum(n * F.col(c)), F.sum(n))
    whole = products.groupBy(*SPLIT, "a", "b").agg(mean("mean_a").alias("all_a"), mean("mean_b").alias("all_b"))
    apart = n * (F.col("mean_a") - F.col("all_a")) * (F.col("mean_b") - F.col("all_b"))
    return products.join(whole, [*SPLIT, "a", "b"]).groupBy(*SPLIT, "a", "b").agg(F.sum("sp").alias("within"), F.sum(apart).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("q"))


def _square(pdf: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    names = sorted({*pdf["a"], *pdf["b"]})
    at = {f: k for k, f in enumerate(names)}
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    out = []
    for c in columns:
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = pdf[c].to_numpy()
        out.append(m)
    return out


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Eigenvalues and vectors of a scatter whose columns are scaled alike, and the scales; None if it is singular."""
    scale = np.sqrt(np.diag(m))
    if not len(m) or not (scale > 0).all():
        return None
    v, u = np.linalg.eigh(m / np.outer(scale, scale))
    return (v, u, scale) if v[0] > SINGULAR * v[-1] else None


def _log_det(m: np.ndarray) -> float | None:
    found = _scaled(m)
    return None if found is None else float(np.log(found[0]).sum() + 2 * np.log(found[2]).sum())


def discriminants(scatters: DataFrame) -> DataFrame:
    """``split, p, q, n, roots, pooled``: eigenvalues of the between scatter measured by the within one, greatest first, as many as there are
    discriminant functions, and the log determinant of the pooled covariance.  A group is one split's two matrices of at most ``MAX_FEATURES`` columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        within, between = _square(pdf, "within", "between")
        p, q, n = len(within), int(pdf["q"].iloc[0]), float(pdf["n"].iloc[0])
        roots = pooled = None
        found = _scaled(within)
        if q > 1 and found is not None:
            v, u, scale = found
            turn = u / np.sqrt(v) / scale[:, None]
            roots = np.clip(np.linalg.eigvalsh(turn.T @ between @ turn)[::-1][: min(p, q - 1)], 0, None).tolist()
            pooled = _log_det(within / (n - q)) if n > q else None
        return pd.DataFrame([[*pdf[SPLIT].iloc[0], p, q, n, roots, pooled]], columns=[*SPLIT, "p", "q", "n", "roots", "pooled"])

    return scatters.groupBy(*SPLIT).applyInPandas(run, "dataset string, repeat int, fold int, p int, q int, n double, roots array<double>, pooled double")


def _spread(products: DataFrame, found: DataFrame) -> DataFrame:
    """``split, sd_ratio``: how much the covariances of the classes differ (1: not at all), from Box's M with its correction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf["n"].iloc[0])
        own = _log_det(_square(pdf, "sp")[0] / (n - 1)) if n > 1 else None
        return pd.DataFrame([[*pdf[SPLIT].iloc[0], n, own]], columns=[*SPLIT, "n", "own"])

    each = products.groupBy(*SPLIT, "y").applyInPandas(run, "dataset string, repeat int, fold int, n double, own double")
    free = F.col("n") - 1
    one = each.groupBy(*SPLIT).agg(F.sum(free).alias("free"), F.sum(F.try_divide(F.lit(1.0), free)).alias("inverse"), F.sum(free * F.col("own")).alias("own"), (F.count("own") == F.count(F.lit(1))).alias("whole"))
    both = one.join(found.select(*SPLIT, "p", "q", F.col("n").alias("n_all"), "pooled"), SPLIT)
    p, q = F.col("p"), F.col("q")
    factor = 1 - (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (q - 1)) * (F.col("inverse") - 1 / (F.col("n_all") - q))
    box = factor * (F.col("free") * F.col("pooled") - F.col("own"))
    return both.where("whole and pooled is not null and n_all > q and q > 1").select(*SPLIT, F.exp(box / (p * F.col("free"))).alias("sd_ratio"))


def _gravity(products: DataFrame) -> DataFrame:
    """``split, gravity``: the distance between the means of the most and the least frequent class (of several the last and the first by name)."""
    means = products.where("a = b").groupBy(*SPLIT, "y").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("a", "mean_a"))).alias("m"))  # at most MAX_FEATURES
    ends = means.groupBy(*SPLIT).agg(F.max_by("m", F.struct("n", "y")).alias("most"), F.min_by("m", F.struct("n", "y")).alias("least"), F.count(F.lit(1)).alias("q")).where("q > 1")
    apart = F.zip_with("most", "least", lambda x, y: (x["mean_a"] - y["mean_a"]) * (x["mean_a"] - y["mean_a"]))
    return ends.select(*SPLIT, F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).alias("gravity"))


def class_scatter(products: DataFrame) -> DataFrame:
    """``split, gravity, lh_trace, nr_disc, p_trace, roy_root, sd_ratio, w_lambda, can_cor``, the last an array, from :func:`class_products`."""
    found = discriminants(scatter(products))
    add = lambda f: F.aggregate(F.transform("roots", f), F.lit(0.0), lambda s, x: s + x)
    share = lambda r: r / (1 + r)
    out = found.select(
        *SPLIT, add(lambda r: r).alias("lh_trace"), F.when(F.col("roots").isNotNull(), F.size("roots").cast("double")).alias("nr_disc"), add(share).alias("p_trace"), F.col("roots")[0].alias("roy_root"),
        F.aggregate("roots", F.lit(1.0), lambda s, r: s / (1 + r)).alias("w_lambda"), F.transform("roots", lambda r: F.sqrt(share(r))).alias("can_cor"),
    )
    return out.join(_gravity(products), SPLIT, "left").join(_spread(products, found), SPLIT, "left")


def normality_p(n: Column, skew: Column, kurt: Column) -> Column:
    """p value of the omnibus test that joins the normalised skewness and kurtosis (D'Agostino and Pearson), from bias-corrected moments; NULL below eight values.

    Its statistic has two degrees of freedom, so the tail is an exponential."""
    n = n.cast("double")
    g1 = skew * (n - 2) / F.sqrt(n * (n - 1))
    b2 = (kurt * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) + 3
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.ln(w2) / 2)
    x = (b2 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, F.exp(-(z1 * z1 + z2 * z2) / 2))


def normal_count(alpha: float = 0.05) -> Column:
    """``nr_norm`` as an aggregate over a profile: numeric columns that do not depart from a normal distribution; a constant one does."""
    numbers = (F.col("kind") == "num") & (F.col("n_distinct") > 1)
    p = F.when(numbers, normality_p(F.col("n_values"), F.col("skew"), F.col("kurt")))
    return F.sum((F.coalesce(p, F.lit(0.0)) >= alpha).cast("double")).alias("nr_norm")
