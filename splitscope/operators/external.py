"""External descriptors, ``pymfe__<feature>.<summary>``: the statistical ones in native form, names and input preparation.

The reference hands these to a library whose formulas are not part of it.  The per-attribute statistics below follow their
textbook definitions; groups that train models are left out (see the README).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_number, sample_kurtosis, sample_skewness
from ..schemas import SPLIT
from ..sources.scratch import written
from ..sources.splits import SplitRows
from .classwise import INFORMATION, SCATTER, SINGLE_INFORMATION, class_counts, class_information, class_products, class_scatter, contingency, information, normal_count
from .descriptors import profiles, split_rows, stored_profiles, value_counts, values, wanted
from .pairs import MAX_FEATURES, moments

PREFIX = "pymfe__"
# Names of external descriptors that need a class target, group by group.
CLASS_ONLY_BY_GROUP = {
    "general": ("freq_class", "nr_class"),
    "statistical": ("can_cor", "gravity", "lh_trace", "nr_disc", "p_trace", "roy_root", "sd_ratio", "w_lambda"),
    "info-theory": ("class_conc", "class_ent", "eq_num_attr", "joint_ent", "mut_inf", "ns_ratio"),
    "model-based": ("leaves", "leaves_branch", "leaves_corrob", "leaves_homo", "leaves_per_class", "nodes", "nodes_per_attr", "nodes_per_inst", "nodes_per_level", "nodes_repeated", "tree_depth", "tree_imbalance", "tree_shape", "var_importance"),
    "landmarking": ("best_node", "elite_nn", "linear_discr", "naive_bayes", "one_nn", "random_node", "worst_node"),
    "clustering": ("ch", "int", "nre", "pb", "sc", "sil", "vdb", "vdu"),
    "concept": ("cohesiveness", "conceptvar", "impconceptvar", "wg_dist"),
    "itemset": ("one_itemset", "two_itemset"),
    "complexity": ("c1", "c2", "cls_coef", "density", "f1", "f1v", "f2", "f3", "f4", "hubs", "l1", "l2", "l3", "lsc", "n1", "n2", "n3", "n4", "t1"),
}
CLASS_ONLY = frozenset(f for names in CLASS_ONLY_BY_GROUP.values() for f in names)
#: Statistics of one numeric column, of a pair of numeric columns or of their covariance matrix, and single values of a split.
ATTRIBUTE = ("g_mean", "h_mean", "iq_range", "kurtosis", "mad", "max", "mean", "median", "min", "range", "sd", "skewness", "t_mean", "var")
PAIRED = ("cor", "cov")
MATRIX = ("eigenvalues",)
ANY_ATTRIBUTE = ("sparsity",)
SHAPE_COUNTS = ("nr_norm", "nr_outliers")
SINGLE_STATISTICAL = ("nr_cor_attr", *SHAPE_COUNTS, *SCATTER)
CLASS_ARRAYS = ("can_cor",)
STATISTICAL = (*ATTRIBUTE, *PAIRED, *MATRIX, *ANY_ATTRIBUTE, *CLASS_ARRAYS)
GENERAL = ("attr_to_inst", "inst_to_attr", "nr_attr", "nr_bin", "nr_cat", "nr_inst", "nr_num", "num_to_cat", "cat_to_num")
SINGLE_GENERAL = (*GENERAL, "nr_class")
CLASS_SHARES = ("freq_class",)
INFO = ("attr_conc", "attr_ent", *INFORMATION)
COMPLEXITY = ("t2", "t3", "t4")
TRIMMED = 0.2  # share of the values that the trimmed mean leaves out at each end
RELATED = 0.5  # absolute correlation from which a pair counts as correlated
EXPLAINED = 0.95  # share of the variance that the components counted by t3 and t4 explain
SUMMARIES = ("mean", "sd", "count", "histogram", "iq_range", "kurtosis", "max", "median", "min", "quantiles", "range", "skewness")
HISTOGRAM_BINS = 10


def raw_feature(column: str) -> str:
    """The feature of an external column, the empty text for others."""
    return column.removeprefix(PREFIX).split(".", 1)[0] if column.startswith(PREFIX) else ""


def has_summary(column: str, summaries: Sequence[str] = SUMMARIES) -> bool:
    name = column.removeprefix(PREFIX)
    return "." in name and name.split(".", 1)[1].split(".", 1)[0] in summaries


def catalog(groups: Sequence[str]) -> list[tuple[str, str, bool]]:
    """``(group, feature, class only)`` of what the groups offer here."""
    known = {"general": (*SINGLE_GENERAL, *CLASS_SHARES), "statistical": (*STATISTICAL, *SINGLE_STATISTICAL), "info-theory": (*INFO, *SINGLE_INFORMATION), "complexity": COMPLEXITY}
    return [(g, f, f in CLASS_ONLY) for g in groups for f in known.get(g, ())]


def prepared(sr: SplitRows) -> DataFrame:
    """Categories filled with the most frequent value (the smallest of several) and coded from 0 in order of their names; numbers filled with
    the median of their split.

    Fills and codes come from value counts, one row per split and feature, and meet the rows by joins: no window holds a split."""
    sr = sr.expanded()
    counts, profile = value_counts(sr), profiles(sr)
    out = sr.rows
    for f in sr.numeric:
        mid = profile.where(F.col("feature") == f).select(*SPLIT, F.col("mid").alias("__fill"))
        out = out.join(mid, SPLIT, "left").withColumn(f, F.coalesce(as_number(sr.rows.schema[f]), "__fill")).drop("__fill")
    for f in sr.categorical:
        own = counts.where((F.col("feature") == f) & F.col("cat").isNotNull())
        fill = own.groupBy(*SPLIT).agg(F.min_by("cat", F.struct(-F.col("k"), "cat")).alias("__fill"))
        code = own.select(*SPLIT, F.col("cat").alias("__value"), (F.row_number().over(Window.partitionBy(*SPLIT).orderBy("cat")) - 1).cast("double").alias("__code"))
        out = out.join(fill, SPLIT, "left").withColumn("__value", F.coalesce(F.col(f"`{f}`").cast("string"), "__fill")).join(code, [*SPLIT, "__value"], "left").withColumn(f, F.col("__code")).drop("__fill", "__value", "__code")
    return out


def per_attribute(profile: DataFrame, counts: DataFrame) -> DataFrame:
    """``split, feature, stat, value``: the statistics of every numeric column and the sparsity of every column, from profile and value counts."""
    x, k, n = F.col("num"), F.col("k"), F.col("n_values")
    known = counts.where("num is not null").join(profile.where("kind = 'num'").select(*SPLIT, "feature", "mid", "n_values"), [*SPLIT, "feature"])
    w = Window.partitionBy(*SPLIT, "feature").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.floor(n * TRIMMED)
    inside = F.greatest(F.lit(0), F.least(F.col("up"), n - cut) - F.greatest(F.col("up") - k, cut))
    far = F.abs(x - F.col("mid"))
    place = (n - 1) * 0.5
    at = lambda p: F.min(F.when(F.col("near") > p, F.col("far")))  # noqa: E731  the value at a place of the ascending distances
    rows = known.withColumns({"up": F.sum(k).over(w.orderBy("num")), "far": far}).withColumn("near", F.sum(k).over(w.orderBy("far")))
    more = rows.groupBy(*SPLIT, "feature").agg(
        F.try_divide(F.sum(inside * x), F.sum(inside)).alias("t_mean"), (1.4826 * (at(F.floor(place)) + at(F.ceil(place))) / 2).alias("mad"),
        F.when(F.min(x) > 0, F.exp(F.try_divide(F.sum(k * F.ln(x)), F.sum(k)))).when(F.min(x) == 0, F.lit(0.0)).alias("g_mean"),
    )
    repeats = F.try_divide(F.try_divide(F.col("n_values"), F.col("n_distinct")) - 1, F.col("n_values") - 1)  # 0: all values differ, 1: all are alike
    own = {"iq_range": F.col("q3") - F.col("q1"), "median": F.col("mid"), "range": F.col("high") - F.col("low"), "max": F.col("high"), "min": F.col("low"), "sd": F.col("std"), "var": F.col("std") * F.col("std"), "kurtosis": F.col("kurt"), "skewness": F.col("skew"), "h_mean": F.col("hmean")}
    wide = profile.where("n_values > 0").join(more, [*SPLIT, "feature"], "left").withColumns(own | {"sparsity": repeats})
    values = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in (*ATTRIBUTE, *ANY_ATTRIBUTE)))
    return wide.select(*SPLIT, "feature", "kind", F.inline(values)).where((F.col("kind") == "num") | F.col("stat").isin(*ANY_ATTRIBUTE)).drop("kind")


def attribute_entropy(counts: DataFrame) -> DataFrame:
    """``split, feature, stat, value``: entropy in bits of every categorical column."""
    n, k = F.sum("k"), F.col("k")
    return counts.where("cat is not null").groupBy(*SPLIT, "feature").agg((F.log2(n) - F.try_divide(F.sum(k * F.log2(k)), n)).alias("value")).select(*SPLIT, "feature", F.lit("attr_ent").alias("stat"), "value")


def attribute_concentration(sr: SplitRows) -> DataFrame:
    """``split, feature, stat, value``: for each ordered pair of categorical columns, how much knowing the first one improves the guess of the
    second (Goodman and Kruskal's tau); counts of value pairs, quadratic in the columns."""
    text = {f: F.col(f"`{f}`").cast("string") for f in sr.categorical}
    met = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text[a].alias("va"), text[b].alias("vb")) for a in text for b in text if a != b]
    if not met:
        return sr.keys().select(*SPLIT, F.lit("").alias("feature"), F.lit("attr_conc").alias("stat"), F.lit(None).cast("double").alias("value")).where("false")
    parts = sr.rows.select(*sr.key, F.inline(F.array(*met))).where("va is not null and vb is not null").groupBy(*sr.key, "a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("k"))
    pairs = sr.to_splits(parts).groupBy(*SPLIT, "a", "b", "va", "vb").agg(F.sum("k").alias("k"))
    by = [*SPLIT, "a", "b"]
    rows = pairs.groupBy(*by, "va").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("s")).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("s") / F.col("n")).alias("s"))
    columns = pairs.groupBy(*by, "vb").agg(F.sum("k").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.col("m")).alias("m"))
    guess = F.col("m") / (F.col("n") * F.col("n"))
    return rows.join(columns, by).select(*SPLIT, F.concat_ws("|", "a", "b").alias("feature"), F.lit("attr_conc").alias("stat"), F.try_divide(F.col("s") / F.col("n") - guess, 1 - guess).alias("value"))


def paired(products: DataFrame) -> DataFrame:
    """``split, feature, stat, value``: absolute correlation and covariance of the numeric pairs (:func:`.pairs.moments` over whole rows)."""
    rows = products.where("a <> b and n >= 2").withColumns({"cov": F.abs(F.col("sp") / (F.col("n") - 1)), "cor": F.abs(F.try_divide(F.col("sp"), F.nullif(F.sqrt("ss_a") * F.sqrt("ss_b"), F.lit(0.0))))})
    return rows.select(*SPLIT, F.concat_ws("|", "a", "b").alias("feature"), F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in PAIRED))))


def eigenvalues(products: DataFrame) -> DataFrame:
    """``split, feature, stat, value``: eigenvalues of the covariance matrix of the numeric columns.  A group is one matrix of a split with as many columns
    as it has numbers, at most ``MAX_FEATURES``: wider splits have none."""
    wide = products.where("a = b").groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("p")).where(F.col("p") <= MAX_FEATURES).drop("p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {f: k for k, f in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = (pdf["sp"] / (pdf["n"] - 1)).to_numpy()
        values = np.linalg.eigvalsh(m)
        out = pd.DataFrame({"feature": [f"e{k}" for k in range(len(values))], "stat": "eigenvalues", "value": values})
        for c in SPLIT[::-1]:
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return products.where("n >= 2").join(wide, SPLIT, "left_semi").groupBy(*SPLIT).applyInPandas(run, "dataset string, repeat int, fold int, feature string, stat string, value double")


def components(values: DataFrame, rows: DataFrame) -> DataFrame:
    """``split, column, value`` of the ratios of columns, principal components and rows.  ``values``: :func:`eigenvalues`; ``rows``: split, n, d."""
    w = Window.partitionBy(*SPLIT).orderBy(F.desc("value"), "feature")
    share = values.withColumns({"up": F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("value").over(Window.partitionBy(*SPLIT))})
    used = share.groupBy(*SPLIT).agg((F.sum((F.col("up") < F.col("all") * EXPLAINED * (1 - 1e-12)).cast("int")) + 1).alias("c"))
    out = rows.join(used, SPLIT, "left").withColumns({"t2": F.try_divide(F.col("d"), F.col("n")), "t3": F.try_divide(F.col("c"), F.col("n")), "t4": F.try_divide(F.col("c"), F.col("d"))})
    return out.select(*SPLIT, F.inline(F.array(*(F.struct(F.lit(PREFIX + t).alias("column"), F.col(t).cast("double").alias("value")) for t in COMPLEXITY))))


def related_pairs(pairs: DataFrame) -> DataFrame:
    """``split, nr_cor_attr``: the share of correlated pairs."""
    return pairs.where("stat = 'cor'").groupBy(*SPLIT).agg(F.avg((F.coalesce("value", F.lit(0.0)) >= RELATED).cast("double")).alias("nr_cor_attr"))


def summarise(values: DataFrame, summaries: Sequence[str]) -> DataFrame:
    """``split, column, value``: the statistics of a split's columns, summarised over the columns."""
    v = F.col("value")
    q = F.percentile(v, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    one = values.groupBy(*SPLIT, "stat").agg(q.alias("q"), F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), sample_kurtosis(v).alias("kurtosis"), sample_skewness(v).alias("skewness"))
    plain: dict[str, Column] = {s: F.col(s) for s in ("count", "mean", "sd", "min", "max", "kurtosis", "skewness")} | {"median": F.col("q")[2], "range": F.col("max") - F.col("min"), "iq_range": F.col("q")[3] - F.col("q")[1]}
    items = [(s, plain[s]) for s in summaries if s in plain]
    if "quantiles" in summaries:
        items += [(f"quantiles.{k}", F.col("q")[k]) for k in range(5)]
    rows = []
    if items:
        rows.append(one.select(*SPLIT, "stat", F.inline(F.array(*(F.struct(F.lit(s).alias("summary"), c.cast("double").alias("value")) for s, c in items)))))
    if "histogram" in summaries:
        edge = values.join(one.select(*SPLIT, "stat", "min", "max", "count"), [*SPLIT, "stat"]).where("value is not null")
        place = F.when(F.col("max") > F.col("min"), F.least(F.lit(HISTOGRAM_BINS - 1), F.floor((v - F.col("min")) / (F.col("max") - F.col("min")) * HISTOGRAM_BINS))).otherwise(HISTOGRAM_BINS // 2)
        share = [F.struct(F.lit(f"histogram.{k}").alias("summary"), F.avg((F.col("bin") == k).cast("double")).alias("value")) for k in range(HISTOGRAM_BINS)]
        rows.append(edge.withColumn("bin", place.cast("int")).groupBy(*SPLIT, "stat").agg(F.array(*share).alias("h")).select(*SPLIT, "stat", F.inline("h")))
    if not rows:
        return values.select(*SPLIT, F.col("stat").alias("column"), "value").where("false")
    return reduce(DataFrame.unionByName, rows).select(*SPLIT, F.concat(F.lit(PREFIX), "stat", F.lit("."), "summary").alias("column"), "value")


def general(sr: SplitRows, profile: DataFrame, shape: bool = False) -> DataFrame:
    """``split, column, value`` of counts and ratios; a binary feature has exactly two values.  With ``shape`` also the numbers of normal columns and of
    those with values beyond 1.5 quartile ranges: one look at the profile for all."""
    flag = lambda c: F.sum(c.cast("double"))
    counts = [F.count(F.lit(1)).cast("double").alias("nr_attr"), flag(F.col("n_distinct") == 2).alias("nr_bin"), flag(F.col("kind") == "cat").alias("nr_cat"), flag(F.col("kind") == "num").alias("nr_num")]
    more = [flag((F.col("kind") == "num") & (F.col("outside") > 0)).alias("nr_outliers"), normal_count()] if shape else []
    rows = split_rows(sr).select(*SPLIT, F.col("n").cast("double").alias("nr_inst")).join(profile.groupBy(*SPLIT).agg(*counts, *more), SPLIT)
    div = lambda a, b: F.try_divide(F.col(a), F.col(b))
    rows = rows.withColumns({"attr_to_inst": div("nr_attr", "nr_inst"), "inst_to_attr": div("nr_inst", "nr_attr"), "num_to_cat": div("nr_num", "nr_cat"), "cat_to_num": div("nr_cat", "nr_num")})
    return _named(rows, (*GENERAL, *SHAPE_COUNTS) if shape else GENERAL)


def _named(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``split, column, value`` of single values."""
    return table.select(*SPLIT, F.inline(F.array(*(F.struct(F.lit(PREFIX + c).alias("column"), F.col(c).cast("double").alias("value")) for c in names))))


def external_columns(groups: Sequence[str], summaries: Sequence[str]) -> list[str]:
    """The columns that :func:`external` gives for these groups and summaries, group by group."""
    tail = [s for s in summaries if s not in ("histogram", "quantiles")] + [f"quantiles.{k}" for k in range(5) if "quantiles" in summaries] + [f"histogram.{k}" for k in range(HISTOGRAM_BINS) if "histogram" in summaries]
    single = {"general": SINGLE_GENERAL, "statistical": SINGLE_STATISTICAL, "info-theory": SINGLE_INFORMATION, "complexity": COMPLEXITY}
    summed = {"general": CLASS_SHARES, "statistical": STATISTICAL, "info-theory": INFO}
    return [c for g in single | summed if g in groups for c in [*(PREFIX + f for f in single.get(g, ())), *(f"{PREFIX}{f}.{t}" for f in summed.get(g, ()) for t in tail)]]


def external(sr: SplitRows, groups: Sequence[str] = ("general", "statistical", "info-theory"), summaries: Sequence[str] = ("mean", "sd"), profile: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """The descriptors of the groups, one row per split with one column each.

    With ``stored``, value counts, profile, products and counts by class are written first: every look at the rows is then taken once, where one lazy
    plan takes it for each statistic that starts from it."""
    keep = written if stored else lambda df, name: df
    v = values(sr).stored() if stored else values(sr)
    if profile is None:
        profile = stored_profiles(sr, v=v) if stored else profiles(sr)
    counts = wanted(sr, v.by_split())
    products = keep(moments(sr, whole=True), "products") if {"statistical", "complexity"} & set(groups) else None
    classes = keep(class_counts(sr), "classes") if {"general", "info-theory"} & set(groups) else None
    parts = [general(sr, profile, "statistical" in groups)] if {"general", "statistical"} & set(groups) else []
    if "general" in groups:
        n = F.sum("k").over(Window.partitionBy(*SPLIT))
        shares = classes.select(*SPLIT, F.col("y").alias("feature"), F.lit("freq_class").alias("stat"), (F.col("k") / n).alias("value"))
        parts += [summarise(shares, summaries), _named(classes.groupBy(*SPLIT).agg(F.count(F.lit(1)).cast("double").alias("nr_class")), ("nr_class",))]
    if "statistical" in groups:
        pairs = paired(products)
        apart = keep(class_scatter(keep(class_products(sr), "class-products")), "scatter")
        roots = apart.select(*SPLIT, F.posexplode("can_cor").alias("at", "value")).select(*SPLIT, F.concat(F.lit("c"), "at").alias("feature"), F.lit("can_cor").alias("stat"), "value")
        found = keep(reduce(DataFrame.unionByName, (per_attribute(profile, counts), pairs, eigenvalues(products), roots)), "statistics")
        parts += [summarise(found, summaries), _named(related_pairs(pairs), ("nr_cor_attr",)), _named(apart, SCATTER)]
    if "info-theory" in groups:
        told = keep(information(keep(contingency(sr), "contingency")), "information")
        shared = told.select(*SPLIT, "feature", F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in INFORMATION))))
        found = keep(reduce(DataFrame.unionByName, (attribute_entropy(counts), attribute_concentration(sr), shared)), "shared")
        parts += [summarise(found, summaries), _named(class_information(told, classes), SINGLE_INFORMATION)]
    if "complexity" in groups:
        size = profile.groupBy(*SPLIT).agg(F.max("n_rows").alias("n"), F.count(F.lit(1)).alias("d"))
        parts.append(components(eigenvalues(products), size))
    keys = sr.keys().drop("kind")
    if not parts:
        return keys
    names = external_columns(groups, summaries)
    return keys.join(reduce(DataFrame.unionByName, parts).groupBy(*SPLIT).pivot("column", names).agg(F.first("value")), SPLIT, "left")
