"""The registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import finite
from ..operators import analysis, associations, classwise, descriptors, external, features, followups, gaps, irregularity, predictive, ranks, redundancy, sensitivity
from ..plans.store import content_hash, failures, patch_absent_categories, with_identity
from ..schemas import BASIC, GROUP, SPLIT
from ..sources.metadata import metadata_of, problem_types_payload, sample_datasets, splits_of, without_problem_types
from ..sources.results import decode_splits, select_results
from ..sources.scratch import written
from ..sources.splits import repeated_samples
from . import inputs, twins
from .inputs import COMPARISONS, FAMILIES, MAIN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REPEATS = associations.REPEATS
PARTS = twins.PARTS


def query(sql: str | None = None):
    """Registers a query under its function's name, with rounded doubles, and its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = twins.six_digits(sql)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero: engines add in different orders.  Nine digits first, then steps that every engine
    takes alike, so a value between two sixth digits goes the same way."""
    six = lambda c: F.floor(F.round(finite(c), 9) * 1000000 + 0.5) / 1000000 + 0.0
    return df.select(*(six(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.pairwise_gaps(inputs.results(spark, sf_dir), COMPARISONS, inputs.ANALYSIS.error_column, inputs.ANALYSIS.selection)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic descriptors and the irregularity components that are aggregates.  The components go to six digits here: z-scores of a component
    that hardly varies would blow up the engines' last bits."""
    sr = inputs.train_splits(spark, sf_dir)
    profile = descriptors.stored_profiles(sr)
    return descriptors.basic(sr, profile).join(irregularity.profile_components(profile), SPLIT, "left").select(*SPLIT, *BASIC, *(F.round(c, 6).alias(c) for c in PARTS))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gaps and descriptors as written tables: the composite reads each of them several times."""
    return written(_gaps(spark, sf_dir), "gaps"), written(_described(spark, sf_dir), "described")


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.dataset_level(*_sides(spark, sf_dir), PARTS)


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the main comparison, rounded as in the oracle before anything is ranked; a written table, as tests and resamples read it many times."""
    rows = _analysis(spark, sf_dir).where(F.col("comparison_name") == MAIN)
    r9 = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)
    return written(rows.select("dataset", r9("delta_norm"), *(r9(c) for c in twins.TESTED)), "main")


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations.observations(_main(spark, sf_dir), twins.TESTED)


# --- results and gaps -----------------------------------------------------------------------------------------


@query(f"WITH {twins.GAPS} SELECT {twins.GAP_NAMES}, best_a_method, {twins.r6('best_a_error best_a_norm_error')}, best_b_method, {twins.r6('best_b_error best_b_norm_error delta_raw delta_norm')} FROM gaps")
def gap_table(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(f"WITH {twins.RESULTS} SELECT dataset, fold, method, config_type, method_subtype, {twins.r6('metric_error metric_error_val')}, imputed FROM results")
def loaded_results(spark, sf_dir):
    return inputs.results(spark, sf_dir)


@query(f"WITH {twins.RESULTS} SELECT dataset, fold AS split_id, CAST(fold // 3 AS INTEGER) AS repeat, CAST(fold % 3 AS INTEGER) AS fold, count(*) AS n FROM results GROUP BY dataset, results.fold")
def decoded_splits(spark, sf_dir):
    return decode_splits(inputs.results(spark, sf_dir)).groupBy("dataset", "split_id", "repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


SPARSE = 15  # results of fewer rows count as imputed here, so that whole families are missing in some splits


@query(f"""WITH {twins.GAPS.replace("k >= 5", f"k >= {SPARSE}").replace("k < 5", f"k < {SPARSE}")},
every AS (SELECT DISTINCT s.dataset, s.repeat, s.fold, m.comparison_name, m.group_a_name AS ga, m.group_b_name AS gb FROM scaled s, members m),
sides AS (SELECT e.*, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM every e LEFT JOIN candidates c USING (comparison_name, dataset, repeat, fold) GROUP BY ALL),
gone AS (SELECT comparison_name, ga AS group_name, dataset, repeat, fold FROM sides WHERE na = 0 AND nb > 0 UNION ALL SELECT comparison_name, gb, dataset, repeat, fold FROM sides WHERE nb = 0 AND na > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY comparison_name, group_name ORDER BY dataset, repeat, fold) AS nth FROM gone)
SELECT comparison_name, group_name, count(*) AS n_missing, string_agg(dataset || '/r' || repeat || '/f' || fold, ', ' ORDER BY nth) FILTER (nth <= 3) AS examples FROM numbered GROUP BY ALL""")
def missing_family(spark, sf_dir):
    return gaps.missing_families(inputs.results(spark, sf_dir, SPARSE), COMPARISONS, inputs.ANALYSIS.error_column, inputs.ANALYSIS.selection)


@query(f"WITH {twins.RESULTS}, {twins.FAMILY} SELECT group_name, config_type FROM families WHERE config_type NOT IN (SELECT config_type FROM results)")
def absent_members(spark, sf_dir):
    return gaps.absent_members(inputs.results(spark, sf_dir), FAMILIES)


@query(f"WITH {twins.RESULTS} SELECT method_subtype, config_type, count(*) AS n FROM results GROUP BY ALL")
def subtype_counts(spark, sf_dir):
    return gaps.value_counts(inputs.results(spark, sf_dir), "method_subtype", "config_type")


@query(f"""WITH {twins.GAPS}, s AS (SELECT comparison_name, dataset, count(*) AS n_splits, avg(delta_norm) AS delta_mean, stddev_samp(delta_norm) AS delta_std, min(delta_norm) AS delta_min, max(delta_norm) AS delta_max, avg(CASE WHEN delta_norm > 0 THEN 1.0 ELSE 0.0 END) AS a_worse_share FROM gaps GROUP BY ALL)
SELECT comparison_name, dataset, n_splits, {twins.r6('delta_mean delta_std delta_min delta_max a_worse_share')} FROM s""")
def gap_summary(spark, sf_dir):
    return gaps.gap_summary(_gaps(spark, sf_dir))


@query("""SELECT DISTINCT 'd' || p_size AS dataset FROM part WHERE p_size % 3 <> 2""")
def scope_by_problem_type(spark, sf_dir):
    meta = inputs.metadata(spark, sf_dir)
    return without_problem_types(meta.select("dataset"), meta, ["regression"])


@query("""SELECT DISTINCT 'd' || p_size AS dataset, CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, CAST(p_size AS BIGINT) AS tid, CASE p_size % 3 WHEN 0 THEN 'multiclass' WHEN 1 THEN 'binary' ELSE 'regression' END AS problem_type
FROM part, (VALUES (0), (1), (2)) a(r), (VALUES (0), (1), (2)) b(f)""")
def split_dimensions(spark, sf_dir):
    return splits_of(inputs.metadata(spark, sf_dir))


@query("SELECT 'd' || p_size AS dataset, CAST(p_size AS BIGINT) AS tid FROM (SELECT DISTINCT p_size FROM part) WHERE p_size IN (3, 7, 50)")
def named_metadata(spark, sf_dir):
    return metadata_of(inputs.metadata(spark, sf_dir), ["d3", "d7", "d50", "none"]).select("dataset", "tid")


@query("SELECT dataset FROM (SELECT DISTINCT 'd' || p_size AS dataset FROM part) WHERE dataset <> 'd1' ORDER BY md5('4|' || dataset), dataset LIMIT 12")
def sampled_datasets(spark, sf_dir):
    """The limit is the operator: a sample of twelve datasets."""
    return sample_datasets(inputs.metadata(spark, sf_dir), 12, 4, ["d1"])


@query("SELECT DISTINCT 'd' || p_size AS dataset, CASE p_size % 3 WHEN 0 THEN 'multiclass' WHEN 1 THEN 'binary' ELSE 'regression' END AS problem_type FROM part")
def problem_types(spark, sf_dir):
    return problem_types_payload(inputs.metadata(spark, sf_dir))


@query("""SELECT 'd' || (l_suppkey % 5) AS dataset, 0 AS repeat, CAST(l_linenumber AS INTEGER) AS fold, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_rows(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("dataset"), F.lit(0).alias("repeat"), F.col("l_linenumber").cast("int").alias("fold"), "l_partkey")
    return repeated_samples(rows, "l_partkey")


@query(f"WITH {twins.RESULTS} SELECT dataset, fold, method, {twins.r6('metric_error metric_error_val')} FROM results WHERE method NOT LIKE '%m1%' AND dataset IN ('d1', 'd2', 'd3')")
def excluded_methods(spark, sf_dir):
    chosen = replace(inputs.ANALYSIS, exclude_methods_containing=("m1",))
    return select_results(inputs.raw_results(spark, sf_dir), chosen, ["d1", "d2", "d3"]).select("dataset", "fold", "method", "metric_error", "metric_error_val")


@query(f"WITH {twins.RESULTS} SELECT dataset, fold, method, {twins.r6('metric_error')} FROM results WHERE method IN ('m0', 'm4')")
def results_by_method(spark, sf_dir):
    kept = select_results(inputs.raw_results(spark, sf_dir), inputs.ANALYSIS, methods=["m0", "m4"])
    return kept.select("dataset", "fold", "method", "metric_error")


@query(f"""WITH {twins.ROWS} SELECT dataset, repeat, fold, sha2 AS identity FROM (SELECT DISTINCT dataset, repeat, fold, sha256('{content_hash({"set": "basic"})}|' || problem_type) AS sha2 FROM train)""")
def split_identity(spark, sf_dir):
    return with_identity(inputs.train_splits(spark, sf_dir).keys(), {"set": "basic"}, "kind").drop("kind")


@query("""SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'basic' ELSE 'pymfe' END AS feature_set, CASE WHEN l_linenumber % 2 = 0 THEN 'no value' ELSE 'timeout' END AS reason, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL""")
def failed_set_counts(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.when(n > 4, F.lit("{}")).when(n % 2 == 0, F.lit('{"basic": "no value"}')).otherwise(F.lit('{"pymfe": "timeout"}'))
    return failures(inputs.table(spark, sf_dir, "lineitem").select(text.alias("failed_sets")))


# --- descriptors ----------------------------------------------------------------------------------------------


def _described_sql(source: str, columns: list[str], integers: tuple[str, ...] = ()) -> str:
    names = ", ".join(c if c in integers else f"round({c}, 6) + 0.0 AS {c}" for c in columns)
    return f"WITH {twins.DESCRIPTORS} SELECT dataset, repeat, fold, {names} FROM {source}"


_SIZE = ["n", "d", "log_n", "log_d", "n_over_d", "d_over_n", "n_num_features", "n_cat_features", "num_fraction", "cat_fraction", "missing_fraction"]
_COUNTS = ("n", "d", "n_num_features", "n_cat_features", "n_classes")


@query(_described_sql("d_size", _SIZE, _COUNTS))
def desc_size(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return descriptors.size(descriptors.split_rows(sr), descriptors.of_profile(descriptors.presence(sr))).select(*SPLIT, *_SIZE)


@query(_described_sql("d_target", ["n_classes", "class_entropy", "majority_class_fraction", "minority_class_fraction", "class_imbalance_ratio"], _COUNTS))
def desc_target(spark, sf_dir):
    return descriptors.target(inputs.train_splits(spark, sf_dir))


def _found(spark, sf_dir, *columns: str, shape: bool = False) -> DataFrame:
    return descriptors.of_profile(descriptors.stored_profiles(inputs.train_splits(spark, sf_dir), shape)).select(*SPLIT, *columns)


_CARD = ["mean_cat_cardinality", "max_cat_cardinality", "high_cardinality_fraction"]
_MISSING = ["feature_missing_fraction", "num_missing_fraction", "cat_missing_fraction", "max_feature_missing_fraction"]
_SHAPE = ["mean_abs_skew", "max_abs_skew", "mean_kurtosis", "outlier_fraction_iqr", "zero_fraction"]
_INFO = ["constant_feature_fraction", "near_constant_feature_fraction"]


@query(_described_sql("d_card", _CARD))
def desc_cardinality(spark, sf_dir):
    return _found(spark, sf_dir, *_CARD)


@query(_described_sql("d_missing", ["row_missing_fraction", *_MISSING]))
def desc_missing(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return descriptors.split_rows(sr).drop("n").join(descriptors.of_profile(descriptors.presence(sr)).select(*SPLIT, *_MISSING), SPLIT)


@query(_described_sql("d_shape", _SHAPE))
def desc_shape(spark, sf_dir):
    return _found(spark, sf_dir, *_SHAPE, shape=True)


@query(_described_sql("d_info", _INFO))
def desc_low_info(spark, sf_dir):
    return _found(spark, sf_dir, *_INFO)


@query(_described_sql("described", BASIC, _COUNTS))
def desc_basic(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return descriptors.basic(sr, descriptors.stored_profiles(sr)).select(*SPLIT, *BASIC)


@query(_described_sql("d_irreg", PARTS))
def irregularity_parts(spark, sf_dir):
    return irregularity.profile_components(descriptors.stored_profiles(inputs.train_splits(spark, sf_dir)))


@query()
def irregularity_all(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return irregularity.irregularity(sr, descriptors.stored_profiles(sr))


_NUMBERS = ("discount", "price", "quantity", "tax")
_EACH = " UNION ALL ".join(f"SELECT dataset, repeat, fold, '{a}{b}' AS pair, {a} AS x, {b} AS y FROM train WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in _NUMBERS for b in _NUMBERS if a < b)


@query(f"""WITH {twins.ROWS}, met AS ({_EACH}),
r AS (SELECT dataset, repeat, fold, pair, abs({twins.correlation("x", "y")}) AS r FROM met GROUP BY ALL),
s AS (SELECT dataset, repeat, fold, avg(r) AS mean_abs_corr, max(r) AS max_abs_corr, avg(CASE WHEN r > 0.9 THEN 1.0 ELSE 0.0 END) AS high_corr_pair_fraction FROM r WHERE r IS NOT NULL GROUP BY ALL)
SELECT dataset, repeat, fold, {twins.r6("mean_abs_corr max_abs_corr high_corr_pair_fraction")} FROM s""")
def corr_summary(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return redundancy.correlation_summary(redundancy.correlations(sr, redundancy.varying_features(descriptors.stored_profiles(sr, shape=False))))


@query(f"""WITH {twins.ROWS}, s AS (SELECT {", ".join(SPLIT)}, stddev_pop(quantity) AS sa, stddev_pop(discount) AS sd FROM train GROUP BY ALL),
w AS (SELECT {", ".join(SPLIT)}, var_samp(quantity) AS a, var_samp(discount) AS d, covar_samp(quantity, discount) AS b FROM train WHERE quantity IS NOT NULL AND discount IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT {", ".join(SPLIT)}, a / (sa * sa) AS a, d / (sd * sd) AS d, b / (sa * sd) AS b FROM w JOIN s USING ({", ".join(SPLIT)})),
e AS (SELECT {", ".join(SPLIT)}, (a + d - sqrt((a - d) ** 2 + 4 * b * b)) / 2 AS irreg_min_cov_eig FROM c)
SELECT {", ".join(SPLIT)}, {twins.r6("irreg_min_cov_eig")} FROM e""")
def smallest_eigenvalue(spark, sf_dir):
    """On two columns, one with missing values, where it has a closed form."""
    sr = replace(inputs.train_splits(spark, sf_dir), features=["quantity", "discount"])
    return irregularity.smallest_eigenvalue(sr, descriptors.stored_profiles(sr))


@query(f"""WITH {twins.ROWS}, met AS (SELECT {", ".join(SPLIT)}, abs({twins.correlation("quantity", "discount")}) AS r FROM train WHERE quantity IS NOT NULL AND discount IS NOT NULL GROUP BY ALL),
p AS (SELECT *, (1 + r) / 2 AS p, (1 - r) / 2 AS q FROM met),
e AS (SELECT {", ".join(SPLIT)}, exp(-(p * ln(p) + CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END)) AS effective_rank, 1 / (p * p + q * q) AS participation_ratio FROM p)
SELECT {", ".join(SPLIT)}, {twins.r6("effective_rank participation_ratio")} FROM e""")
def correlation_rank(spark, sf_dir):
    """On two columns, whose correlation matrix has the eigenvalues 1 + r and 1 - r."""
    sr = replace(inputs.train_splits(spark, sf_dir), features=["quantity", "discount"])
    return redundancy.correlation_rank(redundancy.correlations(sr, redundancy.varying_features(descriptors.stored_profiles(sr, shape=False))))


@query()
def redundancy_wide(spark, sf_dir):
    return redundancy.redundancy(inputs.wide_splits(spark, sf_dir))


@query()
def external_descriptors(spark, sf_dir):
    return external.external(inputs.train_splits(spark, sf_dir), summaries=external.SUMMARIES, stored=True)


_K3 = ", ".join(SPLIT)
_ENTROPY = "log2(sum(k)) - sum(k * log2(k)) / sum(k)"
_CONTINGENCY = f"""{twins.ROWS},
met AS (SELECT {_K3}, 'linestatus' AS feature, linestatus AS v, y FROM train WHERE problem_type <> 'regression' UNION ALL SELECT {_K3}, 'brand', brand, y FROM train WHERE problem_type <> 'regression'),
c AS (SELECT {_K3}, feature, v, y, count(*) AS k FROM met WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
cx AS (SELECT {_K3}, feature, v, sum(k) AS k, sum(k * k) AS s FROM c GROUP BY ALL),
cy AS (SELECT {_K3}, feature, y, sum(k) AS k FROM c GROUP BY ALL),
hj AS (SELECT {_K3}, feature, {_ENTROPY} AS joint_ent FROM c GROUP BY ALL),
hx AS (SELECT {_K3}, feature, {_ENTROPY} AS attr, sum(s / k) / sum(k) AS held FROM cx GROUP BY ALL),
hy AS (SELECT {_K3}, feature, {_ENTROPY} AS h, sum(k * k) / (sum(k) * sum(k)) AS guess FROM cy GROUP BY ALL),
told AS (SELECT {_K3}, feature, attr, joint_ent, attr + h - joint_ent AS mut_inf, (held - guess) / nullif(1 - guess, 0) AS class_conc FROM hj JOIN hx USING ({_K3}, feature) JOIN hy USING ({_K3}, feature)),
ys AS (SELECT {_K3}, y, count(*) AS k FROM train WHERE problem_type <> 'regression' AND y IS NOT NULL GROUP BY ALL),
own AS (SELECT {_K3}, {_ENTROPY} AS class_ent FROM ys GROUP BY ALL)"""


@query(f"WITH {_CONTINGENCY} SELECT {_K3}, feature, {twins.r6('joint_ent mut_inf class_conc')} FROM told")
def class_association(spark, sf_dir):
    """What each categorical column shares with the class."""
    return classwise.information(classwise.contingency(inputs.train_splits(spark, sf_dir))).select(*SPLIT, "feature", *classwise.INFORMATION)


@query(f"""WITH {_CONTINGENCY}, m AS (SELECT {_K3}, avg(mut_inf) AS told, avg(attr) AS held FROM told GROUP BY ALL),
s AS (SELECT {_K3}, class_ent, class_ent / nullif(told, 0) AS eq_num_attr, (held - told) / nullif(told, 0) AS ns_ratio FROM own LEFT JOIN m USING ({_K3}))
SELECT {_K3}, {twins.r6("class_ent eq_num_attr ns_ratio")} FROM s""")
def class_information(spark, sf_dir):
    sr = inputs.train_splits(spark, sf_dir)
    return classwise.class_information(classwise.information(classwise.contingency(sr)), classwise.class_counts(sr))


_SCATTER = ["gravity", "lh_trace", "nr_disc", "p_trace", "roy_root", "sd_ratio", "w_lambda", "can_cor_mean"]


@query(f"""WITH {twins.ROWS}, t AS (SELECT {_K3}, y, quantity AS a, price AS b FROM train WHERE problem_type <> 'regression' AND y IS NOT NULL AND quantity IS NOT NULL AND price IS NOT NULL),
g AS (SELECT {_K3}, y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) AS aa, covar_pop(b, b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab FROM t GROUP BY ALL),
o AS (SELECT {_K3}, avg(a) AS oa, avg(b) AS ob FROM t GROUP BY ALL),
w AS (SELECT {_K3}, count(*) AS q, sum(n) AS n, sum(aa) AS w11, sum(bb) AS w22, sum(ab) AS w12, sum(n * (ma - oa) ** 2) AS b11, sum(n * (mb - ob) ** 2) AS b22, sum(n * (ma - oa) * (mb - ob)) AS b12,
  sum(n - 1) AS free, sum(1.0 / (n - 1)) AS inverse, sum((n - 1) * ln((aa * bb - ab * ab) / (n - 1) ** 2)) AS own,
  arg_max(ma, struct_pack(n := n, y := y)) AS xa, arg_max(mb, struct_pack(n := n, y := y)) AS xb, arg_min(ma, struct_pack(n := n, y := y)) AS ya, arg_min(mb, struct_pack(n := n, y := y)) AS yb
  FROM g JOIN o USING ({_K3}) GROUP BY {_K3}),
d AS (SELECT *, w11 * w22 - w12 * w12 AS dw, (w22 * b11 - 2 * w12 * b12 + w11 * b22) / (w11 * w22 - w12 * w12) AS tr, (b11 * b22 - b12 * b12) / (w11 * w22 - w12 * w12) AS det FROM w),
l AS (SELECT *, (tr + sqrt(greatest(0.0, tr * tr - 4 * det))) / 2 AS l1, greatest(0.0, (tr - sqrt(greatest(0.0, tr * tr - 4 * det))) / 2) AS l2 FROM d WHERE q > 2),
s AS (SELECT {_K3}, sqrt((xa - ya) ** 2 + (xb - yb) ** 2) AS gravity, l1 + l2 AS lh_trace, 2.0 AS nr_disc, l1 / (1 + l1) + l2 / (1 + l2) AS p_trace, l1 AS roy_root,
  exp((1 - 13.0 / (18 * (q - 1)) * (inverse - 1.0 / (n - q))) * (free * ln(dw / (n - q) ** 2) - own) / (2 * free)) AS sd_ratio, 1 / ((1 + l1) * (1 + l2)) AS w_lambda, (sqrt(l1 / (1 + l1)) + sqrt(l2 / (1 + l2))) / 2 AS can_cor_mean FROM l)
SELECT {_K3}, {twins.r6(_SCATTER)} FROM s""")
def class_scatter(spark, sf_dir):
    """On two columns, where the eigenvalues have a closed form."""
    sr = replace(inputs.train_splits(spark, sf_dir), features=["quantity", "price"])
    found = classwise.class_scatter(written(classwise.class_products(sr), "class-products"))
    mean = F.aggregate("can_cor", F.lit(0.0), lambda s, x: s + x) / F.size("can_cor")
    return found.withColumn("can_cor_mean", mean).select(*SPLIT, *_SCATTER)


@query(f"""WITH {twins.CELLS}, g AS (SELECT {_K3}, CAST(n_values AS DOUBLE) AS n, n_distinct, skew * (n_values - 2) / sqrt(CAST(n_values AS DOUBLE) * (n_values - 1)) AS g1, (kurt * (n_values - 2) * (n_values - 3) / (n_values - 1) - 6) / (n_values + 1) + 3 AS b2 FROM profile WHERE kind = 'num'),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g WHERE n >= 8 AND n_distinct > 1),
a AS (SELECT *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM s),
z AS (SELECT {_K3}, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM a)
SELECT {_K3}, round(CAST(coalesce(sum(CASE WHEN exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 THEN 1 ELSE 0 END), 0) AS DOUBLE), 6) AS nr_norm FROM (SELECT DISTINCT {_K3} FROM g) LEFT JOIN z USING ({_K3}) GROUP BY ALL""")
def normal_columns(spark, sf_dir):
    return descriptors.stored_profiles(inputs.train_splits(spark, sf_dir)).groupBy(*SPLIT).agg(classwise.normal_count())


@query(f"""WITH {twins.DESCRIPTORS} SELECT {", ".join(SPLIT)}, CAST(0 AS BIGINT) AS n_cat_features, 0.0::DOUBLE AS mean_cat_cardinality, 0.0::DOUBLE AS cat_missing_fraction, round(avg(missing), 6) + 0.0 AS missing_fraction
FROM profile WHERE kind = 'num' GROUP BY ALL""")
def cat_absence_patch(spark, sf_dir):
    """Splits without a categorical column."""
    sr = inputs.train_splits(spark, sf_dir)
    numbers = replace(sr, features=sr.numeric)
    return patch_absent_categories(descriptors.basic(numbers, descriptors.stored_profiles(numbers))).select(*SPLIT, "n_cat_features", "mean_cat_cardinality", "cat_missing_fraction", "missing_fraction")


# --- the analysis table ---------------------------------------------------------------------------------------

_NUM = ["best_a_error", "best_a_norm_error", "best_b_error", "best_b_norm_error", "delta_raw", "delta_raw_std", "delta_raw_sem", "delta_norm", "delta_norm_std", "delta_norm_sem", *twins.FEATURES, "irregularity"]


@query(f"WITH {twins.ANALYSIS} SELECT {', '.join(GROUP)}, n_splits, {twins.r6(_NUM)} FROM analysis")
def analysis_dataset(spark, sf_dir):
    return _analysis(spark, sf_dir).select(*GROUP, "n_splits", *(F.col(c).cast("double").alias(c) for c in _NUM))


@query(f"WITH {twins.ANALYSIS} SELECT j.dataset, repeat, fold, comparison_name, {twins.r6('delta_norm log_n missing_fraction irregularity')} FROM joined j LEFT JOIN composites USING (dataset)")
def analysis_fold(spark, sf_dir):
    return analysis.split_level(*_sides(spark, sf_dir), PARTS).select(*SPLIT, "comparison_name", "delta_norm", "log_n", "missing_fraction", "irregularity")


@query(f"""WITH {twins.GAPS}, {twins.DESCRIPTORS} SELECT g.dataset || '|' || g.repeat || '|' || g.fold AS unit, g.comparison_name, {twins.r6("delta_norm log_n class_entropy")}
FROM gaps g LEFT JOIN described USING (dataset, repeat, fold)""")
def gaps_with_descriptors(spark, sf_dir):
    """Every gap with the descriptors of its split, under the id of its unit: the split-level export."""
    sr = inputs.train_splits(spark, sf_dir)
    joined = analysis.gaps_with_descriptors(_gaps(spark, sf_dir), descriptors.basic(sr, descriptors.stored_profiles(sr)))
    return analysis.with_unit(joined, *SPLIT).select("unit", "comparison_name", "delta_norm", "log_n", "class_entropy")


@query(f"""WITH {twins.RESULTS}, families(config_type) AS (VALUES ('c0'), ('c1')),
scaled AS (SELECT dataset, fold AS split_id, method, method_subtype, config_type, metric_error AS eval, metric_error_val AS sel, {twins.normalised("metric_error")} AS eval_norm, {twins.normalised("metric_error_val")} AS sel_norm FROM results WINDOW w AS (PARTITION BY dataset, results.fold)),
best AS (SELECT * FROM scaled JOIN families USING (config_type) WHERE sel IS NOT NULL AND eval IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, split_id ORDER BY sel_norm, sel, method, method_subtype) = 1)
SELECT dataset, CAST(split_id // 3 AS INTEGER) AS repeat, CAST(split_id % 3 AS INTEGER) AS fold, method, round(eval, 6) + 0.0 AS error, round(eval_norm, 6) + 0.0 AS norm_error FROM best""")
def best_in_family(spark, sf_dir):
    return gaps.best_in_family(inputs.results(spark, sf_dir), inputs.LEFT, inputs.ANALYSIS.error_column, inputs.ANALYSIS.selection)


@query(f"WITH {twins.ANALYSIS} SELECT dataset, round(irregularity, 6) + 0.0 AS irregularity FROM composites")
def irregularity_composite(spark, sf_dir):
    return _analysis(spark, sf_dir).groupBy("dataset").agg(F.max("irregularity").alias("irregularity"))


@query(f"""WITH {twins.ANALYSIS}, kinds AS (SELECT DISTINCT 'd' || p_size AS dataset, CASE p_size % 3 WHEN 0 THEN 'multiclass' WHEN 1 THEN 'binary' ELSE 'regression' END AS task_type FROM part)
SELECT dataset, task_type, {twins.r6("delta_norm class_entropy log_n")} FROM analysis JOIN kinds USING (dataset) WHERE comparison_name = 'left_vs_right' AND task_type IN ('binary', 'multiclass')""")
def task_matrices(spark, sf_dir):
    rows = _analysis(spark, sf_dir).where(F.col("comparison_name") == MAIN)
    typed = analysis.with_task_type(rows.select("dataset", "delta_norm", *twins.TESTED), inputs.metadata(spark, sf_dir))
    return features.task_matrices(typed, twins.TESTED)[1].select("dataset", "task_type", "delta_norm", "class_entropy", "log_n")


# --- features -------------------------------------------------------------------------------------------------

_COUNTED = f"""{twins.OBSERVATIONS},
counts AS (SELECT feature, x, count(*) AS k FROM obs WHERE x IS NOT NULL GROUP BY ALL),
cells12 AS (SELECT feature, round(x, 12) AS v, sum(k) AS k, count(*) AS u, min(x) AS low, max(x) AS high FROM counts GROUP BY ALL),
agg12 AS (SELECT feature, CAST(sum(u) AS BIGINT) AS n_unique, max(k) AS top, max(high) - min(low) AS span FROM cells12 GROUP BY ALL),
stats AS (
  SELECT b.feature, 1 - n_non_missing / n_rows AS missing_fraction, n_non_missing, coalesce(n_unique, 0) AS n_unique, CAST(top AS DOUBLE) / n_non_missing AS top_share, span, greatest(1.0, median_abs) AS scale
  FROM (SELECT feature, count(*) AS n_rows, count(x) AS n_non_missing, quantile_cont(abs(x), 0.5) AS median_abs FROM obs GROUP BY ALL) b LEFT JOIN agg12 USING (feature))"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_statistics(features.long_form(_main(spark, sf_dir), twins.TESTED))


@query(f"WITH {_COUNTED} SELECT feature, round(missing_fraction, 6) + 0.0 AS missing_fraction FROM stats WHERE missing_fraction > 0.2")
def filter_missing(spark, sf_dir):
    return features.filter_report(_stats(spark, sf_dir), MAIN).where("stage = 'high_missingness'").select("feature", "missing_fraction")


@query(f"""WITH {_COUNTED} SELECT feature, n_non_missing, n_unique, round(top_share, 6) + 0.0 AS top_share,
CASE WHEN n_non_missing = 0 THEN 'all_missing_after_inf_replacement' WHEN n_unique <= 1 THEN 'exact_constant' WHEN span <= 1e-12 * scale THEN 'numerical_constant' ELSE 'dominant_value_share_ge_0.95' END AS reason
FROM stats WHERE missing_fraction <= 0.2 AND (n_non_missing = 0 OR n_unique <= 1 OR span <= 1e-12 * scale OR top_share >= 0.95)""")
def filter_constant(spark, sf_dir):
    return features.filter_report(_stats(spark, sf_dir), MAIN).where("stage = 'near_constant'").select("feature", "n_non_missing", "n_unique", "top_share", "reason")


@query(f"""WITH {twins.DESCRIPTORS} SELECT dataset, {", ".join(f"round(CASE WHEN count({c}) = count(*) THEN avg({c}) END, 6) + 0.0 AS {c}" for c in ("log_n", "class_entropy", "missing_fraction", "mean_abs_skew"))} FROM described GROUP BY dataset""")
def filter_reference(spark, sf_dir):
    return features.filter_reference(_described(spark, sf_dir), ["log_n", "class_entropy", "missing_fraction", "mean_abs_skew"]).drop("task_type")


@query(f"""WITH {_COUNTED} SELECT 'left_vs_right' AS "table", CAST(t AS DOUBLE) AS threshold, count(*) AS n_features, CAST(sum(CASE WHEN missing_fraction > t THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, CAST(sum(CASE WHEN missing_fraction > t THEN 0 ELSE 1 END) AS BIGINT) AS n_kept
FROM stats, (VALUES (0.0), (0.05), (0.1), (0.2), (0.3), (0.5)) v(t) GROUP BY ALL""")
def missing_sweep(spark, sf_dir):
    return features.missing_sweep(_stats(spark, sf_dir), MAIN, [0.0, 0.05, 0.1, 0.2, 0.3, 0.5])


@query(f"WITH {twins.OBSERVATIONS} SELECT dataset, count(*) AS n_features, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_share FROM obs GROUP BY ALL")
def missing_by_dataset(spark, sf_dir):
    return features.missing_by_dataset(features.long_form(_main(spark, sf_dir), twins.TESTED, "dataset"))


_MATRIX = f"""{twins.OBSERVATIONS},
met AS (SELECT l.feature AS a, r.feature AS b, l.x AS va, r.x AS vb FROM obs l JOIN obs r USING (dataset) WHERE l.feature < r.feature AND l.x IS NOT NULL AND r.x IS NOT NULL),
rk AS (SELECT a, b, {twins.average_rank("va", "a, b")} AS ra, {twins.average_rank("vb", "a, b")} AS rb FROM met),
matrix AS (SELECT a, b, count(*) AS n, {twins.correlation("ra", "rb")} AS r FROM rk GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {_MATRIX} SELECT a, b, n, round(r, 6) + 0.0 AS r FROM matrix")
def spearman_matrix(spark, sf_dir):
    return ranks.rank_correlations(features.long_form(_main(spark, sf_dir), twins.TESTED, "dataset"))


@query(f"WITH {_MATRIX} SELECT a, b, n, round(abs(r), 6) + 0.0 AS abs_spearman FROM matrix WHERE round(abs(r), 12) >= 0.95")
def redundant_pairs(spark, sf_dir):
    return features.strong_pairs(ranks.rank_correlations(features.long_form(_main(spark, sf_dir), twins.TESTED, "dataset")))


@query(f"WITH {twins.OBSERVATIONS} SELECT feature FROM obs WHERE x IS NOT NULL GROUP BY feature HAVING count(*) >= 3 AND min(x) < max(x)")
def usable_features(spark, sf_dir):
    return features.usable(features.long_form(_main(spark, sf_dir), twins.TESTED))


_WHOLE = ["class_entropy", "irreg_iqr_hmean", "delta_norm"]


@query(f"WITH {twins.OBSERVATIONS} SELECT dataset, {twins.r6(_WHOLE)} FROM main WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _WHOLE))
def whole_rows(spark, sf_dir):
    return features.complete_cases(_main(spark, sf_dir), _WHOLE).select("dataset", *_WHOLE)


@query(f"""WITH {_COUNTED.replace(twins.OBSERVATIONS, twins.OBSERVATIONS.replace("FROM main", "FROM main_kinds").replace("obs AS (", "main_kinds AS (SELECT m.* FROM main m JOIN (SELECT DISTINCT 'd' || p_size AS dataset FROM part WHERE p_size % 3 <> 2) USING (dataset)), obs AS ("))}
SELECT feature, CASE WHEN missing_fraction > 0.2 THEN 'high_missingness' ELSE 'near_constant' END AS stage FROM stats WHERE missing_fraction > 0.2 OR n_non_missing = 0 OR n_unique <= 1 OR span <= 1e-12 * scale OR top_share >= 0.95""")
def filter_by_population(spark, sf_dir):
    """Features judged on the classification datasets only, and dropped from the whole table."""
    main = _main(spark, sf_dir)
    typed = analysis.with_task_type(main, inputs.metadata(spark, sf_dir))
    _, report = features.preprocess(main, twins.TESTED, MAIN, ["dataset"], filter_table=typed.where(F.col("task_type").isin("binary", "multiclass")))
    return report.select("feature", "stage")


@query(f"""WITH RECURSIVE {_COUNTED}{_MATRIX.removeprefix(twins.OBSERVATIONS)},
strong AS (SELECT a, b, round(abs(r), 12) AS s FROM matrix WHERE round(abs(r), 12) >= 0.95),
chosen AS (
  SELECT s, a, b, row_number() OVER (ORDER BY s DESC, a, b) AS nth, x.missing_fraction < y.missing_fraction OR (x.missing_fraction = y.missing_fraction AND (x.n_unique > y.n_unique OR (x.n_unique = y.n_unique AND a < b))) AS keeps_a
  FROM strong JOIN stats x ON x.feature = a JOIN stats y ON y.feature = b),
named AS (SELECT *, CASE WHEN keeps_a THEN b ELSE a END AS dropped, CASE WHEN keeps_a THEN a ELSE b END AS kept FROM chosen),
walk(nth, gone, hit) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
  UNION ALL SELECT c.nth, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, dropped) END, NOT (list_contains(gone, a) OR list_contains(gone, b)) FROM walk w JOIN named c ON c.nth = w.nth + 1)
SELECT 'left_vs_right' AS "table", 'redundancy' AS stage, dropped AS dropped_feature, kept AS kept_feature, round(s, 6) + 0.0 AS abs_spearman, round(d.missing_fraction, 6) + 0.0 AS dropped_missing_fraction, round(k.missing_fraction, 6) + 0.0 AS kept_missing_fraction,
       d.n_unique AS dropped_n_unique, k.n_unique AS kept_n_unique, 'abs_spearman >= 0.95' AS reason
FROM walk JOIN named USING (nth) JOIN stats d ON d.feature = dropped JOIN stats k ON k.feature = kept WHERE hit""")
def redundancy_report(spark, sf_dir):
    return features.reduce_redundant(_main(spark, sf_dir), twins.TESTED, MAIN, ["dataset", "delta_norm"])[1]


# --- associations ---------------------------------------------------------------------------------------------

_ASSOC = "feature, n, feature_n_unique, reason, round(spearman_r, 6) + 0.0 AS spearman_r, round(abs_spearman_r, 6) + 0.0 AS abs_spearman_r, round(p_value, 6) + 0.0 AS p_value, round(p_value_bh, 6) + 0.0 AS p_value_bh, CAST(effect_rank AS INTEGER) AS effect_rank"
_SHOWN = ["feature", "n", "feature_n_unique", "reason", "spearman_r", "abs_spearman_r", "p_value", "p_value_bh", "effect_rank"]


def _tested(spark: SparkSession, sf_dir: str, method: str = "spearman") -> DataFrame:
    return associations.test_associations(_obs(spark, sf_dir), twins.TESTED, MAIN, method=method)


def _resampled(spark: SparkSession, sf_dir: str, target: str = "delta_norm") -> tuple[DataFrame, DataFrame]:
    """Observations and their tests as written tables, for resamples that read both several times."""
    obs = written(associations.observations(_main(spark, sf_dir), twins.TESTED, target), "observations")
    return obs, written(associations.test_associations(obs, twins.TESTED, MAIN), "tested")


@query(f"WITH {twins.associated()} SELECT {_ASSOC} FROM tested")
def associations_spearman(spark, sf_dir):
    return _tested(spark, sf_dir).select(*_SHOWN)


@query(f"WITH {twins.associated('pearson')} SELECT {_ASSOC} FROM tested")
def associations_pearson(spark, sf_dir):
    return _tested(spark, sf_dir, "pearson").select(*_SHOWN)


@query(f"WITH {twins.associated()} SELECT feature, round(p_value, 6) + 0.0 AS p_value, round(p_value_holm, 6) + 0.0 AS p_adjusted FROM tested")
def holm(spark, sf_dir):
    return associations.corrected(_tested(spark, sf_dir), "holm").select("feature", "p_value", "p_adjusted")


@query(f"""WITH {twins.associated()}, o AS (SELECT *, CASE WHEN spearman_r > 0 THEN p_value / 2 ELSE 1 - p_value / 2 END AS p1 FROM tested),
k AS (SELECT *, count(p1) OVER () AS m, row_number() OVER (PARTITION BY p1 IS NULL ORDER BY p1) AS k FROM o)
SELECT feature, round(p1, 6) + 0.0 AS p_directed, CASE WHEN p1 IS NOT NULL THEN round(least(1.0, min(p1 * m / k) OVER (PARTITION BY p1 IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS p_adjusted FROM k""")
def one_sided(spark, sf_dir):
    return associations.corrected(_tested(spark, sf_dir), "bh", "positive").select("feature", "p_directed", "p_adjusted")


_SEED = associations.SEED
_BOOT = f"""{twins.associated()},
own AS (SELECT p.feature, p.x, p.y, row_number() OVER (PARTITION BY p.feature ORDER BY p.dataset) - 1 AS pos, count(*) OVER (PARTITION BY p.feature) AS size FROM pairs p JOIN tested USING (feature) WHERE spearman_r IS NOT NULL),
draws AS (SELECT feature, rep, pos AS draw, {twins.index("size", str(_SEED), "feature", "rep", "pos")} AS pos FROM own, range(0, {REPEATS}) g(rep)),
drawn AS (SELECT d.feature, d.rep, x, y FROM draws d JOIN own USING (feature, pos)),
rk AS (SELECT feature, rep, {twins.average_rank("x", "feature, rep")} AS cx, {twins.average_rank("y", "feature, rep")} AS cy FROM drawn),
boot AS (SELECT feature, rep, {twins.correlation("cx", "cy")} AS r FROM rk GROUP BY ALL),
ci AS (
  SELECT feature, count(*) AS k, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high, avg(CASE WHEN sign(r) = sign(spearman_r) THEN 1.0 ELSE 0.0 END) AS bootstrap_sign_consistency
  FROM boot JOIN tested USING (feature) WHERE r IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_BOOT} SELECT feature, {twins.r6('ci_low ci_high bootstrap_sign_consistency')}, k AS bootstrap_repeats_used FROM ci")
def bootstrap_ci(spark, sf_dir):
    return associations.bootstrap_intervals(*_resampled(spark, sf_dir), REPEATS)


@query(f"""WITH {twins.associated()},
units AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT dataset FROM obs)),
draws AS (SELECT rep, pos AS draw, {twins.index("size", str(_SEED + 100_000), "rep", "pos")} AS pos FROM units, range(0, {REPEATS}) g(rep)),
drawn AS (SELECT rep, feature, x, y FROM draws JOIN units USING (pos) JOIN pairs USING (dataset) JOIN tested USING (feature) WHERE spearman_r IS NOT NULL),
rk AS (SELECT rep, feature, {twins.average_rank("x", "rep, feature")} AS cx, {twins.average_rank("y", "rep, feature")} AS cy FROM drawn),
boot AS (SELECT rep, feature, count(*) AS n, {twins.correlation("cx", "cy")} AS r FROM rk GROUP BY ALL),
places AS (SELECT rep, feature, row_number() OVER (PARTITION BY rep ORDER BY round(abs(r), 12) DESC, effect_rank) AS place FROM boot b JOIN tested t USING (feature) WHERE b.n >= 30 AND r IS NOT NULL),
tracked AS (SELECT feature FROM tested WHERE spearman_r IS NOT NULL ORDER BY effect_rank LIMIT 25),
s AS (SELECT feature, count(*) AS k, quantile_cont(place, 0.5) AS bootstrap_rank_median, quantile_cont(place, 0.05) AS bootstrap_rank_q05, quantile_cont(place, 0.95) AS bootstrap_rank_q95, avg(CASE WHEN place <= 25 THEN 1.0 ELSE 0.0 END) AS bootstrap_top_k_frequency FROM places GROUP BY ALL HAVING count(*) >= 20)
SELECT feature, {twins.r6("bootstrap_rank_median bootstrap_rank_q05 bootstrap_rank_q95 bootstrap_top_k_frequency")} FROM tracked LEFT JOIN s USING (feature)""")
def rank_stability(spark, sf_dir):
    return associations.rank_stability(*_resampled(spark, sf_dir), repeats=REPEATS)


@query(f"""WITH {_BOOT}, j AS (SELECT * FROM tested JOIN ci USING (feature))
SELECT feature, n, round(spearman_r, 6) + 0.0 AS spearman_rho, round(p_value_bh, 6) + 0.0 AS bh_q_value, round(bootstrap_sign_consistency, 6) + 0.0 AS bootstrap_sign_consistency
FROM j WHERE p_value_bh < 0.6 AND bootstrap_sign_consistency >= 0.6 ORDER BY round(abs_spearman_r, 12) DESC, j.bootstrap_sign_consistency DESC, feature LIMIT 25""")
def robust(spark, sf_dir):
    """Synthetic gaps hold no strong association, so the thresholds are loose here."""
    found = associations.associations(_main(spark, sf_dir), MAIN, twins.TESTED, repeats=REPEATS, check=False)
    return associations.robust_associations(found, MAIN, 0.6, 0.6).select("feature", "n", "spearman_rho", "bh_q_value", "bootstrap_sign_consistency")


_SKEW = _BOOT.replace("round(delta_norm, 9) AS y", "round(max_abs_skew, 9) AS y")


@query(f"""WITH {_SKEW}, j AS (SELECT * FROM tested JOIN ci USING (feature))
SELECT feature, n, round(spearman_r, 6) + 0.0 AS spearman_rho, round(p_value_bh, 6) + 0.0 AS bh_q_value, round(bootstrap_sign_consistency, 6) + 0.0 AS bootstrap_sign_consistency
FROM j WHERE p_value_bh < 0.05 AND bootstrap_sign_consistency >= 0.9 ORDER BY round(abs_spearman_r, 12) DESC, j.bootstrap_sign_consistency DESC, feature LIMIT 25""")
def robust_published(spark, sf_dir):
    """The published thresholds, on a target with strong associations: a descriptor of the splits."""
    obs, tested = _resampled(spark, sf_dir, "max_abs_skew")
    found = tested.join(associations.bootstrap_intervals(obs, tested), "feature", "left").withColumns({c: F.lit(None).cast("double") for c in ("bootstrap_rank_median", "bootstrap_rank_q05", "bootstrap_rank_q95", "bootstrap_top_k_frequency")})
    return associations.robust_associations(found, MAIN).select("feature", "n", "spearman_rho", "bh_q_value", "bootstrap_sign_consistency")


@query(f"WITH {twins.associated()} SELECT feature, round(p_value, 6) + 0.0 AS p_value FROM tested WHERE p_value < 0.2")
def nominal_associations(spark, sf_dir):
    return followups.nominal(_tested(spark, sf_dir), 0.2).select("feature", "p_value")


@query(f"WITH {twins.associated().replace('round(delta_norm, 9) AS y', 'round(max_abs_skew, 9) AS y')} SELECT feature, round(p_value, 6) + 0.0 AS p_value FROM tested WHERE p_value < 0.05")
def nominal_published(spark, sf_dir):
    """The published threshold, on a target with associations."""
    obs = associations.observations(_main(spark, sf_dir), twins.TESTED, "max_abs_skew")
    return followups.nominal(associations.test_associations(obs, twins.TESTED, MAIN)).select("feature", "p_value")


@query(f"""WITH {twins.associated()}, h(feature, expected_sign) AS (VALUES ('log_n', 1), ('missing_fraction', -1), ('mean_abs_skew', 1), ('class_entropy', -1), ('mean_kurtosis', 1), ('nothing', 1)),
j AS (SELECT h.feature, expected_sign, spearman_r, p_value, p_value_bh, sign(spearman_r) = expected_sign AS agrees FROM h LEFT JOIN tested USING (feature))
SELECT feature, expected_sign, CASE WHEN spearman_r IS NULL THEN 'not_tested' WHEN agrees AND p_value_bh < 0.05 THEN 'supported' WHEN agrees AND p_value < 0.05 THEN 'nominally_supported' WHEN agrees THEN 'same_direction'
WHEN p_value_bh < 0.05 THEN 'contradicted' ELSE 'opposite_direction' END AS verdict FROM j""")
def hypothesis_verdicts(spark, sf_dir):
    expected = spark.createDataFrame([("log_n", 1), ("missing_fraction", -1), ("mean_abs_skew", 1), ("class_entropy", -1), ("mean_kurtosis", 1), ("nothing", 1)], "feature string, expected_sign int")
    return followups.hypothesis_verdicts(expected, _tested(spark, sf_dir)).select("feature", "expected_sign", "verdict")


@query(f"""WITH {twins.associated()}, wo AS (SELECT DISTINCT feature, dataset AS without FROM pairs),
l AS (SELECT p.feature, without, x, y FROM pairs p JOIN wo ON p.feature = wo.feature AND p.dataset <> without),
rk AS (SELECT feature, without, {twins.average_rank("x", "feature, without")} AS cx, {twins.average_rank("y", "feature, without")} AS cy FROM l),
r AS (SELECT feature, without, {twins.correlation("cx", "cy")} AS r FROM rk GROUP BY ALL),
w AS (SELECT feature, r AS rho FROM found WHERE r IS NOT NULL)
SELECT feature, round(max(rho), 6) + 0.0 AS rho, round(min(r), 6) + 0.0 AS rho_min, round(max(r), 6) + 0.0 AS rho_max, round(avg(CASE WHEN sign(r) = sign(rho) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS same_sign_share
FROM r JOIN w USING (feature) WHERE r IS NOT NULL GROUP BY feature""")
def lodo_range(spark, sf_dir):
    return associations.leave_one_out_range(_obs(spark, sf_dir)).drop("most_influential")


@query(f"WITH {twins.ANALYSIS} SELECT dataset, count(*) AS n FROM analysis GROUP BY ALL HAVING count(*) > 1")
def unit_guard(spark, sf_dir):
    return associations.repeated_units(_analysis(spark, sf_dir))


@query(f"WITH {twins.associated()} SELECT count(*) AS n_features, count(p_value) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_nominal, count(*) FILTER (p_value_bh < 0.05) AS n_corrected FROM tested")
def association_summary(spark, sf_dir):
    return followups.association_summary(_tested(spark, sf_dir))


# --- sensitivity ----------------------------------------------------------------------------------------------


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = associations.associations(_main(spark, sf_dir), MAIN, twins.TESTED, repeats=REPEATS, check=False)
    return written(associations.robust_associations(found, MAIN, 0.6, 0.6), "robust")


@query(f"""WITH {_BOOT}, j AS (SELECT feature, round(abs_spearman_r, 12) AS a, bootstrap_sign_consistency AS s FROM tested JOIN ci USING (feature) WHERE p_value_bh < 0.6 AND bootstrap_sign_consistency >= 0.6 ORDER BY a DESC, s DESC, feature LIMIT 25)
SELECT feature, feature AS feature_family, CASE WHEN row_number() OVER (ORDER BY a DESC, s DESC, feature) <= 3 THEN 'selected' ELSE 'excluded_by_model_cap' END AS selection_status FROM j""")
def family_representatives(spark, sf_dir):
    return sensitivity.family_representatives(_loose(spark, sf_dir), 3).drop("nth")


@query()
def sensitivity_model(spark, sf_dir):
    main = written(_main(spark, sf_dir), "main")  # read by several jobs
    found = associations.associations(main, MAIN, twins.TESTED, check=False)
    return sensitivity.sensitivity(main, associations.robust_associations(found, MAIN, 0.6, 0.6), MAIN)[0]


@query(f"""WITH {twins.OBSERVATIONS}, d AS (SELECT round(delta_norm, 9) AS y, round(log_n, 9) AS a, round(mean_abs_skew, 9) AS b, row_number() OVER (ORDER BY dataset) - 1 AS pos, count(*) OVER () AS size FROM main),
draws AS (SELECT rep, CASE WHEN rep < 0 THEN pos ELSE {twins.index("size", str(_SEED), "rep", "pos")} END AS pos FROM d, range(-1, {REPEATS}) g(rep)),
rk AS (SELECT rep, {", ".join(f"{twins.average_rank(c, 'rep')} AS {c}" for c in "yab")} FROM draws JOIN d USING (pos)),
c AS (SELECT rep, count(*) AS n, corr(a, y) AS ca, corr(b, y) AS cb, corr(a, b) AS r FROM rk GROUP BY rep)
SELECT rep, predictor, {twins.r6("coefficient")}, n, predictors, {twins.r6("condition")} FROM (SELECT CAST(rep AS INTEGER) AS rep, p.predictor, CASE WHEN p.predictor = 'log_n' THEN ca - r * cb ELSE cb - r * ca END / (1 - r * r) AS coefficient, CAST(n AS INTEGER) AS n, 2 AS predictors, sqrt((1 + abs(r)) / (1 - abs(r))) AS condition
FROM c, (VALUES ('log_n'), ('mean_abs_skew')) p(predictor))""")
def rank_regression(spark, sf_dir):
    """The rank regression of the rows (replicate -1) and of every resample."""
    return sensitivity.bootstrap_fits(_main(spark, sf_dir), ["log_n", "mean_abs_skew"], "delta_norm", _SEED, REPEATS)


_RZ = ["delta_norm", "log_n", "missing_fraction"]


@query(f"""WITH {twins.ANALYSIS}, main AS (SELECT dataset, {", ".join(f"round({c}, 9) AS {c}" for c in _RZ)} FROM analysis WHERE comparison_name = 'left_vs_right'),
rk AS (SELECT dataset, {", ".join(f"{twins.average_rank(c, '')} AS {c}" for c in _RZ)} FROM main)
SELECT dataset, {", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 6) + 0.0 AS {c}" for c in _RZ)} FROM rk""")
def rank_zscore(spark, sf_dir):
    return sensitivity.rank_zscores(_main(spark, sf_dir).select("dataset", *_RZ), _RZ)


# --- predictive models ----------------------------------------------------------------------------------------

_MAINROWS = f"{twins.ANALYSIS}, main AS (SELECT dataset, round(delta_norm, 9) AS y, round(log_n, 9) AS x FROM analysis WHERE comparison_name = 'left_vs_right')"
_MEAN = "SELECT dataset, y AS y_true, (sum(y) OVER () - y) / (count(*) OVER () - 1) AS y_pred FROM main"


@query(f"WITH {_MAINROWS}, p AS ({_MEAN}) SELECT dataset, {twins.r6('y_true y_pred')} FROM p")
def mean_baseline(spark, sf_dir):
    return predictive.mean_baseline(_main(spark, sf_dir))


@query(f"WITH {_MAINROWS} SELECT dataset, round(y, 6) + 0.0 AS y_true, CASE WHEN sum(sign(y)) OVER () - sign(y) >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS y_pred FROM main")
def sign_baseline(spark, sf_dir):
    return predictive.sign_baseline(_main(spark, sf_dir))


@query(f"""WITH {_MAINROWS}, l AS (SELECT a.dataset, any_value(a.x) AS x0, any_value(a.y) AS y0, avg(b.x) AS mx, avg(b.y) AS my, covar_pop(b.x, b.y) AS c, var_pop(b.x) AS v FROM main a JOIN main b ON a.dataset <> b.dataset GROUP BY a.dataset)
SELECT dataset, round(y0, 6) + 0.0 AS y_true, round(my + coalesce(c / nullif(v, 0), 0) * (x0 - mx), 6) + 0.0 AS y_pred FROM l""")
def loo_ols_single(spark, sf_dir):
    return predictive.single_ols(_main(spark, sf_dir), "log_n")


_SCORE = f"""count(*) AS n, round(avg(abs(y_true - y_pred)), 6) + 0.0 AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) + 0.0 AS rmse, round(1 - sum(pow(y_true - y_pred, 2)) / nullif(var_pop(y_true) * count(*), 0), 6) + 0.0 AS oos_r2,
round({twins.correlation("ra", "rb")}, 6) + 0.0 AS spearman_pred_obs, round(avg(CASE WHEN y_true <> 0 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS sign_accuracy"""
_SINGLE = "SELECT a.dataset, any_value(a.y) AS y_true, avg(b.y) + coalesce(covar_pop(b.x, b.y) / nullif(var_pop(b.x), 0), 0) * (any_value(a.x) - avg(b.x)) AS y_pred FROM main a JOIN main b ON a.dataset <> b.dataset GROUP BY a.dataset"


@query(f"WITH {_MAINROWS}, p AS ({_SINGLE}), q AS (SELECT *, {twins.average_rank('y_true', '')} AS ra, {twins.average_rank('y_pred', '')} AS rb FROM (SELECT dataset, y_true, round(y_pred, 9) AS y_pred FROM p)) SELECT 'single' AS model, {_SCORE} FROM q")
def prediction_metrics(spark, sf_dir):
    p = predictive.single_ols(_main(spark, sf_dir), "log_n").select(F.lit("single").alias("model"), "dataset", "y_true", F.round("y_pred", 9).alias("y_pred"))
    return predictive.metrics(p, "model").select("model", "n", "mae", "rmse", "oos_r2", "spearman_pred_obs", "sign_accuracy")


@query(f"""WITH {_MAINROWS}, p AS (SELECT 'mean_baseline' AS model, y_true, y_pred FROM ({_MEAN}) UNION ALL SELECT 'single', y_true, y_pred FROM ({_SINGLE})),
m AS (SELECT model, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM p GROUP BY ALL)
SELECT model, round((SELECT mae FROM m WHERE model = 'mean_baseline') - mae, 6) + 0.0 AS delta_mae_vs_baseline, round((SELECT rmse FROM m WHERE model = 'mean_baseline') - rmse, 6) + 0.0 AS delta_rmse_vs_baseline FROM m""")
def baseline_delta(spark, sf_dir):
    main = _main(spark, sf_dir)
    both = predictive.mean_baseline(main).withColumn("model", F.lit("mean_baseline")).unionByName(predictive.single_ols(main, "log_n").withColumn("model", F.lit("single")))
    return predictive.with_baseline_delta(predictive.metrics(both, "model")).select("model", "delta_mae_vs_baseline", "delta_rmse_vs_baseline")


@query(f"""WITH {_MAINROWS}, p AS (SELECT dataset, y_true, y_pred * 8 AS y_pred FROM ({_SINGLE})), q AS (SELECT dataset, y_true, greatest(-0.5, least(0.5, y_pred)) AS y_pred, greatest(-0.5, least(0.5, y_pred)) <> y_pred AS clipped FROM p)
SELECT 'single' AS model, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) + 0.0 AS mae, round({twins.correlation("y_true", "y_pred")}, 6) + 0.0 AS pearson_pred_obs, CAST(sum(CAST(clipped AS INTEGER)) AS BIGINT) AS n_clipped FROM q""")
def clipped_metrics(spark, sf_dir):
    """Predictions blown up, so that some leave the bounds."""
    p = predictive.single_ols(_main(spark, sf_dir), "log_n").select(F.lit("single").alias("model"), "dataset", "y_true", (F.col("y_pred") * 8).alias("y_pred"))
    return predictive.metrics(predictive.clip(p, -0.5, 0.5), "model").select("model", "n", "mae", "pearson_pred_obs", "n_clipped")


_TWO = f"SELECT 'mean_baseline' AS model, * FROM ({_MEAN}) UNION ALL SELECT 'single', * FROM ({_SINGLE})"


def _two_models(spark, sf_dir) -> DataFrame:
    main = _main(spark, sf_dir)
    return predictive.mean_baseline(main).withColumn("model", F.lit("mean_baseline")).unionByName(predictive.single_ols(main, "log_n").withColumn("model", F.lit("single")))


@query(f"""WITH {_MAINROWS}, p AS ({_TWO}), m AS (SELECT model, round(avg(abs(y_true - y_pred)), 12) AS mae, round(avg(CASE WHEN y_true <> 0 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END), 12) AS acc FROM p GROUP BY ALL)
SELECT 'all' AS grp, (SELECT model FROM m ORDER BY mae, model LIMIT 1) AS model, 'mae' AS criterion UNION ALL SELECT 'all', (SELECT model FROM m ORDER BY acc DESC NULLS LAST, mae, model LIMIT 1), 'sign_accuracy'""")
def best_models(spark, sf_dir):
    scored = predictive.metrics(_two_models(spark, sf_dir), "model").withColumn("grp", F.lit("all"))
    return predictive.best_models(scored, "grp").select("grp", "model", "criterion")


@query(f"""WITH {_MAINROWS}, p AS ({_TWO}), m AS (SELECT model, row_number() OVER (ORDER BY round(avg(abs(y_true - y_pred)), 12), model) AS place FROM p GROUP BY model)
SELECT model, CAST(place AS INTEGER) AS place, dataset, {twins.r6("y_true y_pred")}, round(abs(y_true - y_pred), 6) + 0.0 AS abs_error, CASE WHEN y_true <> 0 THEN sign(y_true) = sign(y_pred) END AS sign_correct FROM p JOIN m USING (model)""")
def error_table(spark, sf_dir):
    return followups.error_table(_two_models(spark, sf_dir))


_COEFS = "SELECT 'm' || (l_suppkey % 3) AS model, 'p' || (l_linenumber) AS predictor, round((l_discount - 0.05) * 100) + (l_partkey % 7 - 3) AS coefficient FROM lineitem"


@query(f"""WITH c AS ({_COEFS}), s AS (
SELECT model, predictor, quantile_cont(coefficient, 0.5) AS median_standardized_coefficient, quantile_cont(abs(coefficient), 0.5) AS median_abs_standardized_coefficient, quantile_cont(coefficient, 0.05) AS q05_standardized_coefficient, quantile_cont(coefficient, 0.95) AS q95_standardized_coefficient,
avg(CASE WHEN coefficient > 0 THEN 1.0 ELSE 0.0 END) AS positive_fold_share, avg(CASE WHEN coefficient < 0 THEN 1.0 ELSE 0.0 END) AS negative_fold_share FROM c GROUP BY ALL)
SELECT model, predictor, {twins.r6("median_standardized_coefficient median_abs_standardized_coefficient q05_standardized_coefficient q95_standardized_coefficient positive_fold_share negative_fold_share")}, round(greatest(positive_fold_share, negative_fold_share), 6) + 0.0 AS coefficient_sign_consistency
FROM s QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(s.median_abs_standardized_coefficient, 12) DESC, predictor) <= 5""")
def coef_summary(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("predictor"), (F.round((F.col("l_discount") - 0.05) * 100) + (F.col("l_partkey") % 7 - 3)).alias("coefficient"))
    return predictive.coefficient_summary(rows, top_n=5)


@query(f"""WITH {_MAINROWS}, v AS (SELECT dataset, abs(y) AS v, row_number() OVER (ORDER BY dataset) - 1 AS pos, count(*) OVER () AS size FROM main),
d AS (SELECT rep, {twins.index("size", "0", "rep", "pos")} AS pos FROM v, range(0, 5000) g(rep)),
m AS (SELECT rep, avg(v) AS m FROM d JOIN v USING (pos) GROUP BY ALL)
SELECT 'all' AS grp, (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(m, 0.975), 6) + 0.0 AS ci_high FROM m""")
def bootstrap_mean(spark, sf_dir):
    rows = _main(spark, sf_dir).select(F.lit("all").alias("grp"), "dataset", F.abs("delta_norm").alias("v"))
    return predictive.bootstrap_mean(rows, "v", "dataset", "grp")


@query()
def model_grid(spark, sf_dir):
    """Every model family on all usable controls and features, left out one by one."""
    return predictive.predictive_models(_main(spark, sf_dir), MAIN)["metrics"]


@query()
def nested_selection(spark, sf_dir):
    return predictive.nested_top_feature(_main(spark, sf_dir), twins.TESTED)


# --- follow-ups -----------------------------------------------------------------------------------------------


_FIT2 = f"""{twins.OBSERVATIONS}, d AS (SELECT dataset, round(delta_norm, 9) AS y, round(log_n, 9) AS a, round(mean_abs_skew, 9) AS b FROM main),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb, var_pop(y) AS v FROM d),
z AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, y - my AS y FROM d, m),
f AS (SELECT 'controls' AS model, n, v, 1 AS p, ca AS ba, 0.0 AS bb, 1.0 / n AS iaa, 0.0 AS iab, 0.0 AS ibb, 1.0 AS max_vif FROM m
UNION ALL SELECT 'controls_plus', n, v, 2, (ca - r * cb) / (1 - r * r), (cb - r * ca) / (1 - r * r), 1 / (n * (1 - r * r)), -r / (n * (1 - r * r)), 1 / (n * (1 - r * r)), 1 / (1 - r * r) FROM m),
e AS (SELECT f.*, z.a, z.b, y - ba * z.a - bb * z.b AS e, 1.0 / n + iaa * z.a * z.a + 2 * iab * z.a * z.b + ibb * z.b * z.b AS h FROM z, f),
s AS (SELECT model, n, v, p, ba, bb, iaa, iab, ibb, max_vif, sum(e * e) AS sse, sum(pow(e / (1 - h), 2) * a * a) AS waa, sum(pow(e / (1 - h), 2) * a * b) AS wab, sum(pow(e / (1 - h), 2) * b * b) AS wbb FROM e GROUP BY ALL),
k AS (SELECT model, n, v, p, sse, max_vif, 'log_n' AS predictor, ba AS beta, sqrt(iaa * sse / (n - p - 1)) AS se, sqrt(iaa * iaa * waa + 2 * iaa * iab * wab + iab * iab * wbb) AS hc3_se FROM s
UNION ALL SELECT model, n, v, p, sse, max_vif, 'mean_abs_skew', bb, sqrt(ibb * sse / (n - p - 1)), sqrt(iab * iab * waa + 2 * iab * ibb * wab + ibb * ibb * wbb) FROM s WHERE p = 2),
t AS (SELECT *, n - p + 1 AS pairs, beta / se / sqrt(beta * beta / (se * se) + n - p - 1) AS r, 1 - sse / (n * v) AS r2 FROM k)"""


@query(f"""WITH {_FIT2} SELECT model, predictor, n, {twins.r6("coefficient se hc3_se ci_low ci_high p_value r2 adjusted_r2 max_vif")} FROM (SELECT model, predictor, CAST(n AS INTEGER) AS n, beta AS coefficient, se, hc3_se, beta - 1.96 * hc3_se AS ci_low, beta + 1.96 * hc3_se AS ci_high,
{twins.p_value("r", "pairs")} AS p_value, r2, 1 - (1 - r2) * (n - 1) / (n - p - 1) AS adjusted_r2, max_vif FROM t)""")
def controlled_ols(spark, sf_dir):
    return followups.ols_models(_main(spark, sf_dir), {"controls": ["log_n"], "controls_plus": ["log_n", "mean_abs_skew"]})


@query(f"""WITH {twins.OBSERVATIONS}, q AS (SELECT median(round(log_n, 9)) AS qa, median(round(mean_abs_skew, 9)) AS qb FROM main),
r AS (SELECT count(*) AS n, abs(corr(coalesce(round(log_n, 9), qa), coalesce(round(mean_abs_skew, 9), qb))) AS r FROM main, q)
SELECT '{MAIN}' AS analysis_table, CAST(n AS INTEGER) AS n, 2 AS n_features, round(exp(-((1 + r) / 2 * ln((1 + r) / 2) + (1 - r) / 2 * ln((1 - r) / 2))), 6) + 0.0 AS effective_rank FROM r""")
def matrix_rank(spark, sf_dir):
    return followups.matrix_rank(_main(spark, sf_dir), ["log_n", "mean_abs_skew"], MAIN)


_Z2 = ["delta_norm", "log_n", "mean_abs_skew"]


@query(f"""WITH {twins.OBSERVATIONS}, d AS (SELECT dataset, {", ".join(f"round({c}, 9) AS {c}" for c in _Z2)} FROM main),
m AS (SELECT count(*) AS n, corr(log_n, mean_abs_skew) AS r12, covar_pop(log_n, delta_norm) / stddev_pop(log_n) AS c1, covar_pop(mean_abs_skew, delta_norm) / stddev_pop(mean_abs_skew) AS c2, var_pop(delta_norm) AS v FROM d),
b AS (SELECT 'controls' AS model, 'log_n' AS predictor, n, c1 AS b, c1 * c1 / v AS r2, 1 AS p FROM m
UNION ALL SELECT 'controls_plus', 'log_n', n, (c1 - r12 * c2) / (1 - r12 * r12), (c1 * c1 + c2 * c2 - 2 * r12 * c1 * c2) / (1 - r12 * r12) / v, 2 FROM m
UNION ALL SELECT 'controls_plus', 'mean_abs_skew', n, (c2 - r12 * c1) / (1 - r12 * r12), (c1 * c1 + c2 * c2 - 2 * r12 * c1 * c2) / (1 - r12 * r12) / v, 2 FROM m)
SELECT model, predictor, CAST(n AS INTEGER) AS n, round(b, 6) + 0.0 AS coefficient, round(r2, 6) + 0.0 AS r2, round(1 - (1 - r2) * (n - 1) / (n - p - 1), 6) + 0.0 AS adjusted_r2 FROM b""")
def controlled_fit(spark, sf_dir):
    return followups.ols_models(_main(spark, sf_dir), {"controls": ["log_n"], "controls_plus": ["log_n", "mean_abs_skew"]}).select("model", "predictor", "n", "coefficient", "r2", "adjusted_r2")


@query(f"""WITH {twins.OBSERVATIONS} SELECT dataset, round(log_n, 6) + 0.0 AS x, round(delta_norm, 6) + 0.0 AS y FROM main WHERE log_n IS NOT NULL AND delta_norm IS NOT NULL""")
def scatter_table(spark, sf_dir):
    return followups.scatter_table(_main(spark, sf_dir), "log_n")


@query(f"WITH {twins.GAPS} SELECT count(*) AS rows, count(DISTINCT dataset) AS datasets, 17 AS columns FROM gaps")
def frame_summary(spark, sf_dir):
    return followups.frame_summary(_gaps(spark, sf_dir))


_P = ["delta_norm", "mean_abs_skew", "log_n", "missing_fraction"]
_PZ = {c: f"(r_{c} - avg(r_{c}) OVER ()) / nullif(stddev_pop(r_{c}) OVER (), 0)" for c in _P}


@query(f"""WITH {twins.OBSERVATIONS}, d AS (SELECT dataset, {", ".join(f"round({c}, 9) AS {c}" for c in _P)} FROM main),
k AS (SELECT {", ".join(f"{twins.average_rank(c, '')} AS r_{c}" for c in _P)} FROM d), z AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _PZ.items())} FROM k),
m AS (SELECT count(*) AS n, avg(delta_norm * mean_abs_skew) AS rho, avg(log_n * missing_fraction) AS s, avg(delta_norm * log_n) AS y1, avg(delta_norm * missing_fraction) AS y2, avg(mean_abs_skew * log_n) AS x1, avg(mean_abs_skew * missing_fraction) AS x2 FROM z),
e AS (SELECT round(delta_norm - ((y1 - s * y2) * log_n + (y2 - s * y1) * missing_fraction) / (1 - s * s), 12) AS y, round(mean_abs_skew - ((x1 - s * x2) * log_n + (x2 - s * x1) * missing_fraction) / (1 - s * s), 12) AS x FROM z, m),
q AS (SELECT {twins.average_rank("x", "")} AS rx, {twins.average_rank("y", "")} AS ry FROM e)
SELECT 'mean_abs_skew' AS feature, (SELECT n FROM m) AS n, round((SELECT rho FROM m), 6) + 0.0 AS rho, round({twins.correlation("rx", "ry")}, 6) + 0.0 AS partial_rho FROM q""")
def partial_rank(spark, sf_dir):
    return sensitivity.residual_rank_correlation(_main(spark, sf_dir), "mean_abs_skew", ["log_n", "missing_fraction"])


@query(f"""WITH {twins.GAPS}, one AS (SELECT dataset, avg(delta_norm) FILTER (comparison_name = 'left_vs_right') AS l, avg(delta_norm) FILTER (comparison_name = 'left_vs_solo') AS r FROM gaps GROUP BY ALL)
SELECT dataset, round(l, 6) + 0.0 AS delta_norm_left, round(r, 6) + 0.0 AS delta_norm_right, round(r - l, 6) + 0.0 AS delta_norm_change FROM one WHERE l IS NOT NULL AND r IS NOT NULL""")
def scenario_difference(spark, sf_dir):
    mean = _gaps(spark, sf_dir).groupBy("dataset", "comparison_name").agg(F.avg("delta_norm").alias("delta_norm"))
    side = lambda c: mean.where(F.col("comparison_name") == c).drop("comparison_name")
    return followups.scenario_difference(side("left_vs_right"), side("left_vs_solo"), ["dataset"], ["delta_norm"])


@query()
def interpretation(spark, sf_dir):
    main = written(_main(spark, sf_dir), "main")  # read by several jobs
    tested = associations.test_associations(associations.observations(main, twins.TESTED), twins.TESTED, MAIN)
    fits = followups.ols_models(main, {"m": ["log_n", "mean_abs_skew", "missing_fraction"]})
    return followups.interpretation(fits, tested, followups.high_pairs(features.long_form(main, twins.TESTED, "dataset")))

