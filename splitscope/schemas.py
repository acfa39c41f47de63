"""Columns of the fixed tables.

Fixed values: the names of columns, their order in the tables, and the problem types that count as classification.
"""

from __future__ import annotations

SPLIT = ["dataset", "repeat", "fold"]
IDENTITY = ["dataset", "fold", "method", "config_type", "method_subtype"]
OPTIONAL = ["imputed", "impute_method"]
GROUP = ["dataset", "comparison_name", "group_a_name", "group_b_name", "group_a_label", "group_b_label", "expected_direction"]
GAP_COLUMNS = [
    "dataset", "repeat", "fold", "comparison_name", "group_a_name", "group_b_name", "group_a_label", "group_b_label", "expected_direction",
    "best_a_method", "best_a_error", "best_a_norm_error", "best_b_method", "best_b_error", "best_b_norm_error", "delta_raw", "delta_norm",
]
GAP_SCHEMA = ", ".join(f"{c} {'int' if c in ('repeat', 'fold') else 'double' if 'error' in c or 'delta' in c else 'string'}" for c in GAP_COLUMNS)
GAP_NUMBERS = ["best_a_error", "best_a_norm_error", "best_b_error", "best_b_norm_error", "delta_raw", "delta_norm"]
CONTEXT = ["dataset", "task_type", *GROUP[1:], "n_splits", *GAP_NUMBERS, "delta_raw_std", "delta_raw_sem", "delta_norm_std", "delta_norm_sem"]
#: Columns that describe the outcome or its bookkeeping and never predict it; repeat and fold are left out at fold level too.
NOT_PREDICTORS = {*GROUP, "task_type", "unit", "n_splits", "repeat", "fold", "delta_raw", "delta_raw_std", "delta_raw_sem", "delta_norm_std", "delta_norm_sem"}
CLASS_FEATURES = ["n_classes", "class_entropy", "majority_class_fraction", "minority_class_fraction", "class_imbalance_ratio"]
CLASSIFICATION = ("binary", "multiclass")

BASIC = [
    "n", "d", "log_n", "log_d", "n_over_d", "d_over_n", "n_num_features", "n_cat_features", "num_fraction", "cat_fraction", "missing_fraction",
    *CLASS_FEATURES, "mean_cat_cardinality", "max_cat_cardinality", "high_cardinality_fraction", "cat_cardinality_to_n_ratio",
    "row_missing_fraction", "feature_missing_fraction", "num_missing_fraction", "cat_missing_fraction", "max_feature_missing_fraction",
    "mean_abs_skew", "max_abs_skew", "mean_kurtosis", "outlier_fraction_iqr", "zero_fraction", "constant_feature_fraction", "near_constant_feature_fraction",
]
REDUNDANCY = ["mean_abs_corr", "max_abs_corr", "high_corr_pair_fraction", "effective_rank", "participation_ratio"]
#: Weights of the published irregularity composite (fixed values).
IRREGULARITY = {"irreg_min_cov_eig": -0.33, "irreg_std_skew": 0.23, "irreg_range_skew": 0.22, "irreg_iqr_hmean": 0.21, "irreg_kurtosis_std": 0.21}
