"""Gaps on hand-made results: winners, signs, imputed rows, missing families."""

import pytest

from splitscope.config import Analysis, Comparison, ConfigError, Family, parse_config
from splitscope.operators.gaps import absent_members, missing_families, pairwise_gaps
from splitscope.sources.results import decode_splits, kept_methods, select_results

NN, GB = Family("nn", frozenset({"NN"}), "networks"), Family("gbdt", frozenset({"GB"}), "trees")
PAIR = [Comparison("nn_vs_gbdt", NN, GB)]
KINDS = "dataset string, fold int, method string, config_type string, method_subtype string, metric_error double, metric_error_val double, imputed boolean"


def rows(spark, *data):
    return spark.createDataFrame(list(data), KINDS)


def table(spark):
    return rows(
        spark,
        ("a", 0, "nn1", "NN", "tuned", 0.50, 0.10, False), ("a", 0, "nn2", "NN", "tuned", 0.10, 0.40, False),
        ("a", 0, "gb1", "GB", "tuned", 0.20, 0.20, False), ("a", 0, "gb2", "GB", "tuned", 0.05, 0.30, False),
        ("a", 5, "nn1", "NN", "tuned", 0.30, 0.30, False), ("a", 5, "gb1", "GB", "tuned", 0.30, None, True),
    )


def test_choice_on_validation_score_on_test(spark):
    got = pairwise_gaps(select_results(table(spark), Analysis()), PAIR, "metric_error", "metric_error_val").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.repeat, r.fold, r.best_a_method, r.best_b_method) == (0, 0, "nn1", "gb1")
    assert r.delta_raw == pytest.approx(0.30)


def test_ties_go_to_the_smaller_name(spark):
    t = rows(spark, ("a", 0, "nn_b", "NN", "tuned", 0.2, 0.2, False), ("a", 0, "nn_a", "NN", "tuned", 0.2, 0.2, False), ("a", 0, "gb", "GB", "tuned", 0.1, 0.1, False))
    assert pairwise_gaps(t, PAIR, "metric_error", "metric_error_val").first().best_a_method == "nn_a"


def test_normalisation_of_a_triple(spark):
    t = rows(spark, *((("a", 0, f"m{e}", "NN" if e < 3 else "GB", "tuned", float(e), float(e), False)) for e in (1, 2, 3)))
    r = pairwise_gaps(t, PAIR).first()
    assert (r.best_a_norm_error, r.best_b_norm_error) == (0.0, 1.0)


def test_antisymmetry(spark):
    t = select_results(table(spark), Analysis())
    one = pairwise_gaps(t, PAIR).orderBy("fold").collect()
    two = pairwise_gaps(t, [Comparison("x", GB, NN)]).orderBy("fold").collect()
    assert [r.delta_norm for r in one] == [-r.delta_norm for r in two]


def test_missing_and_absent(spark):
    got = missing_families(select_results(table(spark), Analysis()), PAIR, "metric_error", "metric_error_val").collect()
    assert [(r.group_name, r.n_missing, r.examples) for r in got] == [("gbdt", 1, "a/r1/f2")]
    assert absent_members(table(spark), {"x": Family("x", frozenset({"NN", "ZZ"}), "x")}).collect()[0].config_type == "ZZ"


def test_loading_rules(spark):
    assert kept_methods(["Auto_x", "gb"], ["Auto"]) == ["gb"]
    with pytest.raises(ValueError):
        select_results(table(spark).drop("config_type"), Analysis())
    assert select_results(table(spark), Analysis(), datasets=[]).count() == 0
    assert {(r.repeat, r.fold) for r in decode_splits(table(spark)).collect()} == {(0, 0), (1, 2)}


def test_empty_results_keep_the_schema(spark):
    got = pairwise_gaps(rows(spark), PAIR)
    assert got.count() == 0 and got.columns[-1] == "delta_norm"


def test_config_errors():
    good = {"version": 1, "groups": {"a": {"config_types": ["X"]}, "b": {"config_types": ["Y"]}}, "comparisons": [{"name": "c", "group_a": "a", "group_b": "b"}]}
    assert parse_config(good).comparisons[0].a.label == "a"
    for bad in ({"groups": {}}, {"comparisons": []}, {"analysis": {"unit": "x"}}, {"analysis": {"method_variant": "y"}}, {"metafeatures": {"pymfe_per_feature_timeout_s": -1}}, {"comparisons": [{"name": "c", "group_a": "z", "group_b": "b"}]}):
        with pytest.raises(ConfigError):
            parse_config(good | bad)
