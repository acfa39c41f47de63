"""The orchestrated run, its store and repair, the warm-up, and the follow-ups that queries do not reach."""

import logging
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitscope import warm
from splitscope.config import ConfigError, load_config, parse_config
from splitscope.operators import external, followups, predictive, reports, sensitivity
from splitscope.operators.descriptors import profiles
from splitscope.operators.kernels import predict, rank_z, spearman
from splitscope.plans import pipeline
from splitscope.plans.store import Store, export_csv, export_handoff, load_handoff
from splitscope.sources.metadata import splits_of
from splitscope.sources.results import read_results
from splitscope.sources.splits import SplitRows, assigned_rows

from plain import ols

RAW = {
    "version": 1,
    "groups": {"tree": {"config_types": ["T1", "T2"]}, "net": {"config_types": ["N1"]}},
    "comparisons": [{"name": "net_vs_tree", "group_a": "net", "group_b": "tree"}],
    "analysis": {"method_variant": "tuned"},
    "metafeatures": {"feature_sets": ["basic", "redundancy", "irregularity"]},
}


@pytest.fixture(scope="module")
def results(spark):
    r = np.random.default_rng(2)
    rows = [(f"d{d}", s, f"m{m}", c, "tuned", float(r.uniform(0.1, 0.5)), float(r.uniform(0.1, 0.5))) for d in range(4) for s in range(3) for m, c in enumerate(("T1", "T2", "N1"))]
    return spark.createDataFrame(rows, "dataset string, fold int, method string, config_type string, method_subtype string, metric_error double, metric_error_val double")


def train_rows(datasets):
    r = np.random.default_rng(4)
    return [(f"d{d}", 0, f, float(r.normal()), float(r.exponential()), f"v{r.integers(3)}", f"c{r.integers(2)}", "regression" if d == 3 else "binary") for d in datasets for f in range(3) for _ in range(30)]


TRAIN = "dataset string, repeat int, fold int, a double, b double, k string, y string, problem_type string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(train_rows(range(4)), TRAIN)


def split_rows(rows):
    return SplitRows(rows, ["a", "b", "k"], "y", "problem_type")


@pytest.fixture(scope="module")
def metadata(spark):
    return spark.createDataFrame([(f"d{d}", d, "regression" if d == 3 else "binary") for d in range(4)], "dataset string, tid long, problem_type string")


def test_lazy_run_equals_its_parts(spark, results, rows, metadata):
    config = parse_config(RAW)
    out = pipeline.run_analysis(config, results, split_rows(rows), metadata)
    assert out.gaps.count() == 12 and out.descriptors.count() == 12 and out.analysis.count() == 4
    one = out.analysis.where("dataset = 'd1'").first()
    gaps = out.gaps.where("dataset = 'd1'").toPandas()
    assert one.n_splits == 3 and one.delta_norm == pytest.approx(gaps.delta_norm.mean())
    want = out.descriptors.where("dataset = 'd1'").toPandas()
    assert one.mean_abs_skew == pytest.approx(want.mean_abs_skew.mean()) and np.isfinite(one.irregularity)
    no_regression = pipeline.run_analysis(parse_config(RAW | {"analysis": {"exclude_problem_types": ["regression"]}}), results, split_rows(rows), metadata)
    assert {r.dataset for r in no_regression.analysis.collect()} == {"d0", "d1", "d2"} and no_regression.descriptors.count() == 9
    fold = pipeline.run_analysis(parse_config(RAW | {"analysis": {"unit": "fold"}}), results, split_rows(rows), metadata)
    assert fold.analysis.count() == 12
    empty = pipeline.run_analysis(replace(config, comparisons=()), results, split_rows(rows), metadata)
    assert empty.gaps.count() == 0 and empty.analysis.count() == 0


def test_stored_stages_are_reused_and_repaired(spark, results, rows, metadata, tmp_path, monkeypatch, caplog):
    store, config = Store(spark, f"file://{tmp_path}/store"), parse_config(RAW)
    built = []
    plain = pipeline.build_set
    monkeypatch.setattr(pipeline, "build_set", lambda name, sr, c, p: built.append((name, sr.rows.select("dataset", "fold").distinct().count())) or plain(name, sr, c, p))
    some = split_rows(rows.where("dataset <> 'd2'"))
    with caplog.at_level(logging.INFO, "splitscope"):
        first = pipeline.run_analysis(config, results, some, metadata, store)
    assert built == [("basic", 9), ("redundancy", 9), ("irregularity", 9)]
    assert all(any(f"stage {k}" in m for m in caplog.messages) for k in (1, 2, 3))
    lazy = pipeline.run_analysis(config, results, some, metadata)
    both = [sorted(map(tuple, x.descriptors.select("dataset", "fold", "n", F.round("mean_kurtosis", 9), F.round("max_abs_corr", 9)).collect())) for x in (first, lazy)]
    assert both[0] == both[1] and {r.failed_sets for r in first.descriptors.collect()} == {"{}"}
    built.clear()
    again = replace(config, statistics=replace(config.statistics, alpha=0.2), descriptors=replace(config.descriptors, trace=True))
    pipeline.run_analysis(again, results, some, metadata, store)
    assert built == []  # neither statistics nor tracing rebuild anything
    more = pipeline.run_analysis(config, results, split_rows(rows), metadata, store)
    assert built == [(s, 3) for s in ("basic", "redundancy", "irregularity")] and more.descriptors.count() == 12  # only the new dataset
    built.clear()
    retyped = split_rows(rows.withColumn("problem_type", F.when(F.col("dataset") == "d0", "multiclass").otherwise(F.col("problem_type"))))
    pipeline.run_analysis(config, results, retyped, metadata, store)
    assert built == [(s, 3) for s in ("basic", "redundancy", "irregularity")]  # the identity of d0 changed
    other = pipeline.run_analysis(replace(config, analysis=replace(config.analysis, selection_error_column=None)), results, some, metadata, store)
    assert other.results.columns != first.results.columns  # other metrics, another raw stage


def test_failed_sets_are_placeholders_until_repaired(spark, results, rows, metadata, tmp_path, monkeypatch):
    store, config = Store(spark, f"file://{tmp_path}/store"), parse_config(RAW)
    plain = pipeline.build_set

    def broken(which):
        def build(name, sr, c, p):
            if name == which:
                raise RuntimeError("no luck")
            return plain(name, sr, c, p)

        return build

    monkeypatch.setattr(pipeline, "build_set", broken("redundancy"))
    out = pipeline.run_analysis(config, results, split_rows(rows), metadata, store)
    got = out.descriptors.collect()
    assert all(r.mean_abs_corr is None and r.n == 30 and r.failed_sets == '{"redundancy":"RuntimeError: no luck"}' for r in got)
    assert [(r.feature_set, r.n) for r in pipeline_failures(out.descriptors)] == [("redundancy", 12)]
    monkeypatch.setattr(pipeline, "build_set", plain)
    kept = pipeline.run_analysis(config, results, split_rows(rows), metadata, store)
    assert all(r.mean_abs_corr is None for r in kept.descriptors.collect())  # a failure is kept
    retry = replace(config, descriptors=replace(config.descriptors, retry_failed=True))
    fixed = pipeline.run_analysis(retry, results, split_rows(rows), metadata, store).descriptors.collect()
    assert len(fixed) == 12 and all(r.mean_abs_corr is not None and r.failed_sets == "{}" for r in fixed)
    monkeypatch.setattr(pipeline, "build_set", broken("irregularity"))
    with pytest.raises(RuntimeError):  # the set that the composite needs is strict
        pipeline.run_analysis(config, results, split_rows(rows), metadata, Store(spark, f"file://{tmp_path}/other"))


def pipeline_failures(table):
    from splitscope.plans.store import failures

    return failures(table).collect()


def test_statistics_follow_the_settings(spark, metadata):
    r = np.random.default_rng(7)
    n = 36
    gaps = [(f"d{d}", s, f"m{m}", c, "tuned", 0.2 + 0.02 * d * (c == "N1") + float(r.uniform(0, 0.02)), 0.2) for d in range(n) for s in range(3) for m, c in enumerate(("T1", "N1", "N1"))]
    results = spark.createDataFrame(gaps, "dataset string, fold int, method string, config_type string, method_subtype string, metric_error double, metric_error_val double")
    rows = [(f"d{d}", 0, f, float(r.normal()), float(r.normal()), "v", "c", "binary") for d in range(n) for f in range(3) for _ in range(10 + d)]
    sr = SplitRows(spark.createDataFrame(rows, TRAIN), ["a", "b"], "y", "problem_type")
    raw = RAW | {"metafeatures": {"feature_sets": ["basic"]}, "statistics": {"fdr_method": "holm", "ci_confidence_level": 0.5, "ci_bootstrap_samples": 40}}
    out = pipeline.run_analysis(parse_config(raw), results, sr, statistics=True)
    got = out.associations["net_vs_tree"].where("p_value is not null").toPandas().sort_values("p_value")
    k = np.arange(len(got))
    assert np.allclose(got.p_adjusted, np.minimum(1, np.maximum.accumulate(got.p_value * (len(got) - k))))
    wide = pipeline.run_analysis(parse_config(raw | {"statistics": {"fdr_method": None, "ci_confidence_level": 0.99, "ci_bootstrap_samples": 40}}), results, sr, statistics=True)
    other = wide.associations["net_vs_tree"].where("p_value is not null").toPandas().sort_values("p_value")
    assert np.allclose(other.p_adjusted, other.p_value)
    assert (other.set_index("feature").ci_high - other.set_index("feature").ci_low >= got.set_index("feature").ci_high - got.set_index("feature").ci_low - 1e-12).all()
    with pytest.raises(ConfigError, match="ridge"):
        pipeline.run_analysis(parse_config(raw | {"statistics": {"multivariate": True, "multivariate_method": "ridge"}}), results, sr, statistics=True)


def test_warm_up(spark, results, rows, metadata, tmp_path):
    import yaml

    for name, t in (("results", results), ("rows", rows), ("metadata", metadata)):
        t.write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "c.yaml").write_text(yaml.safe_dump(RAW))
    base = ["--config", f"{tmp_path}/configs/c.yaml", "--results", f"{tmp_path}/results", "--splits", f"{tmp_path}/rows", "--metadata", f"{tmp_path}/metadata", "--features", "a,b,k", "--target", "y"]
    out = warm.warm(spark, warm.arguments([*base, "--datasets", "d0", "d1"]))
    assert {r.dataset for r in out.descriptors.collect()} == {"d0", "d1"}
    assert warm.warm(spark, warm.arguments([*base, "--sample-datasets", "1", "--repair"])).analysis.count() == 1
    assert load_config(f"{tmp_path}/configs/c.yaml").cache.directory == f"{tmp_path}/.stage_cache" and (tmp_path / ".stage_cache").exists()
    with pytest.raises(SystemExit):
        warm.arguments([*base, "--sample-datasets", "0"])


def test_sources(spark, results, tmp_path):
    for m in ("m0", "m1", "m2"):
        results.where(F.col("method") == m).write.parquet(f"{tmp_path}/{m}")
    config = parse_config(RAW | {"analysis": {"exclude_methods_containing": ["1"]}})
    paths = {m: f"{tmp_path}/{m}" for m in ("m0", "m2")} | {"m1": f"{tmp_path}/is_never_opened"}
    assert {r.method for r in read_results(spark, paths, config).collect()} == {"m0", "m2"}
    assert read_results(spark, paths, config, datasets=["d1"]).count() == 6 and read_results(spark, paths, config, methods=["m1"]).count() == 0
    assert read_results(spark, {}, config).columns == ["dataset", "fold", "method", "config_type", "method_subtype", "metric_error", "metric_error_val"]
    table = spark.createDataFrame([("d", 1, 1.0), ("d", 2, 2.0)], "dataset string, row int, a double")
    assign = spark.createDataFrame([("d", 0, 0, 1), ("d", 0, 1, 2), ("d", 0, 1, 1)], "dataset string, repeat int, fold int, row int")
    assert assigned_rows(table, assign, "row", ["a"]).rows.count() == 3
    with pytest.raises(ValueError, match="several times"):
        assigned_rows(table, assign.unionByName(assign), "row", ["a"])
    meta = spark.createDataFrame([("d", 1, 2, 1), ("e", 1, 2, 3)], "dataset string, n_repeats int, n_folds int, n_samples int")
    assert splits_of(meta.where("dataset = 'd'")).count() == 2
    with pytest.raises(Exception, match="exactly one sample"):
        splits_of(meta).collect()


def test_handoff_and_reports(spark, tmp_path):
    t = spark.createDataFrame([("d1", 1.0), ("d2", 2.0), ("d2", 3.0)], "dataset string, x double")
    manifest = export_handoff({"gaps": t, "plain": t.drop("dataset")}, f"{tmp_path}/out").collect()
    assert [(r.name, r.rows, r.columns, r.datasets) for r in manifest] == [("gaps", 3, 2, 2), ("plain", 3, 1, None)]
    assert load_handoff(spark, f"{tmp_path}/out", "gaps").count() == 3 and load_handoff(spark, f"{tmp_path}/out", "none", required=False) is None
    export_csv(t, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    robust = spark.createDataFrame([("pymfe__iq_range.mean", 40, 0.5, 0.5, 0.0004, 0.1, 0.7, 0.96), ("log_n", 40, -0.6, 0.6, 0.02, None, None, None)], "feature string, n int, spearman_rho double, abs_spearman_rho double, bh_q_value double, bootstrap_ci_low double, bootstrap_ci_high double, bootstrap_sign_consistency double")
    text = reports.robust_table(robust, "A & B").splitlines()
    assert text[1] == r"\caption{Robust associations: A \& B}" and r"\label{tab:robust_a___b}" in text
    assert [x for x in text if x.endswith(r"\\")][1:] == [r"log n & 40 & -0.600 & 0.020 & -- & -- \\", r"iq range (mean) & 40 & 0.500 & <0.001 & [0.10, 0.70] & 0.96 \\"]
    tested = spark.createDataFrame([("a_b", 9, 0.3, 0.01, 0.2), ("c", 9, 0.1, 0.5, 0.6)], "feature string, n int, spearman_r double, p_value double, p_value_bh double")
    assert "a b & 9 & 0.300 & 0.010 & 0.200" in reports.nominal_table(tested, "x") and "c & 9" not in reports.nominal_table(tested, "x")
    stars = spark.createDataFrame([(0.0001,), (0.005,), (0.04,), (0.5,), (None,)], "p double").select(reports.stars(F.col("p")).alias("s")).collect()
    assert [r.s for r in stars] == ["***", "**", "*", "", ""]
    with pytest.raises(ValueError, match="at most"):
        reports.nominal_table(spark.range(1001).selectExpr("cast(id as string) feature", "1 n", "0.1 spearman_r", "0.01 p_value", "0.02 p_value_bh"), "x")


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x, n = r.normal(size=40), r.integers(10, 99, 40).astype(float)
    t = pd.DataFrame({"dataset": [f"d{i:02d}" for i in range(40)], "x": x, "n": n, "d_over_n": 3 / n, "noise": r.normal(size=40), "delta_norm": 0.6 * x + 0.01 * n + r.normal(0, 0.2, 40), "text": "t"})
    return spark.createDataFrame(t), t


def test_partial_rank(table):
    df, t = table
    got = sensitivity.residual_rank_correlation(df, "x", ["n", "noise"]).first()
    z = {c: rank_z(t[c].to_numpy()) for c in ("x", "delta_norm", "n", "noise")}
    m = np.column_stack([z["n"], z["noise"]])
    rest = [np.round(z[c] - m @ np.linalg.lstsq(m, z[c], rcond=None)[0], 12) for c in ("delta_norm", "x")]
    assert (got.n, got.rho, got.partial_rho) == (40, pytest.approx(spearman(t["x"].to_numpy(), t["delta_norm"].to_numpy())), pytest.approx(spearman(*rest)))
    flat = sensitivity.residual_rank_correlation(df.withColumn("flat", F.lit(1.0)), "x", ["flat"]).first()
    assert flat.partial_rho == pytest.approx(flat.rho) and sensitivity.residual_rank_correlation(df.withColumn("flat", F.lit(1.0)), "flat", ["n"]).first().rho is None


def test_model_grid_end_to_end(table):
    df, t = table
    out = {k: v.toPandas() for k, v in predictive.predictive_models(df, "t", robust=["x"], boosted=True).items()}
    models = set(out["metrics"].model)
    assert {"mean_baseline", "ridge_controls", "ridge_meta_features", "ridge_controls_plus_robust_features", "decision_tree_meta_features", "boosted_stumps_controls_plus_meta_features"} <= models
    assert out["controls"].set_index("control").available.to_dict() == {"n_samples": True, "n_features": False, "feature_sample_ratio": True}
    assert out["guard"].iloc[0][["n_modeling_rows", "n_feature_predictors", "n_control_predictors"]].tolist() == [40, 2, 2]
    p = out["predictions"]
    for model, columns in (("ridge_robust_features", ["x"]), ("ridge_controls", ["n", "d_over_n"]), ("decision_tree_robust_features", ["x"])):
        own = p[p.model == model].sort_values("dataset")
        family = own.model_family.iloc[0]
        for k in (0, 17, 39):
            rest = t.drop(index=k)
            want, _, _ = predict(family, rest[columns].to_numpy(float), rest.delta_norm.to_numpy(float), t[columns].to_numpy(float)[k : k + 1])
            assert own.y_pred.iloc[k] == pytest.approx(want[0])
        row = out["metrics"].set_index("model").loc[model]
        assert row.mae == pytest.approx((own.y_true - own.y_pred).abs().mean())
    base = out["metrics"].set_index("model")
    assert base.delta_mae_vs_baseline["ridge_meta_features"] == pytest.approx(base.mae["mean_baseline"] - base.mae["ridge_meta_features"])
    c = out["coefficients"]
    assert set(c.predictor) <= {"x", "noise"} and (c[(c.model == "ridge_meta_features") & (c.predictor == "x")].positive_fold_share == 1).all()
    few = predictive.predictive_models(df.limit(10), "few")
    assert set(few["metrics"].toPandas().n) == {0}


def test_lodo_lift_and_selection(table):
    df, t = table
    lift = {r.model: r for r in predictive.feature_lift(df, "x", ["n"]).collect()}
    assert lift["controls"].mae_lift == pytest.approx(0) and lift["controls_plus_feature"].mae_lift > 0.1
    got = predictive.nested_top_feature(df, ["x", "noise", "n"]).toPandas().sort_values("dataset").reset_index(drop=True)
    for k in (0, 20):
        rest = t.drop(index=k)
        best = max(("n", "noise", "x"), key=lambda f: abs(spearman(rest[f].to_numpy(), rest.delta_norm.to_numpy())))
        want, _, _ = predict("ridge", rest[[best]].to_numpy(float), rest.delta_norm.to_numpy(float), t[[best]].to_numpy(float)[k : k + 1])
        assert got.feature[k] == best and got.y_pred[k] == pytest.approx(want[0])


def test_ols_and_followups(table):
    df, t = table
    fits = followups.ols_models(df, {"a": ["n"], "b": ["n", "x"]}).toPandas()
    z = t[["n", "x"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    m = np.column_stack([np.ones(40), z])
    beta, *_ = np.linalg.lstsq(m, t.delta_norm.to_numpy(), rcond=None)
    e = t.delta_norm.to_numpy() - m @ beta
    inv = np.linalg.inv(m.T @ m)
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    hc3 = np.sqrt(np.diag(inv @ (m.T @ (m * ((e / (1 - h)) ** 2)[:, None])) @ inv))
    b = fits[fits.model == "b"].set_index("predictor")
    assert b.coefficient["x"] == pytest.approx(beta[2]) and b.hc3_se["x"] == pytest.approx(hc3[2]) and b.se["n"] == pytest.approx(np.sqrt((e @ e) / 37 * inv[1, 1]))
    assert b.max_vif.iloc[0] == pytest.approx(1 / (1 - np.corrcoef(z.T)[0, 1] ** 2))
    change = followups.adjusted_change(followups.ols_models(df, {"a": ["n"], "b": ["n", "x"]}), "a", "b").first()
    a = fits[fits.model == "a"].iloc[0]
    assert change.change == pytest.approx(b.adjusted_r2.iloc[0] - a.adjusted_r2) and change.change > 0.3
    rank = followups.matrix_rank(df, ["x", "n", "noise"], "t").first()
    s = t[["x", "n", "noise"]].to_numpy()
    v = np.linalg.eigvalsh(np.corrcoef(s.T))
    p = v / v.sum()
    assert (rank.n, rank.n_features) == (40, 3) and rank.effective_rank == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    found = followups.detectable_rho(50)
    assert 0.27 < found["rho_significant"] < 0.29 and 0.37 < found["rho_power"] < 0.40
    direction = ols(z, t.delta_norm.to_numpy())["coef"]
    assert np.sign(direction[1]) == 1


def test_external_descriptors(spark):
    r = np.random.default_rng(3)
    t = pd.DataFrame({"a": r.normal(5, 2, 50), "b": r.exponential(1, 50), "c": np.round(r.normal(0, 1, 50), 1), "k": [f"v{i % 4}" for i in range(50)], "l": [f"w{(i * i) % 3}" for i in range(50)]})
    t["d"] = t.a * 2 + r.normal(0, 0.3, 50)
    rows = spark.createDataFrame(t.assign(dataset="s")).withColumns({"repeat": F.lit(0), "fold": F.lit(0)}).repartition(3)
    got = external.external(SplitRows(rows, list("abcdkl")), ("general", "statistical", "info-theory", "complexity"), ("mean", "count")).first().asDict()
    num = t[list("abcd")]
    one = lambda f: got[f"pymfe__{f}"]
    trimmed = [np.sort(num[c])[10:40].mean() for c in num]
    mad = [1.4826 * np.median(abs(num[c] - num[c].median())) for c in num]
    assert one("t_mean.mean") == pytest.approx(np.mean(trimmed)) and one("mad.mean") == pytest.approx(np.mean(mad))
    assert one("iq_range.mean") == pytest.approx((num.quantile(0.75) - num.quantile(0.25)).mean()) and one("median.mean") == pytest.approx(num.median().mean()) and one("var.mean") == pytest.approx(num.var().mean())
    positive = [c for c in num if num[c].min() > 0]
    assert one("g_mean.mean") == pytest.approx(np.mean([np.exp(np.log(num[c]).mean()) for c in positive])) and one("h_mean.mean") == pytest.approx(np.mean([50 / (1 / num[c]).sum() for c in positive])) and one("h_mean.count") == len(positive)
    i = np.triu_indices(4, 1)
    assert one("cor.mean") == pytest.approx(abs(num.corr().to_numpy()[i]).mean()) and one("cov.mean") == pytest.approx(abs(num.cov().to_numpy()[i]).mean())
    values = np.linalg.eigvalsh(num.cov().to_numpy())[::-1]
    assert one("eigenvalues.mean") == pytest.approx(values.mean()) and one("nr_cor_attr") == pytest.approx((abs(num.corr().to_numpy()[i]) >= 0.5).mean())
    q1, q3 = num.quantile(0.25), num.quantile(0.75)
    assert one("nr_outliers") == ((num < q1 - 1.5 * (q3 - q1)) | (num > q3 + 1.5 * (q3 - q1))).any().sum()
    assert one("sparsity.mean") == pytest.approx(np.mean([(50 / t[c].nunique() - 1) / 49 for c in "abcdkl"]))
    parts = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    assert (one("t2"), one("t3"), one("t4")) == (pytest.approx(6 / 50), pytest.approx(parts / 50), pytest.approx(parts / 6))

    def tau(x, y):
        p = pd.crosstab(t[x], t[y]).to_numpy() / 50
        guess = (p.sum(0) ** 2).sum()
        return ((p**2 / p.sum(1, keepdims=True)).sum() - guess) / (1 - guess)

    assert one("attr_conc.mean") == pytest.approx((tau("k", "l") + tau("l", "k")) / 2)
    entropy = [-(p * np.log2(p)).sum() for p in (t[c].value_counts(normalize=True).to_numpy() for c in "kl")]
    assert one("attr_ent.mean") == pytest.approx(np.mean(entropy)) and one("nr_bin") == 1 and one("nr_cat") == 2
    assert {f for g in external.CLASS_ONLY_BY_GROUP.values() for f in g} >= {"leaves", "f1v", "one_nn", "ch"} and external.raw_feature("pymfe__t_mean.sd") == "t_mean"
    assert external.has_summary("pymfe__mad.mean") and not external.has_summary("log_n") and ("complexity", "t2", False) in external.catalog(["complexity"])


def test_external_preparation(spark):
    rows = spark.createDataFrame([("s", 0, 0, 1.0, "b"), ("s", 0, 0, None, "a"), ("s", 0, 0, 4.0, None), ("s", 0, 0, 2.0, "b"), ("t", 0, 0, None, "c"), ("t", 0, 0, 7.0, "c")], "dataset string, repeat int, fold int, x double, k string")
    got = external.prepared(SplitRows(rows, ["x", "k"])).collect()
    assert sorted((r.dataset, r.x, r.k) for r in got) == [("s", 1.0, 1.0), ("s", 2.0, 0.0), ("s", 2.0, 1.0), ("s", 4.0, 1.0), ("t", 7.0, 0.0), ("t", 7.0, 0.0)]


def test_quartiles_without_value_maps(spark):
    r = np.random.default_rng(8)
    values = [np.round(r.normal(size=n), 1) for n in (1, 2, 3, 4, 57)]
    cells = [("s", 0, 0, f"f{k}", "num", float(x), None) for k, v in enumerate(values) for x in v] + [("s", 0, 0, f"f{k}", "num", None, None) for k in range(5)]
    got = {p.feature: p for p in profiles(spark.createDataFrame(cells, "dataset string, repeat int, fold int, feature string, kind string, num double, cat string")).collect()}
    for k, v in enumerate(values):
        p = got[f"f{k}"]
        assert [p.q1, p.mid, p.q3] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist()) and (p.n_rows, p.n_values) == (len(v) + 1, len(v))
        s = pd.Series(v)
        assert p.skew == (pytest.approx(s.skew()) if len(v) > 2 else None) and p.kurt == (pytest.approx(s.kurt()) if len(v) > 3 else None)
