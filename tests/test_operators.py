"""Descriptors, statistics and models against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitscope.functions.expressions import two_sided_p, with_step_down, with_step_up
from splitscope.operators import associations, external, features, predictive, sensitivity
from splitscope.operators.analysis import assert_unique, dataset_level
from splitscope.operators.descriptors import basic, profiles
from splitscope.operators.irregularity import composite, irregularity
from splitscope.operators.kernels import fit_ridge, fit_tree, predict, t_tail
from splitscope.operators.redundancy import redundancy
from splitscope.plans.store import Store, content_hash
from splitscope.schemas import GAP_SCHEMA
from splitscope.sources.splits import SplitRows

from plain import ols


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(3)
    x = pd.DataFrame({"a": r.normal(5, 2, 60), "b": r.exponential(1, 60), "c": r.normal(0, 1, 60), "k": 1.0})
    x["d"] = x["a"] * 2 + r.normal(0, 0.1, 60)
    x.loc[::7, "c"] = np.nan
    x["cat"] = [None if i % 10 == 0 else f"v{i % 4}" for i in range(60)]
    x["y"] = [f"t{i % 3}" for i in range(60)]
    return x


@pytest.fixture(scope="module")
def splits(spark, frame):
    rows = spark.createDataFrame(frame.assign(dataset="s", repeat=0, fold=0, problem_type="multiclass").replace({np.nan: None})).withColumns({"repeat": F.lit(0), "fold": F.lit(0)})
    return SplitRows(rows, ["a", "b", "c", "d", "k", "cat"], "y", "problem_type")


def test_basic_descriptors(splits, frame):
    r = basic(splits).first()
    num = frame[["a", "b", "c", "d", "k"]]
    assert (r.n, r.d, r.n_num_features, r.n_cat_features, r.n_classes) == (60, 6, 5, 1, 3)
    assert r.mean_abs_skew == pytest.approx(num.skew().abs().mean())
    assert r.mean_kurtosis == pytest.approx(num.kurt().mean())
    assert r.missing_fraction == pytest.approx(frame.drop(columns="y").isna().mean().mean())
    assert r.row_missing_fraction == pytest.approx(frame.drop(columns="y").isna().any(axis=1).mean())
    q1, q3 = num.quantile(0.25), num.quantile(0.75)
    out = (num < q1 - 1.5 * (q3 - q1)) | (num > q3 + 1.5 * (q3 - q1))
    assert r.outlier_fraction_iqr == pytest.approx(out.sum().sum() / num.notna().sum().sum())
    assert r.class_entropy == pytest.approx(np.log2(3))
    assert r.constant_feature_fraction == pytest.approx(1 / 6)


def test_irregularity_and_redundancy(splits, frame):
    r = irregularity(splits).first()
    num = frame[["a", "b", "c", "d"]]
    assert r.irreg_kurtosis_std == pytest.approx(num.kurt().std())
    assert r.irreg_std_skew == pytest.approx(num.std().skew())
    z = ((num - num.mean()) / num.std(ddof=0)).dropna()
    assert r.irreg_min_cov_eig == pytest.approx(np.linalg.eigvalsh(np.cov(z.to_numpy(), rowvar=False)).min())
    c = num.corr().abs().to_numpy()[np.triu_indices(4, 1)]
    d = redundancy(splits).first()
    assert (d.mean_abs_corr, d.max_abs_corr, d.high_corr_pair_fraction) == (pytest.approx(c.mean()), pytest.approx(c.max()), pytest.approx((c > 0.9).mean()))
    v = np.linalg.eigvalsh(num.corr().to_numpy())
    assert d.participation_ratio == pytest.approx(v.sum() ** 2 / (v**2).sum())


def test_profiles_do_not_depend_on_partitions(splits):
    one = {tuple(r) for r in profiles(splits.cells()).select("feature", "n_values", "n_distinct", "top").collect()}
    many = SplitRows(splits.rows.repartition(7), splits.features)
    assert one == {tuple(r) for r in profiles(many.cells()).select("feature", "n_values", "n_distinct", "top").collect()}


def test_binary_features_are_counted_exactly(spark):
    """A thousand features of two values and as many of one and three: an estimate of distinct values misses some."""
    n = 3000
    cell = lambda f, v: ("s", 0, 0, f"f{f}", "num", float(v), None) if f % 2 else ("s", 0, 0, f"f{f}", "cat", None, str(v))
    rows = [cell(f, v * 7919 + f) for f in range(n) for v in range(f % 3 + 1)] + [("s", 0, 0, "empty", "num", None, None)]
    cells = spark.createDataFrame(rows, "dataset string, repeat int, fold int, feature string, kind string, num double, cat string")
    sr = SplitRows(spark.createDataFrame([("s", 0, 0)], "dataset string, repeat int, fold int"), [])
    got = {r.column: r.value for r in external.general(sr, profiles(cells)).collect()}
    assert got["pymfe__nr_bin"] == n / 3 and got["pymfe__nr_attr"] == n + 1
    assert (got["pymfe__nr_num"], got["pymfe__nr_cat"]) == (n / 2 + 1, n / 2)


def test_composite_weights_pass_on(spark):
    t = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 4.0), ("c", 3.0, None)], "dataset string, irreg_std_skew double, irreg_range_skew double")
    got = {r.dataset: r.irregularity for r in composite(t).collect()}
    z = 1 / np.std([1, 2, 3])
    assert got["a"] == pytest.approx(0.23 * -z + 0.22 * -1)
    assert got["c"] == pytest.approx(0.23 * z * 0.45 / 0.23)


def test_dataset_level_strict_means(spark):
    gap = lambda f, d: ("x", 0, f, "c", "a", "b", "A", "B", None, "m", d, d, "n", 0.0, 0.0, d, d)
    gaps = spark.createDataFrame([gap(0, 0.5), gap(1, 0.25)], GAP_SCHEMA)
    desc = spark.createDataFrame([("x", 0, 0, 1.0, None), ("x", 0, 1, 3.0, 2.0)], "dataset string, repeat int, fold int, full double, holed double")
    r = dataset_level(gaps, desc).first()
    assert (r.n_splits, r.delta_norm, r.full, r.holed) == (2, 0.375, 2.0, None)
    with pytest.raises(ValueError):
        assert_unique(desc, ["dataset"], "descriptors")


def test_p_values_and_corrections(spark):
    got = spark.createDataFrame([(0.3, 30), (0.5, 31), (0.9, 3), (1.0, 10)], "r double, n int").select(two_sided_p(F.col("r"), F.col("n")).alias("p"), "r", "n").collect()
    for x in got:
        assert x.p == pytest.approx(t_tail(x.r, x.n - 2), abs=1e-12)
    # numerical integration of the t density for r = 0.3, n = 30
    nu, t = 28, 0.3 * np.sqrt(28 / (1 - 0.09))
    s = np.linspace(t, 400, 2_000_001)
    density = (1 + s**2 / nu) ** (-(nu + 1) / 2)
    whole = np.linspace(-400, 400, 2_000_001)
    assert got[0].p == pytest.approx(2 * np.trapezoid(density, s) / np.trapezoid((1 + whole**2 / nu) ** (-(nu + 1) / 2), whole), abs=1e-5)
    p = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (None,)], "p double")
    rows = with_step_down(with_step_up(p, "p", "bh", []), "p", "holm", []).where("p is not null").orderBy("p").collect()
    assert [r.bh for r in rows] == pytest.approx([0.03, 0.03, 0.03]) and [r.holm for r in rows] == pytest.approx([0.03, 0.04, 0.04])


@pytest.fixture(scope="module")
def analysis(spark):
    r = np.random.default_rng(5)
    y = r.normal(size=40)
    t = pd.DataFrame({"dataset": [f"d{i:02d}" for i in range(40)], "delta_norm": y, "strong": y + r.normal(0, 0.2, 40), "twin": y * 3, "noise": r.normal(size=40), "flat": 1.0, "n": r.integers(10, 99, 40).astype(float)})
    t.loc[:20, "noise"] = np.nan
    return spark.createDataFrame(t.replace({np.nan: None}))


def test_associations_and_filters(analysis):
    names = ["strong", "twin", "noise", "flat", "n"]
    got = {r.feature: r for r in associations.associations(analysis, "t", names, repeats=40).collect()}
    assert got["twin"].spearman_r == pytest.approx(1.0) and got["twin"].p_value == 0.0 and got["twin"].effect_rank == 1
    assert got["noise"].reason == "n < 30" and got["flat"].reason == "feature has <2 observed values"
    assert got["strong"].ci_low > 0.5 and got["strong"].bootstrap_sign_consistency == 1.0
    kept, report = features.preprocess(analysis, names, "t", ["dataset", "delta_norm"])
    assert {r.feature: r.reason for r in report.collect()} == {"noise": "> 20% missing", "flat": "exact_constant"}
    reduced, dropped = features.reduce_redundant(kept, ["strong", "twin", "n"], "t", ["dataset", "delta_norm"], 0.9)
    assert [r.dropped_feature for r in dropped.collect()] == ["twin"] and "twin" not in reduced.columns
    with pytest.raises(ValueError):
        associations.associations(analysis.unionByName(analysis.limit(1)), "t", names)


def test_sensitivity(analysis):
    found = associations.associations(analysis, "t", ["strong", "n"], repeats=40)
    result, report, controls = sensitivity.sensitivity(analysis, associations.robust_associations(found, "t"), "t", repeats=40)
    r = result.first()
    assert r.feature == "strong" and r.adjusted_direction_stable and r.adjusted_rank_coefficient > 0.8
    assert {c.control: c.included for c in controls.collect()} == {"n_samples": True, "n_features": False, "feature_sample_ratio": False}


def test_leave_one_out_models(analysis):
    specs = predictive.model_specs(["strong"], ["n"], boosted=False)
    p = predictive.leave_one_out(analysis, specs)
    pdf = analysis.toPandas()
    got = p.where("model = 'ridge_meta_features'").orderBy("dataset").toPandas()
    k = 7
    rest = pdf.drop(index=k)
    want, alpha, _ = predict("ridge", rest[["strong"]].to_numpy(float), rest["delta_norm"].to_numpy(float), pdf[["strong"]].to_numpy(float)[k : k + 1])
    assert got["y_pred"][k] == pytest.approx(want[0]) and got["alpha"][k] == pytest.approx(alpha)
    m = {r.model: r for r in predictive.with_baseline_delta(predictive.metrics(p, "model")).collect()}
    assert m["ridge_meta_features"].delta_mae_vs_baseline > 0.3
    base = predictive.mean_baseline(analysis).orderBy("dataset").toPandas()
    assert np.allclose(base["y_pred"], p.where("model = 'mean_baseline'").orderBy("dataset").toPandas()["y_pred"])


def test_kernels():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(30, 3)), r.normal(size=30)
    m = fit_ridge(x, y)
    loss = []
    for a in np.logspace(-3, 3, 13):  # brute force leave-one-out
        e = []
        for k in range(30):
            q = np.arange(30) != k
            mx, my = x[q].mean(0), y[q].mean()
            b = np.linalg.solve((x[q] - mx).T @ (x[q] - mx) + a * np.eye(3), (x[q] - mx).T @ (y[q] - my))
            e.append((y[k] - my - (x[k] - mx) @ b) ** 2)
        loss.append(np.mean(e))
    assert m.alpha == pytest.approx(np.logspace(-3, 3, 13)[int(np.argmin(loss))])
    step = np.where(np.arange(20) < 8, 0.0, 1.0)
    t = fit_tree(np.arange(20.0)[:, None], step)
    assert t.threshold == 7.5 and t.predict_one(np.array([3.0])) == 0.0
    fit = ols(x, 2 * x[:, 0] + 1)
    assert fit["coef"] == pytest.approx([2, 0, 0], abs=1e-9) and fit["r2"] == pytest.approx(1)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "stages"))
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert store.once(2, "metafeatures", "k", build).count() == 3
    assert len(built) == 1
    store.write_json({"a": {2, 1}}, 1, "raw", "k")
    assert store.read_json(1, "raw", "k") == {"a": [1, 2]}
    assert store.invalidate(2) == ["stage2_metafeatures"] and store.read(2, "metafeatures", "k") is None
    assert content_hash({"b": 1, "a": 2}) == content_hash({"a": 2, "b": 1})
