"""Least squares from sums against the plain versions on one matrix."""

import numpy as np
import pandas as pd
import pytest
from plain import fit_rank_ols, ols
from pyspark.sql import functions as F

from splitscope.functions.expressions import resample_index
from splitscope.operators import leastsquares, sensitivity
from splitscope.operators.kernels import standardise


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=60)
    t = pd.DataFrame({"dataset": [f"d{i:02d}" for i in range(60)], "x": np.round(x, 1), "far": 1e7 + r.normal(size=60), "ties": r.integers(0, 4, 60).astype(float), "flat": 3.1, "delta_norm": x + 0.3 * r.normal(size=60)})
    t["twice"] = 2 * t.x
    t["holes"] = np.where(np.arange(60) % 7 == 0, np.nan, r.exponential(size=60))
    return spark.createDataFrame(t.replace({np.nan: None})).repartition(5), t


def test_models_equal_the_plain_fit(frame):
    df, t = frame
    models = {"one": ["x"], "wide": ["x", "far", "ties"], "holes": ["holes", "x"], "few": ["x"] * 0, "flat": ["flat", "x"]}
    got = leastsquares.ols_models(df, models).toPandas().set_index(["model", "predictor"])
    for m in ("one", "wide", "holes"):
        own = t.dropna(subset=models[m])
        want = ols(standardise(own[models[m]].to_numpy(float))[0], own.delta_norm.to_numpy())
        for k, c in enumerate(models[m]):
            row = got.loc[m, c]
            assert (row.n, row.coefficient, row.se, row.hc3_se, row.p_value) == (len(own), *(pytest.approx(want[w][k], rel=1e-7) for w in ("coef", "se", "hc3", "p")))
            assert (row.r2, row.adjusted_r2) == (pytest.approx(want["r2"]), pytest.approx(want["adjusted_r2"]))
    assert got.loc["flat", "flat"].coefficient == 0 and got.loc["flat", "x"].coefficient == pytest.approx(got.loc["one", "x"].coefficient)
    assert "few" not in got.index


def test_raw_collinear_and_empty(frame):
    df, t = frame
    raw = leastsquares.ols_models(df, {"m": ["x", "ties"]}, raw=True).toPandas().set_index("predictor")
    want = ols(t[["x", "ties"]].to_numpy(), t.delta_norm.to_numpy())
    assert raw.coefficient["ties"] == pytest.approx(want["coef"][1]) and raw.hc3_se["x"] == pytest.approx(want["hc3"][0])
    both = leastsquares.ols_models(df, {"m": ["x", "twice"], "x": ["x"]}).toPandas().set_index(["model", "predictor"]).coefficient
    assert both["m", "x"] == pytest.approx(both["m", "twice"]) and both["m", "x"] * 2 == pytest.approx(both["x", "x"])
    assert leastsquares.ols_models(df.where("false"), {"m": ["x"]}).count() == 0
    assert leastsquares.ols_models(df.limit(2), {"m": ["x"]}).count() == 0
    assert leastsquares.matrix_rank(df.where("false"), ["x"], "t").first().effective_rank is None
    assert leastsquares.matrix_rank(df, ["flat"], "t").first().effective_rank is None


def test_effective_rank_fills_with_medians(frame):
    df, t = frame
    names = ["x", "holes", "ties", "flat"]
    got = leastsquares.matrix_rank(df, names, "t").first()
    v = np.linalg.eigvalsh(np.corrcoef(t[names[:3]].fillna(t[names[:3]].median()).to_numpy(), rowvar=False))
    p = v / v.sum()
    assert (got.n, got.n_features, got.effective_rank) == (60, 4, pytest.approx(np.exp(-(p * np.log(p)).sum())))


def test_rank_fits_of_resamples(frame, spark):
    df, t = frame
    names = ["x", "ties", "flat"]
    got = sensitivity.bootstrap_fits(df, names, "delta_norm", 7, 5).toPandas()
    draw = spark.range(60).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep")).select("rep", resample_index(F.lit(60), F.lit(7), F.col("rep"), F.col("id")).cast("int").alias("at")).toPandas()
    for rep in range(-1, 5):
        rows = t if rep < 0 else t.iloc[draw[draw.rep == rep]["at"].to_numpy()]
        want, condition = fit_rank_ols(rows[names].to_numpy(float), rows.delta_norm.to_numpy())
        own = got[got.rep == rep].set_index("predictor")
        assert set(own.index) == {"x", "ties"} == {names[k] for k in want} and set(own.n) == {60} and set(own.predictors) == {2}
        assert own.coefficient["x"] == pytest.approx(want[0]) and own.coefficient["ties"] == pytest.approx(want[1]) and own.condition.iloc[0] == pytest.approx(condition)
    collinear = sensitivity.bootstrap_fits(df, ["x", "twice"], "delta_norm", 7, 1).toPandas()
    assert np.isinf(collinear.condition).all() and collinear[collinear.rep == -1].coefficient.nunique() == 1
    assert sensitivity.bootstrap_fits(df, ["flat"], "delta_norm", 7, 1).count() == 0 and sensitivity.bootstrap_fits(df.limit(20), ["x"], "delta_norm", 7, 1).count() == 0
