"""Least squares from sums: rows are met where they lie, and only sums of products come together.

The first meeting adds up the cross products of all models' columns (:func:`~splitscope.operators.pairs.moments`, merged about their means), which give
coefficients, the inverse of the cross products and the variance inflation of each model.  The second adds up squared residuals and the products that
the HC3 errors need, with leverages from the inverse of the first.  What comes to the driver is a square of at most ``MAX_FEATURES`` columns for
each model, whatever the number of rows.

Rank regressions of resamples never copy a row for each time it is drawn: a replicate holds each unit once with its number of draws, ranks are running sums
of these numbers, and since the mean rank is known, sums of rank products are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import as_number
from ..sources.scratch import written
from ..sources.splits import SplitRows
from .descriptors import profiles
from .features import coerce
from .kernels import t_tail
from .pairs import MAX_FEATURES, moments

TARGET = "target"
_SUMS = "model string, i int, j int, s double"
_FITS = "rep int, predictor string, coefficient double, n int, predictors int, condition double"
OLS = "model string, predictor string, n int, coefficient double, se double, hc3_se double, ci_low double, ci_high double, p_value double, r2 double, adjusted_r2 double, max_vif double"


@dataclass
class Fit:
    """A model by its sums: columns are centred and scaled, so the intercept is the mean of the target."""

    names: list[str]
    n: int
    centre: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray
    coefficient: np.ndarray
    mean: float
    total: float
    vif: float


def _squares(sums: DataFrame) -> dict[str, dict[tuple[str, str], tuple]]:
    """Per model, the moments of each pair of columns, in both orders."""
    out: dict[str, dict] = {}
    for r in sums.where("n > 0").select("dataset", "a", "b", "n", "mean_a", "mean_b", "sp").collect():  # a square for each model
        cell = out.setdefault(r["dataset"], {})
        cell[r["a"], r["b"]] = cell[r["b"], r["a"]] = (r["n"], r["sp"])
        if r["a"] == r["b"]:
            cell[r["a"],] = r["mean_a"]
    return out


def _scaled(square: dict, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations (1 for constant columns), which columns vary, and the correlations (0 with constant columns)."""
    n = square[names[0], names[0]][0]
    cov = np.array([[square[a, b][1] for b in names] for a in names]) / n
    centre, sd = np.array([square[a,] for a in names]), np.sqrt(np.maximum(0, np.diag(cov)))
    live = sd > 64 * np.finfo(float).eps * np.maximum(1, np.abs(centre))
    scale = np.where(live, sd, 1.0)
    return centre, scale, live, np.where(np.outer(live, live), cov / np.outer(scale, scale), 0.0)


def _solved(square: dict, names: list[str], target: str) -> Fit | None:
    n, total = square.get((target, target), (0, 0.0))
    if n <= len(names) + 1:
        return None
    centre, scale, live, r = _scaled(square, names)
    inverse = np.linalg.pinv(r * n, rcond=1e-13, hermitian=True)
    xy = np.where(live, np.array([square[c, target][1] for c in names]) / scale, 0.0)
    inner = r[np.ix_(live, live)]
    vif = float(np.diag(np.linalg.pinv(inner, rcond=1e-13, hermitian=True)).max()) if len(names) > 1 and len(inner) else 1.0
    return Fit(names, int(n), centre, scale, inverse, inverse @ xy, square[target,], total, vif)


def _residual_sums(rows: DataFrame, fits: dict[str, Fit], at: dict[str, int]) -> DataFrame:
    """``model, i, j, s``: sums of products of columns i <= j weighted by (residual / (1 - leverage)) ** 2, and of squared residuals at i = j = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, float]] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(at))])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for model in set(label.tolist()) & fits.keys():
                f, mine = fits[model], label == model
                z = (x[mine][:, [at[c] for c in f.names]] - f.centre) / f.scale
                e = y[mine] - f.mean - z @ f.coefficient
                leverage = np.clip(1 / f.n + ((z @ f.inverse) * z).sum(1), 0, 1 - 1e-12)
                w = z * (e / (1 - leverage))[:, None]
                meat, sse = held.get(model, (0.0, 0.0))
                held[model] = (meat + w.T @ w, sse + float(e @ e))
        for model, (meat, sse) in held.items():
            i, j = np.triu_indices(len(meat))
            yield pa.RecordBatch.from_arrays([pa.array([model] * (len(i) + 1)), pa.array([*i.tolist(), -1], pa.int32()), pa.array([*j.tolist(), -1], pa.int32()), pa.array([*meat[i, j].tolist(), sse])], names=["model", "i", "j", "s"])

    return rows.mapInArrow(run, _SUMS).groupBy("model", "i", "j").agg(F.sum("s").alias("s"))


def ols_models(table: DataFrame, models: dict[str, Sequence[str]], target: str = "delta_norm", raw: bool = False) -> DataFrame:
    """One row per model and predictor: least squares on the complete rows of each model, standardised unless ``raw``, with classical and HC3 errors,
    95 % interval by HC3, p value, fit and largest variance inflation.

    A model with no more rows than coefficients has no row; a constant predictor has coefficient 0; of collinear ones the least squares of
    least norm are taken."""
    spark, columns = table.sparkSession, sorted({c for p in models.values() for c in p})
    if len(columns) >= MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES - 1} predictors in all, not {len(columns)}")
    at = {c: k for k, c in enumerate(columns)}
    if not columns:
        return spark.createDataFrame([], OLS)

    def of_model(name: str, predictors: Sequence[str]) -> Column:
        cells = (F.col(c) if c in predictors else F.lit(None).cast("double") for c in columns)
        complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in predictors), F.col(target).isNotNull())
        return F.when(complete, F.struct(F.lit(name).alias("dataset"), F.col(target).alias(TARGET), *(v.alias(f"x{k}") for k, v in enumerate(cells))))

    numbers = coerce(table, list(dict.fromkeys([target, *columns])))  # the table is read once for all models
    rows = numbers.select(F.inline(F.array_compact(F.array(*(of_model(m, p) for m, p in models.items())))))
    rows = written(rows, "models")  # read by both meetings
    split = rows.withColumns({"repeat": F.lit(0), "fold": F.lit(0)})
    squares = _squares(moments(SplitRows(split, [TARGET, *(f"x{k}" for k in range(len(columns)))])))
    found = {m: _solved(squares.get(m, {}), [f"x{at[c]}" for c in p], TARGET) for m, p in models.items() if p}
    fits = {m: f for m, f in found.items() if f is not None}
    if not fits:
        return spark.createDataFrame([], OLS)
    sums: dict[str, dict] = {}
    for r in _residual_sums(rows, fits, {f"x{k}": k for k in range(len(columns))}).collect():  # a square for each model
        sums.setdefault(r["model"], {})[r["i"], r["j"]] = r["s"]
    out = []
    for m, f in fits.items():
        p, sse = len(f.names), sums[m][-1, -1]
        meat = np.array([[sums[m][min(i, j), max(i, j)] for j in range(p)] for i in range(p)])
        dof, unit = f.n - p - 1, f.scale if raw else np.ones(p)
        se = np.sqrt(np.maximum(0, np.diag(f.inverse) * sse / max(1, dof)))
        hc3 = np.sqrt(np.maximum(0, np.diag(f.inverse @ meat @ f.inverse)))
        r2 = 1 - sse / f.total if f.total > 0 else float("nan")
        for k, c in enumerate(models[m]):
            t = f.coefficient[k] / se[k] if se[k] > 0 else math.inf
            p_value = t_tail(float(t / math.sqrt(t * t + dof)), dof) if math.isfinite(t) else 0.0
            b, h = float(f.coefficient[k] / unit[k]), float(hc3[k] / unit[k])
            out.append((m, c, f.n, b, float(se[k] / unit[k]), h, b - 1.96 * h, b + 1.96 * h, p_value, float(r2), float(1 - (1 - r2) * (f.n - 1) / dof), f.vif))
    return spark.createDataFrame(out, OLS)


def matrix_rank(table: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """``analysis_table, n, n_features, effective_rank``: the exponential of the entropy of the correlations' eigenvalues, missing values at the median of
    their column (0 without values), constant columns left out; NULL without rows or varying columns."""
    spark, names = table.sparkSession, [f"x{k}" for k in range(len(features))]
    if len(features) > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features, not {len(features)}")
    schema = "analysis_table string, n int, n_features int, effective_rank double"
    if not features:
        return spark.createDataFrame([(name, table.count(), 0, None)], schema)
    keys = {"dataset": F.lit(name), "repeat": F.lit(0), "fold": F.lit(0)}
    rows = written(table.select(*(v.alias(k) for k, v in keys.items()), *(as_number(table.schema[c]).alias(x) for c, x in zip(features, names, strict=True))), "matrix")
    medians = {r["feature"]: r["mid"] for r in profiles(SplitRows(rows, names)).select("feature", "mid").collect()}  # one row for each column
    filled = rows.withColumns({x: F.coalesce(x, F.lit(float(medians.get(x) or 0.0))) for x in names})
    square = _squares(moments(SplitRows(filled, names))).get(name, {})
    if not square:
        return spark.createDataFrame([(name, 0, len(features), None)], schema)
    _, _, live, r = _scaled(square, names)
    v = np.clip(np.linalg.eigvalsh(r[np.ix_(live, live)]), 0, None) if live.any() else np.zeros(0)
    p = v[v > 0] / v.sum() if len(v) else v
    rank = float(np.exp(-(p * np.log(p)).sum())) if len(p) else None
    return spark.createDataFrame([(name, int(square[names[0], names[0]][0]), len(features), rank)], schema)


def rank_fits(drawn: DataFrame, predictors: Sequence[str], target: str, min_n: int) -> DataFrame:
    """``rep, predictor, coefficient, n, predictors, condition``: least squares on the z-scores of average ranks in every replicate.

    ``drawn``: ``rep, times``, predictors and target, one row per replicate and unit.  Constant predictors are left out; a replicate with a constant
    target, fewer than ``min_n`` rows, or no more than two above its predictors has no row; collinear ranks have an infinite condition number."""
    names = [target, *predictors]
    by = W.partitionBy("rep")
    rank = lambda c: F.sum("times").over(by.orderBy(c)) - (F.sum("times").over(W.partitionBy("rep", c)) - 1) / 2
    size = F.sum("times").over(by)
    centred = drawn.select("rep", "times", size.alias("n"), *((rank(c) - (size + 1) / 2).alias(f"r{k}") for k, c in enumerate(names)))
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    product = lambda i, j: F.sum(F.col("times") * F.col(f"r{i}") * F.col(f"r{j}"))  # noqa: E731  multiples of a quarter: exact
    sums = centred.groupBy("rep").agg(F.max("n").cast("int").alias("n"), F.array(*(product(i, j) for i, j in cells)).alias("s"))
    labels = list(predictors)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for rep, n, s in zip(pdf["rep"], pdf["n"], pdf["s"], strict=True):
                m = np.zeros((len(labels) + 1,) * 2)
                for (i, j), v in zip(cells, s, strict=True):
                    m[i, j] = m[j, i] = v / n
                live = [k for k in range(1, len(m)) if m[k, k] > 0]
                if n < min_n or n <= len(labels) + 2 or not m[0, 0] > 0 or not live:
                    continue
                sd = np.sqrt(np.diag(m)[[0, *live]])
                r = m[np.ix_([0, *live], [0, *live])] / np.outer(sd, sd)
                v, u = np.linalg.eigh(r[1:, 1:])
                kept = v > len(live) * np.finfo(float).eps * 8 * v.max()
                b = (u[:, kept] / v[kept]) @ (u[:, kept].T @ r[1:, 0])
                condition = math.sqrt(max(1.0, v.max()) / min(1.0, v.min())) if kept.all() else math.inf
                out += [(rep, labels[k - 1], float(c), n, len(live), condition) for k, c in zip(live, b, strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FITS.split(", ")])

    return sums.mapInPandas(solve, _FITS)
