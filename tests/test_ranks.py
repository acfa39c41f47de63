"""Rank operators against brute force: pairs by missingness pattern, leave-one-out without copies, the greedy choice in rounds."""

import random

import numpy as np
import pandas as pd
import pytest

from splitscope.operators import ranks


def _long(table: pd.DataFrame) -> pd.DataFrame:
    out = table.melt("dataset", var_name="feature", value_name="value")
    return out.astype({"value": object}).where(out["value"].notna(), None)


def test_pairs_are_ranked_in_their_common_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 2)
    r = np.random.default_rng(3)
    n, names = 24, [f"f{k}" for k in range(9)]
    table = pd.DataFrame({"dataset": [f"d{k:02d}" for k in range(n)], **{f: r.integers(0, 7, n).astype(float) for f in names}})
    table.loc[:9, ["f1", "f4", "f5"]] = np.nan  # one pattern of three features
    table.loc[6:15, ["f2"]] = np.nan
    table.loc[2:, "f7"] = np.nan  # too few
    table["f8"] = 4.0  # constant
    got = {(x.a, x.b): (x.n, x.r) for x in ranks.rank_correlations(spark.createDataFrame(_long(table), "dataset string, feature string, value double")).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = table[[a, b]].dropna()
            if len(both) >= 3:
                x, y = both[a].rank(), both[b].rank()
                want[a, b] = (len(both), None if x.nunique() < 2 or y.nunique() < 2 else np.corrcoef(x, y)[0, 1])
    assert got.keys() == want.keys()
    for pair, (k, v) in want.items():
        assert got[pair][0] == k and (got[pair][1] is None if v is None else got[pair][1] == pytest.approx(v, abs=1e-12)), pair


def test_pairs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "dataset string, feature string, value double")
    assert ranks.rank_correlations(empty).count() == 0


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_leave_one_out_equals_a_fit_without_each_unit(spark, method):
    r = np.random.default_rng(8)
    rows = []
    for f, (n, values) in {"ties": (33, 5), "free": (40, 10**9), "two": (2, 9), "one": (1, 9), "pair": (16, 2)}.items():
        rows += [(f, f"d{k:02d}", float(x), float(y)) for k, (x, y) in enumerate(zip(r.integers(0, values, n), r.integers(0, values, n), strict=True))]
    rows += [("nearly", f"d{k:02d}", 1.0 + (k == 4), float(k)) for k in range(9)] + [("flat", f"d{k:02d}", 0.1, float(k)) for k in range(9)]
    table = pd.DataFrame(rows, columns=["feature", "unit", "x", "y"])

    def whole(t: pd.DataFrame) -> float | None:
        if len(t) < 2 or t.x.nunique() < 2 or t.y.nunique() < 2:
            return None
        return t.x.corr(t.y) if method == "pearson" else np.corrcoef(t.x.rank(), t.y.rank())[0, 1]

    want = {(f, u): whole(t[t.unit != u]) for f, t in table.groupby("feature") for u in t.unit}
    got = {(x.feature, x.without): x for x in ranks.leave_one_out(spark.createDataFrame(table), method).collect()}
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key].r is None if v is None else got[key].r == pytest.approx(v, abs=1e-9), key
        all_units = whole(table[table.feature == key[0]])
        assert got[key].rho is None if all_units is None else got[key].rho == pytest.approx(all_units, abs=1e-9), key


def test_rows_of_leave_one_out_grow_with_the_units(spark):
    n = 512
    table = spark.range(n).selectExpr("'f' AS feature", "CAST(id AS string) AS unit", "CAST(id * 7 % 512 AS double) AS x", "CAST(id * 11 % 509 AS double) AS y")
    above = {int(x.unit): x.above for x in ranks.above_in_both(table, "feature").collect()}
    x, y = np.arange(n) * 7 % 512, np.arange(n) * 11 % 509
    u = lambda v: (v[None, :] > v[:, None]) + 0.5 * (v[None, :] == v[:, None])
    both = u(x) * u(y)
    np.fill_diagonal(both, 0)
    assert [above[k] for k in range(n)] == both.sum(1).tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_choice_equals_the_walk(spark, seed):
    r = random.Random(seed)
    names = [f"f{k:02d}" for k in range(30)]
    better = {f: k for k, f in enumerate(r.sample(names, 30))}
    pairs = [(a, b, r.choice([0.95, 0.96, 0.97, 0.99])) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.2]
    want, gone = [], set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            keep, drop = sorted((a, b), key=better.get)
            gone.add(drop)
            want.append((drop, keep, s))
    rows = [(*sorted((a, b), key=better.get), s, a, b) for a, b, s in pairs]
    got = ranks.fallen(spark.createDataFrame(rows, "keep string, drop string, abs_spearman double, a string, b string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_greedy_choice_without_pairs(spark):
    assert ranks.fallen(spark.createDataFrame([], "keep string, drop string, abs_spearman double, a string, b string")).count() == 0
