"""Tables that several steps read are made once: counts of the rows that a plan takes from its source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.operators import associations, descriptors, pairs
from splitscope.queries import QUERIES, inputs
from splitscope.sources.splits import SplitRows

SF = "/root/testdata/sf0.001"


def counted(df):
    """``df`` and an accumulator of the rows that were read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_associations_read_their_table_once(spark):
    rows = [(f"d{k:02d}", float(k % 7), float(k * k % 11), float(k * 5 % 13)) for k in range(40)]
    table, seen = counted(spark.createDataFrame(rows, "dataset string, a double, b double, delta_norm double"))
    found = associations.associations(table, "t", ["a", "b"], repeats=30, check=False)
    assert {(r.feature, r.n, r.bootstrap_repeats_used) for r in found.collect()} == {("a", 40, 30), ("b", 40, 30)}
    assert seen.value == 40


def test_a_stored_profile_counts_its_rows_once(spark):
    table, seen = counted(spark.range(400).select(F.lit("s").alias("dataset"), F.lit(0).alias("repeat"), F.lit(0).alias("fold"), (F.col("id") % 300).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("k")))
    sr = SplitRows(table, ["x", "k"])
    stored = descriptors.stored_profiles(sr)
    got = sorted(map(tuple, stored.collect()))
    assert seen.value == 400 and stored.count() == 2 and seen.value == 400
    assert got == sorted(map(tuple, descriptors.profiles(sr).select(*stored.columns).collect()))


def test_a_stored_profile_looks_at_its_counts_five_times(spark):
    """For counts, borders, sums, quartiles and what lies beyond their fences."""
    sr = SplitRows(spark.range(900).select(F.lit("s").alias("dataset"), F.lit(0).alias("repeat"), F.lit(0).alias("fold"), F.sqrt("id").alias("x")), ["x"])
    v = descriptors.values(sr).stored()
    v.table, seen = counted(v.table)
    got = descriptors.stored_profiles(sr, v=v).first()
    assert seen.value <= 5 * 900
    x = np.sqrt(np.arange(900))
    assert (got.q1, got.mid, got.q3) == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75])) and got.outside == 0 and got.std == pytest.approx(x.std(ddof=1))


# values, rows by class and results; products by class; values, rows, keys, products, classes, products and counts by class, and counts of pairs
@pytest.mark.parametrize(("name", "most"), [("usable_features", 3), ("rank_stability", 3), ("class_scatter", 1), ("external_descriptors", 8)])
def test_queries_read_lineitem_few_times(spark, monkeypatch, name, most):
    plain, seen = inputs.table, []

    def table(spark, sf_dir, name):
        df = plain(spark, sf_dir, name)
        if name != "lineitem":
            return df
        df, count = counted(df)
        seen.append(count)
        return df

    monkeypatch.setattr(inputs, "table", table)
    QUERIES[name](spark, SF).collect()
    n = plain(spark, SF, "lineitem").count()
    assert n <= sum(c.value for c in seen) <= most * n


@pytest.mark.parametrize("p", [3, pairs.FEW + 2])
def test_products_of_many_units_at_once(p):
    r = np.random.default_rng(p)
    x = r.normal(1e6, 1, (300, p))
    x[r.random(x.shape) < 0.1] = np.nan
    unit = np.sort(r.integers(0, 40, 300))
    held = pairs.Moments(p)
    for part in (np.arange(0, 300, 2), np.arange(1, 300, 2)):  # two batches
        u = unit[part]
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        held.add([(int(k),) for k in u[starts]], starts, x[part])
    for (u,), at in held.at.items():
        for i, j, n, mean_i, mean_j, ss_i, ss_j, sp in zip(*held.pairs(at, at + 1), strict=True):
            own = x[unit == u][:, [i, j]]
            own = own[~np.isnan(own).any(1)]
            assert n == len(own)
            if n:
                assert (mean_i, mean_j) == pytest.approx(own.mean(0)) and (ss_i, ss_j) == pytest.approx(own.var(0) * n, abs=1e-8) and sp == pytest.approx(np.prod(own - own.mean(0), axis=1).sum(), abs=1e-8)
