"""Folds against copied rows, exact quartiles of hot columns, class-dependent descriptors, failures of single splits, writers at the same time."""

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitscope.config import parse_config
from splitscope.operators import classwise, descriptors, external, irregularity, pairs, redundancy
from splitscope.plans import pipeline
from splitscope.plans.store import Store
from splitscope.schemas import SPLIT
from splitscope.sources.splits import SplitRows, folded_rows


@pytest.fixture(scope="module")
def folded(spark):
    r = np.random.default_rng(4)
    n = 900
    t = pd.DataFrame({
        "dataset": np.where(np.arange(n) < 700, "a", "b"), "x": r.normal(3, 2, n), "z": np.round(r.exponential(1, n), 1), "c": 7.0, "w": r.normal(0, 1, n) * 1e6 - 4e8,
        "k": r.choice(["p", "q", "r"], n), "u": [f"only{i}" for i in range(n)], "y": r.choice(["A", "N", "R"], n, p=[0.5, 0.3, 0.2]), "f0": r.integers(0, 3, n), "f1": r.integers(0, 3, n),
    })
    t["x"] += (t.y == "A") * 1.5
    rows = spark.createDataFrame(t).repartition(4)
    rows = rows.withColumns({"x": F.when(F.rand(1) > 0.1, F.col("x")), "k": F.when(F.col("z") > 0.1, F.col("k")), "f1": F.when(F.col("z") < 3, F.col("f1"))})
    rows = rows.withColumn("c", F.when((F.col("dataset") == "b") & (F.col("f0") == 1), F.lit(8.0)).otherwise(F.col("c")))
    path = spark.conf.get("spark.checkpoint.dir") + "/folded"
    rows.write.mode("overwrite").parquet(path)
    splits = spark.createDataFrame([(d, i, f, "multiclass") for d, i, f in [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 0), ("a", 1, 2), ("b", 0, 1), ("b", 0, 0), ("c", 0, 0)]], "dataset string, repeat int, fold int, problem_type string")
    return folded_rows(spark.read.parquet(path), splits, [F.col("f0"), F.col("f1")], 3, ["x", "z", "c", "w", "k", "u"], "y")


def table(df, *by):
    pdf = df.toPandas()
    return pdf[sorted(pdf.columns)].sort_values(list(by)).reset_index(drop=True)


def same(a, b, *by, near=1e-9):
    pd.testing.assert_frame_equal(table(a, *by), table(b, *by), rtol=1e-9, atol=near, check_dtype=False)


def test_folds_equal_copied_rows(folded):
    copied = folded.expanded()
    assert folded.rows.count() == 900 and copied.rows.count() > 2500
    same(descriptors.profiles(folded), descriptors.profiles(copied), *SPLIT, "feature", near=1e-6)
    same(descriptors.presence(folded), descriptors.presence(copied), *SPLIT, "feature")
    same(descriptors.value_counts(folded), descriptors.value_counts(copied), *SPLIT, "feature", "num", "cat")
    same(folded.keys(), copied.keys(), *SPLIT)
    same(descriptors.split_rows(folded), descriptors.split_rows(copied), *SPLIT)
    same(descriptors.target(folded), descriptors.target(copied), *SPLIT)
    assert folded.keys().count() == 7  # nothing trains a dataset without rows


def test_folded_products_equal_copied_rows(folded):
    copied = folded.expanded()
    for whole in (False, True):
        same(pairs.moments(folded, whole), pairs.moments(copied, whole), *SPLIT, "a", "b", near=1e-2)
    same(classwise.class_products(folded), classwise.class_products(copied), *SPLIT, "y", "a", "b", near=1e-2)
    same(redundancy.redundancy(folded), redundancy.redundancy(copied), *SPLIT)
    same(irregularity.irregularity(folded), irregularity.irregularity(copied), *SPLIT)


def test_folded_external_equals_copied_rows(folded):
    groups = ("general", "info-theory")
    one, two = (external.external(sr, groups, ("mean",)) for sr in (folded, folded.expanded()))
    assert set(one.columns) == {*SPLIT, *external.external_columns(groups, ("mean",))}
    same(one, two, *SPLIT, near=1e-4)


def test_chosen_splits_alone(spark, folded):
    some = folded.only(spark.createDataFrame([("a", 1, 2)], "dataset string, repeat int, fold int"))
    assert [tuple(r)[:3] for r in some.keys().collect()] == [("a", 1, 2)] and some.rows.select("dataset").distinct().count() == 1
    want = descriptors.profiles(folded).where("dataset = 'a' and repeat = 1 and fold = 2")
    same(descriptors.profiles(some), want, "feature")


@pytest.mark.parametrize("kind", ["outlier", "narrow", "ties"])
def test_hot_column_is_spread(spark, kind):
    r = np.random.default_rng(9)
    v = {"outlier": np.append(r.normal(size=5999), 1e12), "narrow": 1.7e15 + r.integers(0, 10**6, 6000), "ties": np.append(np.round(r.normal(size=3000), 2), r.normal(size=3000))}[kind]
    cells = spark.createDataFrame([("s", 0, 0, "f", "num", float(x), None) for x in v], "dataset string, repeat int, fold int, feature string, kind string, num double, cat string").repartition(4)
    counts = descriptors.values(cells)
    sizes = [x.n for x in descriptors._ranged(counts, descriptors._counted(counts)).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > descriptors.RANGES // 2 and max(sizes) < len(np.unique(v)) / 8
    p = descriptors.profiles(cells).first()
    q1, mid, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    assert (p.q1, p.mid, p.q3) == pytest.approx((q1, mid, q3), rel=1e-14)
    assert p.outside == ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum() and p.n_distinct == len(np.unique(v))
    assert p.std == pytest.approx(np.std(v, ddof=1), rel=1e-9) and p.skew == pytest.approx(pd.Series(v - v.min()).skew(), rel=1e-7, abs=1e-9)


def entropy(k):
    p = np.asarray(k) / np.sum(k)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def test_class_information(folded):
    t = folded.expanded().rows.where("dataset = 'a' and repeat = 0 and fold = 1").toPandas()
    told = {r.feature: r for r in classwise.information(classwise.contingency(folded)).where("dataset = 'a' and repeat = 0 and fold = 1").collect()}
    shared = []
    for f in ("k", "u"):
        own = t[t[f].notna()]
        c = pd.crosstab(own[f], own.y).to_numpy()
        h = entropy(c.sum(1)), entropy(c.sum(0)), entropy(c.ravel())
        p = c / c.sum()
        guess = (p.sum(0) ** 2).sum()
        tau = ((p**2 / p.sum(1, keepdims=True)).sum() - guess) / (1 - guess)
        assert (told[f].joint_ent, told[f].mut_inf, told[f].class_conc) == pytest.approx((h[2], h[0] + h[1] - h[2], tau))
        shared.append((h[0], h[0] + h[1] - h[2]))
    one = classwise.class_information(classwise.information(classwise.contingency(folded)), classwise.class_counts(folded)).where("dataset = 'a' and repeat = 0 and fold = 1").first()
    held, mean = np.mean(shared, axis=0)
    assert (one.class_ent, one.eq_num_attr, one.ns_ratio) == pytest.approx((entropy(t.y.value_counts()), entropy(t.y.value_counts()) / mean, (held - mean) / mean))


def test_class_scatter(folded):
    from dataclasses import replace

    sr = replace(folded, features=["x", "z", "w"])
    t = sr.expanded().rows.where("dataset = 'a' and repeat = 1 and fold = 2").toPandas().dropna(subset=["x", "z", "w"])
    got = classwise.class_scatter(classwise.class_products(sr)).where("dataset = 'a' and repeat = 1 and fold = 2").first()
    m = t[["x", "z", "w"]].to_numpy()
    groups = {y: m[(t.y == y).to_numpy()] for y in sorted(t.y.unique())}
    within = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups.values())
    between = sum(len(g) * np.outer(g.mean(0) - m.mean(0), g.mean(0) - m.mean(0)) for g in groups.values())
    roots = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1][:2]
    assert (got.lh_trace, got.p_trace, got.roy_root, got.w_lambda, got.nr_disc) == pytest.approx((roots.sum(), (roots / (1 + roots)).sum(), roots[0], 1 / np.prod(1 + roots), 2), rel=1e-6)
    assert got.can_cor == pytest.approx(np.sqrt(roots / (1 + roots)).tolist(), rel=1e-6)
    sizes = {y: len(g) for y, g in groups.items()}
    most, least = max(sizes, key=lambda y: (sizes[y], y)), min(sizes, key=lambda y: (sizes[y], y))
    assert got.gravity == pytest.approx(np.linalg.norm(groups[most].mean(0) - groups[least].mean(0)))
    n, q, p = len(m), len(groups), 3
    free = np.array([len(g) - 1 for g in groups.values()])
    pooled = np.linalg.slogdet(within / (n - q))[1]
    box = (1 - (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (q - 1)) * ((1 / free).sum() - 1 / (n - q))) * sum(k * (pooled - np.linalg.slogdet(np.cov(g.T))[1]) for k, g in zip(free, groups.values(), strict=True))
    assert got.sd_ratio == pytest.approx(math.exp(box / (p * free.sum())), rel=1e-6) and got.sd_ratio > 1


def test_class_descriptors_without_a_class(spark, folded):
    from dataclasses import replace

    for sr in (replace(folded, target=None), replace(folded, rows=folded.rows.withColumn("problem_type", F.lit("regression")))):
        assert classwise.contingency(sr).count() == 0 and classwise.class_counts(sr).count() == 0 and classwise.class_products(sr).count() == 0
        assert classwise.class_scatter(classwise.class_products(sr)).count() == 0
    got = external.external(sr, ("info-theory",), ("mean",))
    assert all(r["pymfe__class_ent"] is None and r["pymfe__attr_ent.mean"] is not None for r in got.collect())
    single = replace(folded, rows=folded.rows.withColumn("y", F.lit("A")))
    one = classwise.class_scatter(classwise.class_products(replace(single, features=["x", "z"]))).first()
    assert one.roy_root is None and one.gravity is None and one.sd_ratio is None


def test_normality(spark):
    r = np.random.default_rng(2)
    frames = [("normal", r.normal(size=400)), ("skewed", r.exponential(size=400)), ("flat", r.uniform(size=400)), ("few", r.normal(size=7)), ("constant", np.ones(50))]
    cells = spark.createDataFrame([("s", 0, 0, f, "num", float(x), None) for f, v in frames for x in v], "dataset string, repeat int, fold int, feature string, kind string, num double, cat string")
    profile = descriptors.profiles(cells)
    p = {x.feature: x.p for x in profile.select("feature", classwise.normality_p(F.col("n_values"), F.col("skew"), F.col("kurt")).alias("p")).collect()}
    assert p["normal"] > 0.05 and p["skewed"] < 1e-6 and p["flat"] < 1e-6 and p["few"] is None
    assert profile.groupBy(*SPLIT).agg(classwise.normal_count()).first().nr_norm == 1
    # a published example: 54 values with g1 = 0.1, b2 = 3 leave no doubt
    worked = spark.createDataFrame([(1000, 0.0, 0.0)], "n long, s double, k double").select(classwise.normality_p(F.col("n"), F.col("s"), F.col("k"))).first()[0]
    assert worked > 0.95


def test_one_bad_split_of_fifty(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", 0, 0, float(k), float(k * k % 7), "v", "c", "binary") for i in range(50) for k in range(6)]
    sr = SplitRows(spark.createDataFrame(rows, "dataset string, repeat int, fold int, a double, b double, k string, y string, problem_type string"), ["a", "b"], "y", "problem_type")
    plain, attempts = pipeline.build_set, []
    poison = F.when(F.col("dataset") == "d17", F.raise_error(F.lit("poisoned"))).otherwise(F.col("mean_abs_corr")).cast("double")

    def build(name, rows, c, profile):
        attempts.append(name)
        return plain(name, rows, c, profile).withColumn("mean_abs_corr", poison)

    monkeypatch.setattr(pipeline, "build_set", build)
    from test_pipeline import RAW

    config = parse_config(RAW | {"metafeatures": {"feature_sets": ["redundancy"]}})
    got = pipeline.describe_stored(sr, config, Store(spark, f"file://{tmp_path}/store"), "key").collect()
    bad = [r for r in got if r.failed_sets != "{}"]
    assert len(got) == 50 and [r.dataset for r in bad] == ["d17"] and "poisoned" in bad[0].failed_sets and bad[0].mean_abs_corr is None
    assert all(r.mean_abs_corr is not None for r in got if r.dataset != "d17") and len(attempts) <= 2 * math.ceil(math.log2(50)) + 3


def test_a_fault_of_the_set_costs_few_attempts(spark):
    targets = spark.createDataFrame([(f"d{i}", 0, 0) for i in range(64)], "dataset string, repeat int, fold int")
    lost, tries = [], []

    def save(part):
        tries.append(1)
        raise RuntimeError("always")

    pipeline.isolated(targets, lambda p: p, save, lambda p, e: lost.append(p.count()), most=3)
    assert sum(lost) == 64 and len(tries) < 30
    lost.clear()

    def fail(part):
        raise RuntimeError("plan")

    assert pipeline.isolated(targets, fail, save, lambda p, e: lost.append(p.count())) == 0 and lost == [64]


def test_writers_at_the_same_time(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    kinds = "writer int, n int, attempt int"

    def work(w):
        mine = Store(spark, store.root).table(2, "rows", "key")
        return [mine.append(spark.createDataFrame([(w, k, None)], kinds), kinds) for k in range(4)]

    with ThreadPoolExecutor(4) as pool:
        numbers = [x for y in pool.map(work, range(4)) for x in y]
    assert len(set(numbers)) == 16
    table = store.table(2, "rows", "key")
    before = table.read(kinds)
    assert sorted((r.writer, r.n) for r in before.collect()) == [(w, k) for w in range(4) for k in range(4)]
    table.append(spark.createDataFrame([(9, 9, None)], kinds), kinds)
    assert before.count() == 16 and table.read(kinds).count() == 17  # a reader keeps its snapshot
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: store.write(spark.range(w + 1), 1, "stage", "key"), range(4)))
    whole = store.read(1, "stage", "key")
    assert whole.count() in (1, 2, 3, 4) and [r.id for r in whole.orderBy("id").collect()] == list(range(whole.count()))


def test_a_broken_writer_leaves_no_rows(spark, tmp_path):
    table = Store(spark, f"file://{tmp_path}/store").table(2, "rows", "key")
    with pytest.raises(Exception, match="broken"):
        table.append(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("int").alias("n")), "n int")
    assert table.read("n int").count() == 0 and table.append(spark.range(1).select(F.col("id").cast("int").alias("n")), "n int") == 1 and table.read("n int").count() == 1
