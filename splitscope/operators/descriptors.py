"""Split descriptors: size, target, cardinality, missingness, shape and information of a training split.

One row per (split, feature) - the profile - comes from the value counts of a dataset's features; descriptors are aggregates over profiles.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASS_FEATURES, CLASSIFICATION, SPLIT
from ..sources.scratch import written
from ..sources.splits import FoldedRows, SplitRows

HIGH_CARDINALITY = (50, 0.1)
NEAR_CONSTANT = 0.95


RANGES = 64
SEARCH = 8  # steps of the search for a number's range: at most 2 ** SEARCH - 1 borders
QUARTILES = (0.25, 0.5, 0.75)
_CELLS = ["feature", "kind", "num", "cat"]


class Values:
    """How often each value of a feature occurs, in every split at once.

    ``table``: ``unit, feature, kind, num, cat, k``, one row a value (missing ones too); the array ``k`` counts it for each (repeat, fold), or has one
    entry where a unit is a split.  ``weight(s)`` is its count in split s: that of the repeat less that of the split's own fold."""

    def __init__(self, cells: DataFrame, slots: tuple[tuple[int, int], ...] = ()):
        self.unit, self.slots = (["dataset"] if slots else SPLIT), slots
        if slots:
            inside = lambda r, f: F.coalesce(F.get("folds", F.lit(r)) == f, F.lit(False))
            counts = F.array(*(F.count(F.when(inside(r, f), F.lit(1))) for r, f in slots))
        else:
            counts = F.array(F.count(F.lit(1)))
        self.table = cells.groupBy(*self.unit, *_CELLS).agg(counts.alias("k"))
        self.n_splits = max(1, len(slots))

    def stored(self) -> Values:
        """The same with ``table`` in the shared folder: readers of it do not count the rows again."""
        out = copy(self)
        out.table = written(self.table, "values")
        return out

    def others(self, s: int) -> list[int]:
        """The places in ``k`` that add up to split s."""
        return [i for i, (r, f) in enumerate(self.slots) if r == self.slots[s][0] and f != self.slots[s][1]] if self.slots else [0]

    def weight(self, s: int) -> Column:
        return sum((F.col("k")[i] for i in self.others(s)), F.lit(0).cast("long"))

    def weights(self) -> list[Column]:
        return [self.weight(s) for s in range(self.n_splits)]

    def splits_of(self, place: str) -> Column:
        """The splits that a place of ``k`` belongs to."""
        uses = [[s for s in range(self.n_splits) if i in self.others(s)] for i in range(max(1, len(self.slots)))]
        return F.array(*(F.array(*map(F.lit, u)) if u else F.array().cast("array<int>") for u in uses))[F.col(place)]

    def named(self, df: DataFrame) -> DataFrame:
        """``split`` as repeat and fold."""
        if not self.slots:
            return df.drop("split")
        r, f = (F.array(*(F.lit(x[c]) for x in self.slots))[F.col("split")] for c in (0, 1))
        return df.withColumns({"repeat": r, "fold": f}).drop("split")

    def by_split(self) -> DataFrame:
        """``split columns, feature, kind, num, cat, k``: a row for each value and split that has it."""
        long = self.table.select(*self.unit, *_CELLS, F.posexplode(F.array(*self.weights())).alias("split", "k")).where("k > 0")
        return self.named(long)


def value_counts(source: SplitRows | DataFrame) -> DataFrame:
    """``split, feature, kind, num, cat, k``: how often each value of a feature occurs, missing values included (both columns NULL)."""
    return wanted(source, values(source).by_split())


def values(source: SplitRows | DataFrame) -> Values:
    """The value counts of rows, or of cells that name their split."""
    return Values(source) if isinstance(source, DataFrame) else Values(source.cells(), source.slots)


def wanted(source: SplitRows | DataFrame, table: DataFrame) -> DataFrame:
    """``table`` without the splits that nobody asked for."""
    return table.join(source.splits.select(*SPLIT), SPLIT, "left_semi") if isinstance(source, FoldedRows) else table


def _counted(v: Values) -> DataFrame:
    """``unit, feature, kind, split``: rows, values, distinct values, the most frequent one's count; ``d``, ``centre``: distinct numbers and the mean over all."""
    known = F.col("num").isNotNull() | F.col("cat").isNotNull()
    total = sum((F.col("k")[i] for i in range(max(1, len(v.slots)))), F.lit(0).cast("long"))
    at = range(v.n_splits)
    each = lambda f, c: F.array(*(f(F.col(f"{c}{s}")) for s in at))
    rows = v.table.select(*v.unit, "feature", "kind", "num", F.when(F.col("num").isNotNull(), total).alias("all"), known.alias("known"), *(w.alias(f"w{s}") for s, w in enumerate(v.weights())))
    rows = rows.select("*", *(F.when(F.col("known") & (F.col(f"w{s}") > 0), F.col(f"w{s}")).alias(f"v{s}") for s in at))
    return rows.groupBy(*v.unit, "feature", "kind").agg(
        each(F.sum, "w").alias("n_rows"), each(lambda k: F.coalesce(F.sum(k), F.lit(0).cast("long")), "v").alias("n_values"), each(F.count, "v").alias("n_distinct"),
        each(F.max, "v").alias("top"), F.count("num").alias("d"), F.try_divide(F.sum(F.col("all") * F.col("num")), F.sum("all")).alias("centre"),
    )


def _per_split(v: Values, counted: DataFrame) -> DataFrame:
    names = ("n_rows", "n_values", "n_distinct", "top")
    return counted.select(*v.unit, "feature", "kind", F.posexplode(F.arrays_zip(*names)).alias("split", "c")).select(*v.unit, "feature", "kind", "split", *(F.col("c")[n].alias(n) for n in names)).where("n_rows > 0")


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def _borders(v: Values, counted: DataFrame) -> DataFrame:
    """``unit, feature, centre, borders`` of the numeric features: the borders of about ``RANGES`` ranges, none for features with few values.

    They are the values of least hash: every executor that looks finds the same ones, and a feature with many values is spread over many ranges."""
    numeric = counted.where("kind = 'num'").select(*v.unit, "feature", "d", "centre")
    chosen = F.abs(F.xxhash64("num").cast("double")) * F.col("d") < float(2**63) * RANGES
    drawn = v.table.select(*v.unit, "feature", "num").where("num is not null").join(numeric.where(F.col("d") > 4 * RANGES), [*v.unit, "feature"]).where(chosen)
    found = drawn.groupBy(*v.unit, "feature").agg(F.slice(F.sort_array(F.collect_list("num")), 1, 2**SEARCH - 1).alias("borders"))
    return numeric.drop("d").join(found, [*v.unit, "feature"], "left").withColumn("borders", F.coalesce("borders", F.array().cast("array<double>")))


def _ranged(v: Values, counted: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _lazy) -> DataFrame:
    """The numbers with ``part``, the range they lie in: how many borders are at most the number, by halving."""
    borders = keep(_borders(v, counted), "borders")
    out = v.table.select(*v.unit, "feature", "num", "k").where("num is not null").join(borders, [*v.unit, "feature"]).withColumn("part", F.lit(0))
    for step in (2**i for i in reversed(range(SEARCH))):
        upto = F.col("part") + step
        out = out.withColumn("part", F.when(F.get("borders", upto - 1) <= F.col("num"), upto).otherwise(F.col("part")))
    return out.drop("borders")


def _sums(v: Values, ranged: DataFrame) -> DataFrame:
    """``unit, feature, part, split``: count, power sums about the centre, extremes, zeros and the sum of inverses, added up for each place of ``k``
    first and then for the splits that it belongs to.  A number comes once for each repeat, with the counts of its folds beside each other."""
    by, x, z, zz = [*v.unit, "feature", "part"], F.col("num"), F.col("z"), F.col("zz")
    per = len({f for _, f in v.slots}) or 1
    repeats = F.array(*(F.struct(F.lit(i).alias("first"), *(F.col("k")[i + j].alias(f"n{j}") for j in range(per))) for i in range(0, max(1, len(v.slots)), per)))
    rows = ranged.withColumn("z", x - F.col("centre")).select(*by, "num", "centre", "z", (z * z).alias("zz"), F.inline(repeats))

    def own(j: int) -> Column:
        n = F.col(f"n{j}")
        power = [F.sum(n * c).alias(f"s{p}") for p, c in enumerate((z, zz, zz * z, zz * zz), 1)]
        seen = F.when(n > 0, x)
        return F.struct((F.first("first") + j).alias("place"), F.sum(n).alias("n"), *power, F.min(seen).alias("low"), F.max(seen).alias("high"), F.sum(F.when(x == 0, n).otherwise(0)).alias("zeros"), F.sum(F.when((x > 0) & (n > 0), n / x)).alias("inverse"))

    sums = rows.groupBy(*by, "first").agg(F.array(*map(own, range(per))).alias("own"), F.max("centre").alias("centre")).select(*by, "centre", F.inline("own")).where("n > 0")
    return sums.withColumn("split", F.explode(v.splits_of("place"))).groupBy(*by, "split").agg(*_add())


def _add() -> list[Column]:
    return [*(F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4", "zeros", "inverse")), F.min("low").alias("low"), *(F.max(c).alias(c) for c in ("high", "centre"))]


def _quartiles(v: Values, ranged: DataFrame, sums: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``unit, feature, split, q1, mid, q3``: exact order statistics of any number of values.

    Counts of ranges tell in which range each place p (n - 1) lies; running counts are taken inside the ranges that hold one, for all
    splits at once.  No window holds a feature's values."""
    by = Window.partitionBy(*v.unit, "feature", "split")
    upto = by.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = sums.withColumns({"all": F.sum("n").over(by), "after": F.sum("n").over(upto)})
    places = F.array(*(F.struct(F.lit(2 * i + j).alias("which"), f((F.col("all") - 1) * p).cast("long").alias("at")) for i, p in enumerate(QUARTILES) for j, f in enumerate((F.floor, F.ceil))))
    goal = found.withColumn("goal", F.explode(places)).where((F.col("goal.at") < F.col("after")) & (F.col("goal.at") >= F.col("after") - F.col("n")))
    rest = F.struct("split", F.col("goal.which").alias("which"), (F.col("goal.at") - F.col("after") + F.col("n")).alias("rest"), F.col("all").alias("n"))
    goals = keep(goal.groupBy(*v.unit, "feature", "part").agg(F.collect_list(rest).alias("goals")), "goals")  # at most six for each split
    order = Window.partitionBy(*v.unit, "feature", "part").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranged.join(goals, [*v.unit, "feature", "part"]).withColumn("w", F.array(*v.weights())).withColumn("up", F.array(*(F.sum(w).over(order) for w in v.weights())))
    met = lambda g: (F.col("up")[g["split"]] > g["rest"]) & (F.col("up")[g["split"]] - F.col("w")[g["split"]] <= g["rest"])
    hits = near.select(*v.unit, "feature", "num", F.inline(F.filter("goals", met)))
    values = hits.groupBy(*v.unit, "feature", "split").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("which") == i, F.col("num"))).alias(f"v{i}") for i in range(2 * len(QUARTILES))))

    def quartile(i: int, p: float) -> Column:
        place = (F.col("n") - 1) * p
        return F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * (place - F.floor(place))

    names = ("q1", "mid", "q3")
    return values.select(*v.unit, "feature", "split", *(quartile(i, p).alias(c) for i, (p, c) in enumerate(zip(QUARTILES, names, strict=True))))


def _outside(v: Values, quartiles: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``quartiles`` with ``outside``: the values beyond 1.5 quartile ranges from them, NULL where there are none."""
    by, wide = [*v.unit, "feature"], 1.5 * (F.col("q3") - F.col("q1"))
    fence = F.struct((F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))
    fences = quartiles.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("split", fence))).alias("at"))  # one for each split
    side = lambda c: F.array(*(F.try_element_at("at", F.lit(s))[c] for s in range(v.n_splits))).alias(c)
    fences = keep(fences.select(*by, side("low"), side("high")), "fences")
    far = v.table.select(*by, "num", "k").join(fences, by).where((F.col("num") < F.array_max("low")) | (F.col("num") > F.array_min("high")))
    beyond = lambda s, w: F.sum(F.when((F.col("num") < F.col("low")[s]) | (F.col("num") > F.col("high")[s]), w).otherwise(0))
    one = far.groupBy(*by).agg(F.array(*(beyond(s, w) for s, w in enumerate(v.weights()))).alias("out"))
    return quartiles.join(one.select(*by, F.posexplode("out").alias("split", "outside")), [*by, "split"], "left")


def profiles(source: SplitRows | DataFrame, shape: bool = True, v: Values | None = None, keep: Callable[[DataFrame, str], DataFrame] = _lazy) -> DataFrame:
    """One row per split and feature: sizes, distinct values, and with ``shape`` moments, quartiles and extremes of the numbers.

    ``source``: rows, or cells that name their split.  Everything comes from the value counts, which are kept for all splits at once (:class:`Values`), ``v`` if they
    are known.  ``keep``: what becomes of the small tables that the next look at the values starts from; :func:`written` makes each look one scan beside a broadcast."""
    v = values(source) if v is None else v
    counted = keep(_counted(v), "counted") if shape else _counted(v)
    one = _per_split(v, counted)
    missing = (1 - F.col("n_values") / F.col("n_rows")).alias("missing")
    plain = ["n_rows", "n_values", "n_distinct", "top"]
    if not shape:
        return wanted(source, v.named(one).select(*SPLIT, "feature", "kind", *plain, missing))
    ranged = _ranged(v, counted, keep)
    sums = keep(_sums(v, ranged), "sums")
    outside = _outside(v, keep(_quartiles(v, ranged, sums, keep), "quartiles"), keep)
    by = [*v.unit, "feature", "split"]
    total = sums.groupBy(*by).agg(*_add())
    n, d = F.col("n").cast("double"), F.try_divide(F.col("s1"), F.col("n"))
    flat = F.col("low") == F.col("high")
    s2, s3, s4 = (F.col(f"s{p}") for p in (2, 3, 4))
    central = {"m2": s2 - n * d * d, "m3": s3 - 3 * d * s2 + 2 * n * d * d * d, "m4": s4 - 4 * d * s3 + 6 * d * d * s2 - 3 * n * d * d * d * d}
    moved = total.withColumns({c: F.when(flat, F.lit(0.0)).otherwise(F.greatest(m, F.lit(0.0)) if c != "m3" else m) for c, m in central.items()} | {"mean": F.when(flat, F.col("low")).otherwise(F.col("centre") + d)})
    m2 = F.col("m2")
    skew = F.when(flat, F.lit(0.0)).otherwise(F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.try_divide(F.col("m3") * F.sqrt(n), F.pow(m2, 1.5)))
    kurt = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * (F.try_divide(F.col("m4") * n, m2 * m2) - 3) + 6))
    numbers = moved.select(
        *by, F.when(n >= 3, skew).alias("skew"), F.when(n >= 4, kurt).alias("kurt"), F.when(n >= 2, F.sqrt(m2 / (n - 1))).alias("std"), F.sqrt(m2 / n).alias("std_pop"), "mean", "low", "high", "zeros",
        F.when(F.col("low") > 0, F.col("n") / F.col("inverse")).alias("hmean"),
    )
    out = one.join(numbers, by, "left").join(outside, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted(source, v.named(out).select(*SPLIT, "feature", "kind", *plain, missing, "skew", "kurt", "std", "std_pop", "mean", "low", "high", zero("zeros"), "q1", "mid", "q3", "hmean", zero("outside")))


def stored_profiles(source: SplitRows | DataFrame, shape: bool = True, v: Values | None = None) -> DataFrame:
    """:func:`profiles` as a table in the shared folder.  With ``shape`` the value counts are written first, as a profile reads them many times:
    rows are counted once, whatever reads the profile."""
    if not shape:
        return written(profiles(source, shape, v), "profile")
    return written(profiles(source, shape, values(source).stored() if v is None else v, keep=written), "profile")


def presence(sr: SplitRows) -> DataFrame:
    """The columns of :func:`profiles` that need no values: rows, values and the share of missing ones.  One shuffle of partial counts."""
    one = sr.cells().groupBy(*sr.key, "feature", "kind").agg(F.count(F.lit(1)).alias("n_rows"), (F.count("num") + F.count("cat")).alias("n_values"))
    one = sr.to_splits(one).groupBy(*SPLIT, "feature", "kind").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))
    return one.withColumn("missing", 1 - F.col("n_values") / F.col("n_rows"))


def _num(x: Column) -> Column:
    return F.when(F.col("kind") == "num", x)


def _cat(x: Column) -> Column:
    return F.when(F.col("kind") == "cat", x)


def split_rows(sr: SplitRows) -> DataFrame:
    """``n`` and the share of rows with a missing value."""
    gone = F.count_if(sr.any_missing()) if sr.features else F.lit(None).cast("long")
    parts = sr.rows.groupBy(*sr.key).agg(F.count(F.lit(1)).alias("n"), gone.alias("gone"))
    return sr.to_splits(parts).groupBy(*SPLIT).agg(F.sum("n").alias("n"), (F.sum("gone") / F.sum("n")).alias("row_missing_fraction"))


def of_profile(profile: DataFrame) -> DataFrame:
    """Every descriptor that is an aggregate over the features of a split, in one aggregation: all of them from :func:`profiles`,
    without the shape ones where that has none, sizes and missingness from :func:`presence`."""
    counts = (F.count(F.lit(1)).alias("d"), F.count(_num(F.lit(1))).alias("n_num_features"), F.count(_cat(F.lit(1))).alias("n_cat_features"), F.avg("missing").alias("missing_fraction"))
    gone = (F.avg((F.col("missing") > 0).cast("double")).alias("feature_missing_fraction"), F.avg(_num(F.col("missing"))).alias("num_missing_fraction"), F.avg(_cat(F.col("missing"))).alias("cat_missing_fraction"), F.max("missing").alias("max_feature_missing_fraction"))
    if "n_distinct" not in profile.columns:
        return profile.groupBy(*SPLIT).agg(*counts, *gone)
    k, s = _cat(F.col("n_distinct")), F.abs(_num(F.col("skew")))
    least, share = HIGH_CARDINALITY
    high = _cat((F.col("n_distinct") >= F.greatest(F.lit(float(least)), share * F.col("n_rows"))).cast("double"))
    constant = F.col("n_distinct") <= 1
    near = constant | (F.try_divide(F.col("top"), F.col("n_values")) >= NEAR_CONSTANT)
    found = [
        F.avg(k).alias("mean_cat_cardinality"), F.max(k).cast("double").alias("max_cat_cardinality"), F.avg(high).alias("high_cardinality_fraction"),
        F.avg(constant.cast("double")).alias("constant_feature_fraction"), F.avg(F.coalesce(near, F.lit(False)).cast("double")).alias("near_constant_feature_fraction"),
    ]
    if "skew" in profile.columns:
        share_of = lambda c: F.try_divide(F.sum(_num(F.col(c))), F.nullif(F.sum(_num(F.col("n_values"))), F.lit(0)))
        found += [
            F.avg(s).alias("mean_abs_skew"), F.max(s).alias("max_abs_skew"), F.avg(_num(F.col("kurt"))).alias("mean_kurtosis"),
            share_of("outside").alias("outlier_fraction_iqr"), share_of("zeros").alias("zero_fraction"),
        ]
    return profile.groupBy(*SPLIT).agg(*counts, *gone, *found)


def size(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counts, logarithms, ratios and composition.  ``found``: see :func:`of_profile`."""
    out = rows.select(*SPLIT, "n").join(found.select(*SPLIT, "d", "n_num_features", "n_cat_features", "missing_fraction"), SPLIT, "left")
    return _ratios(out)


def _ratios(table: DataFrame) -> DataFrame:
    out = table.fillna(0, ["d", "n_num_features", "n_cat_features"])
    n, d = F.col("n"), F.col("d")
    log = lambda x: F.when(x > 0, F.log10(x))
    return out.withColumns({"log_n": log(n), "log_d": log(d), "n_over_d": F.try_divide(n, d), "d_over_n": F.try_divide(d, n), "num_fraction": F.try_divide(F.col("n_num_features"), d), "cat_fraction": F.try_divide(F.col("n_cat_features"), d)})


def class_label(sr: SplitRows) -> Column | None:
    """The class of a row where the problem is a classification, else NULL; None without a target."""
    if sr.target is None or sr.problem_type is None:
        return None
    return F.when(F.lower(F.col(f"`{sr.problem_type}`")).isin(*CLASSIFICATION), F.col(f"`{sr.target}`").cast("string"))


def target(sr: SplitRows) -> DataFrame:
    """Class descriptors; NULL unless the problem is a classification."""
    known = class_label(sr)
    if known is None:
        return sr.keys().drop("kind").withColumns({c: F.lit(None).cast("long" if c == "n_classes" else "double") for c in CLASS_FEATURES})
    return rows_and_target(sr).select(*SPLIT, *CLASS_FEATURES)


def rows_and_target(sr: SplitRows) -> DataFrame:
    """:func:`split_rows` and :func:`target` by one look at the rows: counts by class, and of rows without one."""
    known = class_label(sr)
    gone = F.count_if(sr.any_missing()) if sr.features else F.lit(None).cast("long")
    parts = sr.rows.withColumn("__y", F.lit(None).cast("string") if known is None else known).groupBy(*sr.key, "__y").agg(F.count(F.lit(1)).alias("rows"), gone.alias("gone"))
    counts = sr.to_splits(parts).groupBy(*SPLIT, "__y").agg(F.sum("rows").alias("rows"), F.sum("gone").alias("gone"))
    # entropy from counts: log2(N) - sum(k log2 k) / N needs no second pass over the classes
    k = F.when(F.col("__y").isNotNull(), F.col("rows"))
    out = counts.groupBy(*SPLIT).agg(
        F.sum("rows").alias("n"), (F.sum("gone") / F.sum("rows")).alias("row_missing_fraction"),
        F.count(k).alias("classes"), F.sum(k).alias("all"), F.sum(k * F.log2(k)).alias("s"), F.max(k).alias("most"), F.min(k).alias("least"),
    )
    n = F.col("all")
    some = lambda x: F.when(n > 0, x)
    return out.select(
        *SPLIT, "n", "row_missing_fraction", some(F.col("classes")).alias("n_classes"), some(F.log2(n) - F.try_divide(F.col("s"), n)).alias("class_entropy"), some(F.try_divide(F.col("most"), n)).alias("majority_class_fraction"),
        some(F.try_divide(F.col("least"), n)).alias("minority_class_fraction"), some(F.try_divide(F.col("most"), F.col("least"))).alias("class_imbalance_ratio"),
    )


def basic(sr: SplitRows, profile: DataFrame | None = None) -> DataFrame:
    """All basic descriptors of each split: partials of the cells, and of the rows by class."""
    profile = profiles(sr) if profile is None else profile
    out = _ratios(rows_and_target(sr).join(of_profile(profile), SPLIT, "left"))
    return out.withColumn("cat_cardinality_to_n_ratio", F.try_divide(F.col("mean_cat_cardinality"), F.col("n")))
