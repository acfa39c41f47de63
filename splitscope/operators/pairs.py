"""Cross products of the numeric features of a split, summed over partitions.

A task adds the moments of every feature pair (over rows where both are present) unit by unit - a split, or the rows of a dataset with the same folds -,
emits each once (or more often, where their matrices outgrow ``HELD_BYTES``), and Spark merges these parts, for folds into every split that
trains on them: no row is copied, and a split of any number of rows is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_number
from ..schemas import SPLIT
from ..sources.splits import FoldedRows, SplitRows

MAX_FEATURES = 512
HELD_BYTES = 64 << 20
FEW = 16  # columns up to which the units of a batch are added up together
BATCH = 65_536  # pairs handed on at a time
_OUT = "dataset string, at long, fold long, y string, whole boolean, i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"


class Moments:
    """Sums over the rows of several units, about a fixed centre near the data of each so that nothing is lost to cancellation."""

    def __init__(self, p: int):
        self.p, self.at = p, {}
        self.centre, self.sums = np.zeros((0, p)), np.zeros((0, 4, p, p))

    def add(self, keys: list[tuple], starts: np.ndarray, x: np.ndarray) -> None:
        """``x``: rows ordered by unit; ``keys``, ``starts``: the units and where their rows begin."""
        sizes = np.diff(np.append(starts, len(x)))
        unit = np.array([self.at.setdefault(k, len(self.at)) for k in keys])
        if len(self.at) > len(self.centre):
            more = max(len(self.at), 2 * len(self.centre)) - len(self.centre)
            self.centre, self.sums = np.concatenate((self.centre, np.full((more, self.p), np.nan))), np.concatenate((self.sums, np.zeros((more, 4, self.p, self.p))))
        seen = ~np.isnan(x)
        count = np.add.reduceat(seen.astype(float), starts)
        mean = np.add.reduceat(np.where(seen, x, 0), starts) / np.where(count > 0, count, np.nan)
        self.centre[unit] = np.where(np.isnan(self.centre[unit]), mean, self.centre[unit])  # the first values that a unit shows of a column
        z, w = np.where(seen, x - np.repeat(self.centre[unit], sizes, axis=0), 0.0), seen.astype(float)
        sides = ((w, w), (z, w), (z * z, w), (z, z))
        if self.p <= FEW:  # many units of few rows: column by column for all units at once
            for k in range(self.p):
                for m, (left, right) in enumerate(sides):
                    self.sums[unit, m, k] += np.add.reduceat(left[:, k : k + 1] * right, starts)
        else:
            for u, a, b in zip(unit.tolist(), starts.tolist(), (starts + sizes).tolist(), strict=True):
                for m, (left, right) in enumerate(sides):
                    self.sums[u, m] += left[a:b].T @ right[a:b]

    def pairs(self, a: int, b: int) -> list[np.ndarray]:
        """``i, j, n, mean i, mean j, sum of squares i, j, and of products`` for all i <= j of units a to b, unit by unit."""
        i, j = np.triu_indices(self.p)
        n, s, q, c = (self.sums[a:b, m] for m in range(4))
        k, turned, centre = np.maximum(n, 1), s.transpose(0, 2, 1), np.nan_to_num(self.centre[a:b])
        cxx, cxy, mean = q - s * s / k, c - s * turned / k, s / k
        parts = (n[:, i, j], centre[:, i] + mean[:, i, j], centre[:, j] + mean[:, j, i], cxx[:, i, j], cxx[:, j, i], cxy[:, i, j])
        return [np.tile(i, b - a), np.tile(j, b - a), *(v.ravel() for v in parts)]


def moments(sr: SplitRows, whole: bool = False, by: Column | None = None) -> DataFrame:
    """``split, a, b, n, mean_a, mean_b, ss_a, ss_b, sp`` per split and pair a <= b of numeric features; with ``whole`` over rows without any
    missing number; with ``by`` for each of its values, which are then in ``y``."""
    names = sr.numeric
    spark = sr.rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(names)
        held = Moments(p)
        most = max(1, HELD_BYTES // (32 * max(1, p) ** 2))

        def emit() -> Iterator[pa.RecordBatch]:
            labels, size = list(held.at), p * (p + 1) // 2
            step = max(1, BATCH // max(1, size))
            for a in range(0, len(labels), step):
                part = labels[a : a + step]
                of = np.repeat(np.arange(len(part)), size)
                dataset, at, fold, y = (pa.array([u[k] for u in part], kind).take(pa.array(of)) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string())))
                got = held.pairs(a, a + len(part))
                yield pa.RecordBatch.from_arrays([dataset, at, fold, y, pa.array([whole] * len(of)), pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), *map(pa.array, got[2:])], names=[c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            x = np.column_stack([batch.column(4 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(p)])
            if whole:
                batch, x = batch.filter(pa.array(~np.isnan(x).any(1))), x[~np.isnan(x).any(1)]
            if not len(x):
                continue
            # rows of a batch, split by split
            coded = [batch.column(k).dictionary_encode() for k in (0, 3)]
            labels = [[*c.dictionary.to_pylist(), None] for c in coded]
            first, last = (c.indices.fill_null(len(v) - 1).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in zip(coded, labels, strict=True))
            rest = [batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
            order = np.lexsort((last, rest[1], rest[0], first))
            key, x = np.stack((first, *rest, last))[:, order], x[order]
            edge = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
            units = [(labels[0][a], b, c, labels[1][d]) for a, b, c, d in key[:, edge].T.tolist()]
            ends = np.append(edge, len(x))
            for k in range(0, len(edge), most):
                if len(held.at) + sum(u not in held.at for u in units[k : k + most]) > most:
                    yield from emit()
                    held = Moments(p)
                stop = min(k + most, len(edge))
                held.add(units[k:stop], edge[k:stop] - edge[k], x[edge[k] : ends[stop]])
        yield from emit()

    folded = isinstance(sr, FoldedRows)
    base = sr.n_folds + 1 if folded else 0
    if folded:  # the folds of all repeats as one number
        at = sum((F.coalesce(F.get("folds", F.lit(r)), F.lit(sr.n_folds)).cast("long") * base**r for r in range(sr.n_repeats)), F.lit(0).cast("long"))
        unit = (at.alias("at"), F.lit(0).cast("long").alias("fold"))
    else:
        unit = (F.col("repeat").cast("long").alias("at"), F.col("fold").cast("long").alias("fold"))
    group = ["y"] if by is not None else []
    numbers = sr.rows.select(F.col("dataset").cast("string"), *unit, (by if group else F.lit(None).cast("string")).alias("y"), *(as_number(sr.rows.schema[f]).alias(f"x{k}") for k, f in enumerate(names)))
    total = _added(numbers.mapInArrow(run, _OUT), "dataset", "at", "fold", *group)
    if folded:
        digit = lambda c: F.floor(F.col("at") / F.pow(F.lit(base), c)).cast("long") % base
        each = total.drop("fold").join(sr.splits.select(*SPLIT), "dataset").where((digit(F.col("repeat")) != F.col("fold")) & (digit(F.col("repeat")) < sr.n_folds))
        total = _added(each, *SPLIT, *group)
    else:
        total = total.withColumns({"repeat": F.col("at").cast("int"), "fold": F.col("fold").cast("int")})
    done = total.select(*SPLIT, *group, "i", "j", "n", F.col("mx").alias("mean_a"), F.col("my").alias("mean_b"), F.col("cxx").alias("ss_a"), F.col("cyy").alias("ss_b"), F.col("cxy").alias("sp"))
    name = F.create_map(*(x for k, f in enumerate(names) for x in (F.lit(k), F.lit(f)))) if names else F.create_map(F.lit(0), F.lit(""))
    kinds = "dataset string, repeat int, fold int, " + "y string, " * bool(group) + "n double, mean_a double, mean_b double, ss_a double, ss_b double, sp double, a string, b string"
    return done.withColumns({"a": name[F.col("i")], "b": name[F.col("j")]}).drop("i", "j") if names else spark.createDataFrame([], kinds)


def _added(parts: DataFrame, *by: str) -> DataFrame:
    """Moments of the parts of each group, merged: deviations are taken from the group's means, so large means cost no digits."""
    group = Window.partitionBy(*by, "i", "j")
    n = F.col("n")
    mean = lambda c: F.try_divide(F.sum(n * F.col(c)).over(group), F.sum(n).over(group))
    rows = parts.withColumns({"ax": mean("mx"), "ay": mean("my")})
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    return rows.groupBy(*by, "i", "j").agg(
        F.sum(n).alias("n"), F.max("ax").alias("mx"), F.max("ay").alias("my"),
        F.sum(F.col("cxx") + n * dx * dx).alias("cxx"), F.sum(F.col("cyy") + n * dy * dy).alias("cyy"), F.sum(F.col("cxy") + n * dx * dy).alias("cxy"),
    )


def correlations(sr: SplitRows, varying: DataFrame) -> DataFrame:
    """``split, a, b, n, r`` of the pairs a < b of varying numeric features (``varying``: split, feature); r is NULL where one side is constant
    over the common rows."""
    floor = lambda m: 1e-14 * F.col("n") * F.col(m) * F.col(m)  # noqa: E731  what adding blocks may leave of a constant
    ok = (F.col("ss_a") > floor("mean_a")) & (F.col("ss_b") > floor("mean_b")) & (F.col("n") > 1)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("sp"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss_a"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("ss_b"))))))
    out = moments(sr).where("a <> b")
    for side in "ab":
        out = out.join(varying.select(*SPLIT, F.col("feature").alias(side)), [*SPLIT, side], "left_semi")
    return out.select(*SPLIT, "a", "b", "n", F.when(ok, r).alias("r"))
