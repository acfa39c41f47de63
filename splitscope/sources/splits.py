"""Training splits: rows of feature columns with the split they train or the folds they lie in, and their long form, the cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_number
from ..schemas import SPLIT


def feature_kinds(schema: T.StructType, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features: texts and booleans are categories, all else is a number."""
    cat = [f for f in features if isinstance(schema[f].dataType, (T.StringType, T.BooleanType, T.BinaryType))]
    return [f for f in features if f not in cat], cat


@dataclass
class SplitRows:
    """Rows of training splits: the key columns, features, and optionally target and problem type.

    Operators add up partials by ``key`` and then ask :meth:`to_splits` for the partials of each split, so they work alike on rows that name
    their split and on :class:`FoldedRows`."""

    rows: DataFrame
    features: list[str]
    target: str | None = None
    problem_type: str | None = None

    #: Columns that partials are grouped by, and the pairs of (repeat, fold) that a value's counts are kept for; none: the key is the split.
    key = SPLIT
    slots: tuple[tuple[int, int], ...] = ()

    @property
    def numeric(self) -> list[str]:
        return feature_kinds(self.rows.schema, self.features)[0]

    @property
    def categorical(self) -> list[str]:
        return feature_kinds(self.rows.schema, self.features)[1]

    def to_splits(self, partials: DataFrame) -> DataFrame:
        """The partials of each split: those that name it."""
        return partials

    def keys(self) -> DataFrame:
        """``dataset, repeat, fold, kind``: the splits that have rows, with their problem type."""
        kind = F.min(F.col(f"`{self.problem_type}`").cast("string")) if self.problem_type else F.lit(None).cast("string")
        parts = self.rows.groupBy(*self.key).agg(kind.alias("kind"))
        return self.to_splits(parts).groupBy(*SPLIT).agg(F.min("kind").alias("kind"))

    def only(self, splits: DataFrame) -> SplitRows:
        """These splits alone."""
        return replace(self, rows=self.rows.join(splits.select(*SPLIT), SPLIT, "left_semi"))

    def within(self, datasets: DataFrame) -> SplitRows:
        return replace(self, rows=self.rows.join(datasets.select("dataset"), "dataset", "left_semi"))

    def expanded(self) -> SplitRows:
        """Every row once for each split that it trains."""
        return self

    def numbers(self) -> DataFrame:
        """Keys and numeric features as finite doubles."""
        return self.rows.select(*self.key, *(as_number(self.rows.schema[f]).alias(f) for f in self.numeric))

    def cells(self) -> DataFrame:
        """``key, feature, kind, num, cat``: one row per row and feature, by one expansion of the rows."""
        numeric = set(self.numeric)
        cell = lambda f: F.struct(
            F.lit(f).alias("feature"), F.lit("num" if f in numeric else "cat").alias("kind"),
            (as_number(self.rows.schema[f]) if f in numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if f in numeric else F.col(f"`{f}`").cast("string")).alias("cat"),
        )
        if not self.features:
            empty = {"feature": F.lit(""), "kind": F.lit("num"), "num": F.lit(None).cast("double"), "cat": F.lit(None).cast("string")}
            return self.rows.select(*self.key, *(c.alias(n) for n, c in empty.items())).where("false")
        return self.rows.select(*self.key, F.inline(F.array(*map(cell, self.features))))

    def any_missing(self) -> Column:
        out = F.lit(False)
        numeric = set(self.numeric)
        for f in self.features:
            out = out | (as_number(self.rows.schema[f]) if f in numeric else F.col(f"`{f}`")).isNull()
        return out


@dataclass
class FoldedRows(SplitRows):
    """Rows once each, with the fold that every repeat gives them: ``folds``, an array by repeat (NULL: the row takes no part in it).

    A split trains on all rows of its repeat outside its own fold.  Partials are added up by (dataset, folds), of which there are few, and every
    split takes the partials of the other folds: counts are totals less the own fold, moments are merged.  No row is copied for a split."""

    splits: DataFrame | None = None
    n_repeats: int = 1
    n_folds: int = 1

    key = ["dataset", "folds"]  # noqa: RUF012

    def __post_init__(self):
        self.slots = tuple((r, f) for r in range(self.n_repeats) for f in range(self.n_folds))

    def to_splits(self, partials: DataFrame) -> DataFrame:
        own = F.get("folds", F.col("repeat"))
        return partials.join(self.splits.select(*SPLIT), "dataset").where(own != F.col("fold")).drop("folds")

    def only(self, splits: DataFrame) -> FoldedRows:
        wanted = self.splits.join(splits.select(*SPLIT), SPLIT, "left_semi")
        return replace(self, rows=self.rows.join(wanted.select("dataset"), "dataset", "left_semi"), splits=wanted)

    def expanded(self) -> SplitRows:
        return SplitRows(self.to_splits(self.rows), self.features, self.target, self.problem_type)


def folded_rows(table: DataFrame, splits: DataFrame, folds: list[Column], n_folds: int, features: list[str], target: str | None = None, problem_type: str | None = "problem_type") -> FoldedRows:
    """``folds``: the fold of a row in each repeat.  ``splits`` has one row per dataset, repeat and fold (a small table), and the problem type of
    its dataset if there is one."""
    rows = table.withColumn("folds", F.array(*(f.cast("int") for f in folds)))
    if problem_type in splits.columns and problem_type not in table.columns:
        rows = rows.join(splits.groupBy("dataset").agg(F.min(problem_type).alias(problem_type)), "dataset")
    else:
        rows = rows.join(splits.select("dataset").distinct(), "dataset", "left_semi")
    return FoldedRows(rows, features, target, problem_type if problem_type in rows.columns else None, splits=splits, n_repeats=len(folds), n_folds=n_folds)


def training_rows(table: DataFrame, splits: DataFrame, trains: Column, features: list[str], target: str | None = None, problem_type: str | None = "problem_type") -> SplitRows:
    """Every row of a dataset in each split that trains on it.  ``splits`` has one row per dataset, repeat and fold (a small table);
    ``trains`` says whether a row belongs to the split."""
    rows = table.join(splits, "dataset").where(trains)
    return SplitRows(rows, features, target, problem_type if problem_type in rows.columns else None)


def assigned_rows(table: DataFrame, assignment: DataFrame, row_id: str, features: list[str], target: str | None = None, problem_type: str | None = "problem_type") -> SplitRows:
    """Rows by an explicit table ``dataset, repeat, fold, row id`` of training rows, each at most once in a split."""
    twice = repeated_samples(assignment, row_id).limit(3).collect()
    if twice:
        raise ValueError(f"rows are named several times in a split, such as {[tuple(r)[:4] for r in twice]}")
    rows = table.join(assignment, ["dataset", row_id])
    return SplitRows(rows, features, target, problem_type if problem_type in rows.columns else None)


def repeated_samples(assignment: DataFrame, row_id: str) -> DataFrame:
    """Keys of assignments that name a row twice in a split: empty for valid splits."""
    return assignment.groupBy(*SPLIT, row_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
