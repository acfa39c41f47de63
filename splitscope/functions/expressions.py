"""Column expressions shared by the operators: missing values, sample moments, ranks, tests, resampling.

NULL is the only missing value inside the engine; NaN and infinities become NULL where data enters (:func:`finite`).  Ratios go
through ``try_divide``, as a zero denominator would end an ANSI job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(None).cast("double")).otherwise(x)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def as_number(field: T.StructField) -> Column:
    """A column as a finite double: numbers and booleans are cast, texts parsed, times counted in microseconds."""
    x = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType,)):
        return finite(F.expr(f"try_cast(`{field.name}` as double)"))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")).cast("double")
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(x).cast("double")
    return finite(x)


def strict_mean(x: Column) -> Column:
    """The mean, NULL as soon as one value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def std_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def sample_skewness(x: Column, constant: float | None = 0.0) -> Column:
    """Bias-corrected skewness; NULL below three values, ``constant`` where all are equal."""
    n = F.count(x).cast("double")
    g = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(x)
    return F.when(n >= 3, F.coalesce(g, F.lit(constant).cast("double")))


def sample_kurtosis(x: Column, constant: float | None = 0.0) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, ``constant`` where all are equal."""
    n = F.count(x).cast("double")
    g = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= 4, F.coalesce(g, F.lit(constant).cast("double")))


def average_rank(value: str, *by: str) -> Column:
    """Rank of ``value`` within the partition ``by``, ties averaged."""
    inside = Window.partitionBy(*by)
    return F.rank().over(inside.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL if one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def two_sided_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation over n pairs: the finite series of Student's t for n - 2 degrees of freedom."""
    nu = (n - 2).cast("int")
    cos2 = F.greatest(F.lit(0.0), 1 - r * r)  # cos(theta) ** 2 with tan(theta) = t / sqrt(nu)
    sin, cos = F.abs(r), F.sqrt(cos2)
    theta = F.asin(F.least(F.lit(1.0), sin))

    def series(start: Column, steps: Column, factor) -> Column:
        zero = F.struct(start.alias("t"), F.lit(0.0).alias("s"))
        step = lambda a, k: F.struct((a["t"] * factor(k) * cos2).alias("t"), (a["s"] + a["t"]).alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps).cast("int")), zero, step, lambda a: a["s"])

    even = 1 - sin * series(F.lit(1.0), nu / 2, lambda k: (2 * k - 1) / (2 * k))
    odd = 1 - 2 / math.pi * (theta + sin * series(cos, (nu - 1) / 2, lambda k: 2 * k / (2 * k + 1)))
    one = 1 - 2 / math.pi * theta
    p = F.when(nu == 1, one).when(nu % 2 == 0, even).otherwise(odd)
    return F.when(nu < 1, None).when(sin >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p))


def with_step_up(df: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p values within ``by``; NULL where p is."""
    w = Window.partitionBy(*by, F.col(p).isNull())
    m = F.count(p).over(w)
    rank = F.row_number().over(w.orderBy(p))
    q = F.min(F.col(p) * F.col("__m") / F.col("__k")).over(Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__m", m).withColumn("__k", rank).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q))).drop("__m", "__k")


def with_step_down(df: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    """Holm adjusted p values within ``by``; NULL where p is."""
    w = Window.partitionBy(*by, F.col(p).isNull())
    q = F.max(F.col(p) * (F.col("__m") - F.col("__k") + 1)).over(w.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.withColumn("__m", F.count(p).over(w)).withColumn("__k", F.row_number().over(w.orderBy(p)))
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q))).drop("__m", "__k")


def one_sided_p(p: Column, r: Column, direction: Column) -> Column:
    """The two-sided p value turned to the expected direction (``positive``, ``negative`` or NULL: left two-sided)."""
    agrees = ((direction == "positive") & (r > 0)) | ((direction == "negative") & (r < 0))
    return F.when(direction.isNull(), p).when(agrees, p / 2).otherwise(1 - p / 2)


def resample_index(n: Column, *key: Column) -> Column:
    """A position from 0 to n - 1, drawn by the hash of the key: the same in every engine that has md5."""
    text = F.concat_ws("|", *(k.cast("string") for k in key))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n.cast("long"))
