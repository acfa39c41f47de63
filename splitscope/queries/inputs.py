"""Benchmark-like inputs derived from the driver's tables: results, training splits, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Analysis, Comparison, Family
from ..sources.results import select_results
from ..sources.splits import FoldedRows, SplitRows, folded_rows

LEFT = Family("left", frozenset({"c0", "c1"}), "left family")
RIGHT = Family("right", frozenset({"c2", "c3"}), "right family")
SOLO = Family("solo", frozenset({"c3", "c9"}), "one type, and one that no result has")
FAMILIES = {f.name: f for f in (LEFT, RIGHT, SOLO)}
COMPARISONS = (Comparison("left_vs_right", LEFT, RIGHT), Comparison("left_vs_solo", LEFT, SOLO, "positive"))
ANALYSIS = Analysis(method_variant=("default", "tuned"))
FEATURES = ["quantity", "price", "discount", "tax", "linestatus", "brand"]
MAIN = "left_vs_right"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sold(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_partkey", *columns).join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("dataset", F.concat(F.lit("d"), F.col("p_size").cast("string")))


def raw_results(spark: SparkSession, sf_dir: str, impute_below: int = 5) -> DataFrame:
    """Errors are exact ratios of whole cents, so engines agree to the last bit."""
    rows = _sold(spark, sf_dir, "l_orderkey", "l_suppkey", "l_discount", "l_tax")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    m = F.col("m")
    g = rows.groupBy("dataset", (F.col("l_orderkey") % 9).cast("int").alias("fold"), (F.col("l_suppkey") % 12).alias("m")).agg(F.count(F.lit(1)).alias("k"), cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    return g.select(
        "dataset", "fold", F.concat(F.lit("m"), m.cast("string")).alias("method"), F.concat(F.lit("c"), (m % 4).cast("string")).alias("config_type"),
        F.when(m % 3 == 0, "default").when(m % 3 == 1, "tuned").otherwise("tuned_ensemble").alias("method_subtype"),
        (F.col("d") / F.col("k")).alias("metric_error"), (F.col("t") / F.col("k")).alias("metric_error_val"), (F.col("k") < impute_below).alias("imputed"),
    )


def results(spark: SparkSession, sf_dir: str, impute_below: int = 5) -> DataFrame:
    return select_results(raw_results(spark, sf_dir, impute_below), ANALYSIS)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part").select("p_size").distinct()
    kind = F.when(F.col("p_size") % 3 == 0, "multiclass").when(F.col("p_size") % 3 == 1, "binary").otherwise("regression")
    return size.select(F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("dataset"), F.col("p_size").cast("long").alias("tid"), kind.alias("problem_type"), F.lit(3).alias("n_repeats"), F.lit(3).alias("n_folds"))


def train_splits(spark: SparkSession, sf_dir: str) -> FoldedRows:
    """A row trains every split whose fold differs from its own; repeats cut the folds anew."""
    from ..sources.metadata import splits_of

    rows = _sold(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = rows.select(
        "dataset", "l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"), F.when(F.col("l_linenumber") != 7, F.col("p_brand")).alias("brand"), F.col("l_returnflag").alias("y"),
    )
    folds = [F.pmod(F.floor(F.col("l_orderkey") / 3**r).cast("long"), F.lit(3)) for r in range(3)]
    return folded_rows(rows, splits_of(metadata(spark, sf_dir)).drop("tid"), folds, 3, FEATURES, "y")


def wide_splits(spark: SparkSession, sf_dir: str) -> SplitRows:
    """Embeddings as 64 numeric columns; every vector trains both splits but its own."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("wide").alias("dataset"), F.lit(0).alias("repeat"), F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "vec_id", "embedding", F.col("label").alias("y"))
    rows = rows.where(F.col("vec_id") % 2 != F.col("fold"))
    names = [f"e{k}" for k in range(64)]
    return SplitRows(rows.select("dataset", "repeat", "fold", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)), "y"), names, "y")
