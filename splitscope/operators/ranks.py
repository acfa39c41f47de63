"""Rank correlation at scale: feature pairs without a sort for each pair, leave-one-out without copies of the units, and the greedy choice
among redundant features in rounds.

*Pairs.*  Ranks depend on the rows a pair has in common, and those on where each feature is missing.  Features missing in the same units share a
pattern; two patterns meet in a *common set* of units, and each feature is ranked once in every common set of its pattern.  Ranks less their mean are
multiples of a quarter, so their products are added up exactly, in square blocks of features within tasks and over tasks by Spark.

*Leave-one-out.*  Without unit k, the rank of a unit falls by one if k lies below it, by a half if k ties with it.  The sum of rank products
then changes by sums of ranks above k in either order, and by the number of units above k in both.  That number is counted as a merge sort counts: at each
binary digit of the places in one order, units with digit 0 look at those of their block with digit 1 that lie above them in the other order.

*Greedy choice.*  Of each redundant pair the better feature stays, strongest pair first, unless one of both has gone before.  A feature falls with the
first pair whose better feature still stands then; bounds of these times are sharpened in rounds until they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import average_rank
from ..sources.scratch import written

BLOCK = 64  # features of a block
HELD_BLOCKS = 2048  # sums of 8 * BLOCK ** 2 bytes that a task holds before it passes them on
_PRODUCTS = "a_pattern string, a_chunk int, a_slot int, b_pattern string, b_chunk int, b_slot int, sp double"


def _clipped(r: Column) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _signature(unit: str) -> list[Column]:
    """Aggregates that tell sets of units apart: their number and 128 bits of sums of hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(unit).cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), unit).cast("decimal(38,0)")).alias("h2")]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of two blocks of ranks of one unit each, over the units a task meets."""
    held: dict[tuple, np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (p, i, q, j), s in held.items():
            a, b = np.indices(s.shape).reshape(2, -1)
            if (p, i) == (q, j):
                a, b = a[a < b], b[a < b]
            n = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * n, pa.string()), pa.array([i] * n, pa.int32()), pa.array(a, pa.int32()), pa.array([q] * n, pa.string()), pa.array([j] * n, pa.int32()), pa.array(b, pa.int32()), pa.array(s[a, b])],
                names=[c.split()[0] for c in _PRODUCTS.split(", ")],
            )
        held.clear()

    for batch in batches:
        p, i, q, j = (batch.column(k).to_pylist() for k in range(4))
        left, right = batch.column(4), batch.column(5)
        for row, key in enumerate(zip(p, i, q, j, strict=True)):
            product = np.outer(left[row].values.to_numpy(), right[row].values.to_numpy())
            if key in held:
                held[key] += product
            else:
                if len(held) >= HELD_BLOCKS:
                    yield from emit()
                held[key] = product
    yield from emit()


def rank_correlations(long: DataFrame, unit: str = "dataset", min_pairs: int = 3) -> DataFrame:
    """``a, b, n, r``: Spearman correlation of every feature pair a < b over the units where both are present (one row per unit and feature);
    r is NULL where one side is constant there."""
    cells = written(long.where("value is not null").select(F.col(unit).cast("string").alias("u"), "feature", "value"), "cells")
    sets = cells.groupBy("feature").agg(*_signature("u"))
    pattern = F.min("feature").over(W.partitionBy("n", "h1", "h2")).alias("pattern")  # named after its first feature
    named = sets.select("feature", pattern)
    place = F.row_number().over(W.partitionBy("pattern").orderBy("feature")) - 1
    named = written(named.withColumn("place", place).select("feature", "pattern", F.floor(F.col("place") / BLOCK).cast("int").alias("chunk"), (F.col("place") % BLOCK).cast("int").alias("slot")), "patterns")

    # pairs of patterns, the common set of each, and what is ranked in it
    present = cells.join(named.where("feature = pattern").select("feature", "pattern"), "feature").select("pattern", "u")
    met = present.withColumnRenamed("pattern", "p").join(present.withColumnRenamed("pattern", "q"), "u").where("p <= q").groupBy("p", "q").agg(*_signature("u")).where(F.col("n") >= min_pairs)
    met = written(met.withColumn("common", F.min(F.struct("p", "q")).over(W.partitionBy("n", "h1", "h2"))).select("p", "q", "n", "common"), "common")
    inside = met.where("common.p = p and common.q = q")
    units = present.withColumnRenamed("pattern", "p").join(inside.select("p", "q", "common"), "p").join(present.withColumnRenamed("pattern", "q"), ["q", "u"]).select("common", "u")
    ranked = met.select("common", "n", F.explode(F.array_distinct(F.array("p", "q"))).alias("pattern")).distinct()
    rows = cells.join(named, "feature").join(ranked, "pattern").join(units, ["common", "u"])
    rows = rows.withColumn("z", average_rank("value", "common", "feature") - (F.col("n") + 1) / 2)
    rows = written(rows.select("common", "pattern", "chunk", "slot", "u", "z"), "ranks")

    spread = rows.groupBy("common", "pattern", "chunk", "slot").agg(F.sum(F.col("z") * F.col("z")).alias("ss"))
    blocks = rows.groupBy("common", "u", "pattern", "chunk").agg(F.sort_array(F.collect_list(F.struct("slot", "z"))).alias("zs"))  # at most BLOCK
    blocks = blocks.select("common", "u", "pattern", "chunk", F.col("zs.z").alias("zs"))
    side = lambda s, p: blocks.select("common", "u", F.col("pattern").alias(p), F.col("chunk").alias(f"{s}_chunk"), F.col("zs").alias(f"{s}_zs"))
    both = side("a", "p").join(met.select("p", "q", "common"), ["common", "p"]).join(side("b", "q"), ["common", "u", "q"]).where("p < q or a_chunk <= b_chunk")
    sums = both.select("p", "a_chunk", "q", "b_chunk", "a_zs", "b_zs").mapInArrow(_products, _PRODUCTS)
    sums = sums.groupBy("a_pattern", "a_chunk", "a_slot", "b_pattern", "b_chunk", "b_slot").agg(F.sum("sp").alias("sp"))

    out = sums.join(met.select(F.col("p").alias("a_pattern"), F.col("q").alias("b_pattern"), "n", "common"), ["a_pattern", "b_pattern"])
    for s in "ab":
        of = spread.select("common", *(F.col(c).alias(f"{s}_{c}") for c in ("pattern", "chunk", "slot", "ss")))
        name = named.select(F.col("feature").alias(f"{s}_feature"), *(F.col(c).alias(f"{s}_{c}") for c in ("pattern", "chunk", "slot")))
        at = [f"{s}_pattern", f"{s}_chunk", f"{s}_slot"]
        out = out.join(of, ["common", *at]).join(name, at)
    r = F.try_divide(F.col("sp"), F.sqrt("a_ss") * F.sqrt("b_ss"))
    return out.select(F.least("a_feature", "b_feature").alias("a"), F.greatest("a_feature", "b_feature").alias("b"), "n", _clipped(r).alias("r"))


def above_in_both(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (``by, unit, x, y``) with ``above``: the units of the same group that lie above in x and in y; a tie in one counts a half, in both a quarter.

    Every unit is copied once for each binary digit of the group's size."""
    group = W.partitionBy(by)
    placed = rows.withColumn("place", F.rank().over(group.orderBy("x")) - 1).withColumn("size", F.count(F.lit(1)).over(group))
    digits = F.sequence(F.lit(0), F.length(F.bin("size")))  # digit 0 stands for the ties, k for the digit of value 2 ** (k - 1)
    level = placed.withColumn("level", F.explode(digits))
    low = F.expr("shiftright(place, level)")
    high = F.when(F.col("level") == 0, True).otherwise(F.expr("(shiftright(place, level - 1) & 1) = 1"))
    level = level.withColumns({"block": low, "high": high})
    block = W.partitionBy(by, "level", "block")
    one = F.col("high").cast("long")
    upto = F.sum(one).over(block.orderBy("y").rangeBetween(W.unboundedPreceding, W.currentRow))
    tied = F.sum(one).over(W.partitionBy(by, "level", "block", "y"))
    level = level.withColumns({"more": F.sum(one).over(block) - upto, "tied": tied})
    ties = 0.5 * (F.col("more") + 0.5 * (F.col("tied") - 1))  # the unit itself is no tie
    strict = F.when(~F.col("high"), F.col("more") + 0.5 * F.col("tied")).otherwise(0.0)
    return level.groupBy(by, "unit").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum(F.when(F.col("level") == 0, ties).otherwise(strict)).alias("above"))


def leave_one_out(pairs: DataFrame, method: str = "spearman") -> DataFrame:
    """``feature, without, r, rho``: the correlation of the complete ``pairs`` (feature, unit, x, y; one row per unit) without each unit, and with all."""
    whole = W.partitionBy("feature")
    n = F.count(F.lit(1)).over(whole).cast("double")
    if method == "spearman":
        rows = above_in_both(pairs.select("feature", "unit", "x", "y"), "feature").withColumn("n", n)
        for v in "xy":
            tied = F.count(F.lit(1)).over(W.partitionBy("feature", v))
            rows = rows.withColumns({f"t{v}": tied, f"r{v}": average_rank(v, "feature")})
            rows = rows.withColumn(f"cube{v}", F.sum(F.pow(F.col(f"t{v}"), 2) - 1).over(whole))  # sum of t**3 - t over groups of ties
        for v, other in ("xy", "yx"):  # ranks in the other order of the units above, ties half, the unit itself not at all
            rest, tied = F.sum(f"r{other}").over(whole.orderBy(v).rangeBetween(W.unboundedPreceding, W.currentRow)), F.sum(f"r{other}").over(W.partitionBy("feature", v))
            rows = rows.withColumn(f"sum{v}", F.sum(f"r{other}").over(whole) - rest + 0.5 * (tied - F.col(f"r{other}")))
        total, own = F.sum(F.col("rx") * F.col("ry")).over(whole), F.col("rx") * F.col("ry")
        m, t = F.col("n") - 1, lambda v: F.col(f"t{v}").cast("double")
        products = total - own - F.col("sumx") - F.col("sumy") + F.col("above") - m * F.col("n") * F.col("n") / 4
        left = lambda v: (m * m * m - m - (F.col(f"cube{v}") - 3 * t(v) * (t(v) - 1))) / 12  # noqa: E731  a group of t shrinks to t - 1
        r = F.try_divide(products, F.sqrt(F.greatest(F.lit(0.0), left("x"))) * F.sqrt(F.greatest(F.lit(0.0), left("y"))))
        full = lambda v: F.sqrt((F.pow(F.col("n"), 3) - F.col("n") - F.col(f"cube{v}")) / 12)
        rho = F.try_divide(total - F.col("n") * F.pow(F.col("n") + 1, 2) / 4, full("x") * full("y"))
    else:
        rows = pairs.withColumns({"n": n, **{f"d{v}": F.col(v) - F.avg(v).over(whole) for v in "xy"}})
        for v in "xy":
            rows = rows.withColumns({f"t{v}": F.count(F.lit(1)).over(W.partitionBy("feature", v)), f"low{v}": F.min(v).over(whole), f"high{v}": F.max(v).over(whole)})
            rows = rows.withColumn(f"ends{v}", F.sum(F.col(v).isin(F.col(f"low{v}"), F.col(f"high{v}")).cast("long")).over(whole))
        share = F.try_divide(F.col("n"), F.col("n") - 1)
        part = lambda a, b: F.sum(F.col(a) * F.col(b)).over(whole) - share * F.col(a) * F.col(b)
        # one value is left: all are equal, or two values of which this unit alone holds one
        single = lambda v: (F.col(f"low{v}") == F.col(f"high{v}")) | ((F.col(f"ends{v}") == F.col("n")) & (F.col(f"t{v}") == 1))
        r = F.when(~single("x") & ~single("y"), F.try_divide(part("dx", "dy"), F.sqrt(F.greatest(F.lit(0.0), part("dx", "dx"))) * F.sqrt(F.greatest(F.lit(0.0), part("dy", "dy")))))
        flat = (F.col("lowx") == F.col("highx")) | (F.col("lowy") == F.col("highy"))
        rho = F.when(~flat, F.try_divide(F.sum(F.col("dx") * F.col("dy")).over(whole), F.sqrt(F.sum(F.col("dx") * F.col("dx")).over(whole)) * F.sqrt(F.sum(F.col("dy") * F.col("dy")).over(whole))))
    return rows.select("feature", F.col("unit").alias("without"), r.alias("r"), rho.alias("rho")).withColumns({c: _clipped(F.col(c)) for c in ("r", "rho")})


def fallen(pairs: DataFrame) -> DataFrame:
    """``dropped, kept, abs_spearman`` of the greedy choice: ``pairs`` hold ``keep, drop, abs_spearman, a, b``, strongest first, then a, b; which one of a
    pair is kept follows one order of all features.  A round is one join and one aggregation; rounds follow the longest chain of decisions, not the pairs."""
    time = F.struct((-F.col("abs_spearman")).alias("s"), F.col("a"), F.col("b"))
    edges = written(pairs.select("keep", "drop", time.alias("t")), "edges")
    bounds = edges.groupBy("drop").agg(F.min("t").alias("earliest"), F.min(F.when(F.lit(False), F.col("t"))).alias("latest"))
    while True:
        # a pair takes effect if its better feature surely stands at its time, and has none if that surely fell before
        known = bounds.select(F.col("drop").alias("keep"), "earliest", "latest", F.lit(True).alias("falls"))
        seen = edges.join(known, "keep", "left")
        stands = F.col("falls").isNull() | F.col("earliest").isNull() | (F.col("earliest") > F.col("t"))
        gone = F.col("latest").isNotNull() & (F.col("latest") < F.col("t"))
        bounds = written(seen.groupBy("drop").agg(F.min(F.when(~gone, F.col("t"))).alias("earliest"), F.min(F.when(stands, F.col("t"))).alias("latest")), "bounds")
        if bounds.where(~F.col("earliest").eqNullSafe(F.col("latest"))).isEmpty():
            break
    found = bounds.where("latest is not null").select("drop", F.col("latest").alias("t"))
    return found.join(edges, ["drop", "t"]).select(F.col("drop").alias("dropped"), F.col("keep").alias("kept"), (-F.col("t.s")).alias("abs_spearman"))
