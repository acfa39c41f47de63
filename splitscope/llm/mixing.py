"""Operator 8 - temperature mixing of sources, with DataFrame functions only.

With token shares ``p`` of the sources, weights are ``p ** a / sum(p ** a)``: a = 1 keeps the shares, a = 0 makes sources equal.
The exponent is bisected: the weights' entropy falls and the largest repetition of a source falls as ``a`` rises, so the
result is the largest ``a`` that reaches the target entropy, raised until no source is repeated more often than allowed.
One aggregation over the sources evaluates the 31 midpoints of five bisection steps, so six of them give 30 steps.

The weights are realised by *budgeted block permutations*: each source's documents fall into blocks by a hash; in every
epoch blocks come in an order of their own, and documents within blocks too; whole epochs are taken as long as the
source's token budget lasts, and the last one is cut at the document that would exceed it.  Prefix sums run over the blocks
of a source (at most ``MAX_BLOCKS``) and within blocks, so a source that holds most rows is never one task's work.

``position`` is a document's place in its source's stream as a share of the budget: the sources merged by position have
the target weights in every stretch.

Defined results: null texts have no tokens; null and empty sources are one source; a source without tokens has weight 0
and is left out; documents without tokens in other sources are taken with their block; repeated rows are taken each; ids may be null; documents of one
source that tie in the order of a block (equal ids) are ordered by their tokens; a budget that needs more than ``max_repeats`` of every token is
an error; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_DOCS = 1024
MAX_BLOCKS = 4096
_STEPS = 6
_GRID = 32


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_tokens(sized: DataFrame) -> DataFrame:
    """``source, docs, tokens`` (partial sums first, so a hot source is no problem)."""
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def _measures(sources: DataFrame, total: int, budget: int | None, grid: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights and largest repetition for each exponent."""
    p = F.log(F.col("tokens") / F.lit(float(total)))
    x = F.exp(F.col("a") * p)
    rows = sources.withColumn("a", F.explode(F.array(*map(F.lit, grid))))
    found = {r["a"]: r for r in rows.groupBy("a").agg(F.sum(x).alias("z"), F.sum(x * F.col("a") * p).alias("e"), F.max(x / F.col("tokens")).alias("m"), F.max(F.col("tokens") / x).alias("c")).collect()}
    out = []
    for r in map(found.get, grid):
        tokens = budget if budget is not None else r["c"] * r["z"]  # covers every source once
        out.append((math.log(r["z"]) - r["e"] / r["z"], r["m"] / r["z"] * tokens))
    return out


def find_exponent(sources: DataFrame, total: int, budget: int | None, entropy_gain: float, max_repeats: float) -> float:
    """The exponent in [0, 1].  ``entropy_gain``: how far the entropy goes from that of the shares (0) to the largest (1)."""
    natural, largest = (x[0] for x in _measures(sources, total, budget, [1.0, 0.0]))
    target = natural + entropy_gain * (largest - natural)

    def bisect(holds) -> tuple[float, float]:
        """Where ``holds`` turns from its value at 0 to that at 1."""
        lo, hi = 0.0, 1.0
        for _ in range(_STEPS):
            grid = [lo + (hi - lo) * k / _GRID for k in range(1, _GRID)]
            first = next((k for k, x in enumerate(_measures(sources, total, budget, grid), 1) if not holds(x)), _GRID)
            lo, hi = lo + (hi - lo) * (first - 1) / _GRID, lo + (hi - lo) * first / _GRID
        return lo, hi

    a = bisect(lambda x: x[0] >= target)[0]  # entropy is high enough up to here
    b = bisect(lambda x: x[1] > max_repeats)[1]  # repetition is low enough from here
    return math.ceil(max(a, b) * 1e6 - 1e-3) / 1e6


def _order(*parts) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, entropy_gain: float = 0.5, max_repeats: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, epoch, block, n_tokens, weight, position``: one row for each time a document is taken.

    ``budget`` is the number of tokens to realise; None takes the least with which every document comes once."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), count_words(F.col(text).cast("string")).alias("n_tokens")), "mix-docs")
    sources = cut(source_tokens(sized).where("tokens > 0"), "mix-sources")
    total, n_sources = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    kinds = "doc_id " + docs.schema[doc_id].dataType.simpleString() + ", source string, epoch int, block long, n_tokens long, weight double, position double"
    if not n_sources:
        return docs.sparkSession.createDataFrame([], kinds)
    least = budget / total if budget is not None else 1.0  # weights equal to the shares repeat least: every source alike
    if least > max_repeats:
        raise ValueError(f"{total} tokens, each at most {max_repeats} times, cannot fill a budget of {budget if budget is not None else total}")
    a = find_exponent(sources, total, budget, entropy_gain, max_repeats)
    x = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total))))
    z, cover = sources.agg(F.sum(x), F.max(F.col("tokens") / x)).first()
    tokens = float(budget) if budget is not None else cover * z
    # tokens of each source, whole epochs, and what the last epoch may hold
    plan = sources.select("source", "tokens", F.least(F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)), F.lit(MAX_BLOCKS)).cast("long").alias("blocks"), (x / F.lit(z)).alias("weight"), F.floor(x / F.lit(z) * F.lit(tokens) + F.lit(1e-6)).cast("long").alias("quota"))
    plan = cut(plan.withColumn("whole", F.expr("quota div tokens")).withColumn("rest", F.col("quota") % F.col("tokens")), "mix-plan")

    block = F.pmod(F.conv(F.substring(_order(seed, F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    placed = cut(sized.join(plan.select("source", "blocks"), "source").select("doc_id", "source", "n_tokens", block.alias("block")), "mix-placed")
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    epochs = sums.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int")))).withColumn("limit", F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("rest")))
    turn = Window.partitionBy("source", "epoch").orderBy(_order(seed, F.col("epoch").cast("string"), "block", F.col("block").cast("string")), "block")
    before = F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("block_tokens")
    taken = cut(epochs.withColumn("before", before).where("before < limit").select("source", "block", "epoch", "before", "limit", "tokens", "quota", "weight"), "mix-blocks")
    inner = Window.partitionBy("source", "epoch", "block").orderBy(_order(seed, F.col("epoch").cast("string"), F.col("doc_id").cast("string")), "doc_id", "n_tokens")
    end = F.col("before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.join(taken, ["source", "block"]).withColumn("end", end).where(F.col("end") <= F.col("limit"))
    position = (F.col("epoch") * F.col("tokens") + F.col("end") - F.col("n_tokens")) / F.col("quota")
    return rows.select("doc_id", "source", "epoch", "block", "n_tokens", "weight", position.alias("position"))
