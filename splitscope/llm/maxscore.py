"""Operator 13 - exact top-k inner products by MaxScore.

A query's terms are its dimensions, a dimension's postings the components of a shard's vectors, kept in blocks of similar vectors with their
least and greatest component.  A block's bound for a term is the greater of the products with both; what a term can add above the lesser one is the term's
bound.

*Split.*  Terms in ascending order of their bounds are non-essential as long as the vectors that gain from them alone stay below the k-th best score so
far; the others are essential.  *Traverse.*  A block is left out for the queries whose k-th best the sum of its bounds
cannot reach; for the others its essential postings are added up.  *Probe.*  Non-essential terms follow, greatest bound
first, for the pairs of query and vector that are still competitive.  *Merge.*  Shards of about ``SHARD`` vectors are searched in rounds, each with ``GROWTH`` times the shards before it,
and every round knows the k-th best (score, id) of the rounds before.  A shard returns only what beats it: about ``k * GROWTH`` rows a query and round,
however many shards there are.

Queries lie in the shared folder in blocks of about ``QUERY_BLOCK`` with their k-th best, and are read in turn by every shard's task, so a task holds one
shard and one block.  The driver sees no vector.

Defined results: vectors that are null, hold null or non-finite components or are shorter than the longest such vector take no part, nor do rows
with a null id; of rows that repeat an id the one with the smallest vector stands for all, so no query finds its own id; equal scores go by the smaller
id; a query with fewer than k candidates gets all; an empty table gives an empty result; extra columns are ignored.  Scores are exact while
the products' sums fit in 62 bits; beyond, the search raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lean
from .common import cut, scratch_path
from .whitening import matrix, whole_vectors

SHARD = 4096
GROWTH = 16
BLOCK = 256
QUERY_BLOCK = 2048
PROBE = 16  # non-essential terms between two looks at who is still competitive
SPARSE = 0.05  # share of competitive pairs below which they are probed one by one
SCALE = 256
_FOUND = "query_id long, vec_id long, score long"


class Shard:
    """Vectors with their bounds, block by block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        home = np.abs(x).argmax(1) if x.size else np.zeros(len(x), np.int64)
        lead = x[np.arange(len(x)), home] if x.size else np.zeros(len(x), np.int64)
        order = np.lexsort((ids, lead, home))  # vectors with the same leading component lie together
        self.ids, self.x = ids[order], x[order]
        at = np.arange(0, len(ids), BLOCK)
        self.edges = list(zip(at.tolist(), np.append(at[1:], len(ids)).tolist(), strict=True))
        self.low, self.high = (f.reduceat(self.x, at, axis=0) for f in (np.minimum, np.maximum))
        self.greatest = float(np.abs(x).max()) if x.size else 0.0

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, beat: np.ndarray, beat_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query number, id, score`` of at most k vectors for each query, those that beat its ``(beat, beat_id)``, the k-th best found elsewhere (-inf: none)."""
        exact = (float(np.abs(q).max()) if q.size else 0.0) * self.greatest * max(1, q.shape[1])
        if exact >= 2.0**62:
            raise ArithmeticError("inner products beyond 62 bits")
        kind = np.float64 if exact < 2.0**52 else np.int64  # sums of products are exact in both
        q, beat, beat_id = q.astype(kind), beat.copy(), beat_id.copy()
        held = [np.zeros(0, np.int64)] * 3
        for b in range(len(self.edges)):
            found = self._block(b, query_ids, q, k, beat, beat_id)
            if len(found[0]):
                held = self._best([np.concatenate(c) for c in zip(held, found, strict=True)], k, beat, beat_id)
        return tuple(held)

    @staticmethod
    def _best(held: list[np.ndarray], k: int, beat: np.ndarray, beat_id: np.ndarray) -> list[np.ndarray]:
        """The k best of each query among these; raises ``beat`` where there are k."""
        order = np.lexsort((held[1], -held[2], held[0]))
        held = [c[order] for c in held]
        first = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = nth == k - 1
        beat[held[0][last]], beat_id[held[0][last]] = held[2][last], held[1][last]
        return [c[nth < k] for c in held]

    def _block(self, b: int, query_ids: np.ndarray, q: np.ndarray, k: int, beat: np.ndarray, beat_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's vectors that beat what the queries have."""
        start, end = self.edges[b]
        ends = q * self.low[b], q * self.high[b]
        floor, ceiling = np.minimum(*ends), np.maximum(*ends)
        near = np.flatnonzero(ceiling.sum(1) >= beat)
        if not len(near):
            return near, near, near
        q, floor, ceiling, least = q[near], floor[near], ceiling[near], beat[near]
        # the most that vectors gain from the terms so far alone
        order = np.argsort(ceiling - floor, axis=1, kind="stable")
        up = floor.sum(1)[:, None] + np.cumsum(np.take_along_axis(ceiling - floor, order, 1), axis=1)
        n_loose = (up < least[:, None]).sum(1)
        level = np.empty_like(order)
        np.put_along_axis(level, order, n_loose[:, None] - 1 - np.arange(order.shape[1]), 1)  # below 0: essential, then by falling bound
        x = self.x[start:end].astype(q.dtype)
        score = np.where(level < 0, q, 0) @ x.T
        own = np.minimum(np.searchsorted(query_ids[near], self.ids[start:end]), len(near) - 1)
        hit = np.flatnonzero(query_ids[near][own] == self.ids[start:end])
        other = np.ones(score.shape, bool)
        other[own[hit], hit] = False
        if score.shape[1] > k and not np.isfinite(least).all():  # without a k-th best, the block's own will do
            none = np.flatnonzero(~np.isfinite(least))
            least = least.copy()
            least[none] = np.partition(np.where(other[none], score[none].astype(float), -np.inf), -k, axis=1)[:, -k]
        first, deepest = 0, int(n_loose.max())
        while True:
            rest = np.where(level >= first, ceiling, 0).sum(1)
            alive = (score + rest[:, None] >= least[:, None]) & other
            if first >= deepest or alive.mean() < SPARSE:
                break
            score += np.where((level >= first) & (level < first + PROBE), q, 0) @ x.T
            first += PROBE
        r, c = np.nonzero(alive)
        score = score[r, c]
        for turn in range(first, deepest, PROBE):  # few are left: one by one
            now = (level >= turn) & (level < turn + PROBE)
            score = score + np.einsum("ij,ij->i", np.where(now, q, 0)[r], x[c])
            keep = score + np.where(level >= turn + PROBE, ceiling, 0).sum(1)[r] >= least[r]
            r, c, score = r[keep], c[keep], score[keep]
        ids = self.ids[start:end][c]
        keep = (score > beat[near][r]) | ((score == beat[near][r]) & (ids < beat_id[near][r]))
        return near[r[keep]], ids[keep], score[keep].astype(np.int64)


def _write_queries(queries: DataFrame, found: DataFrame | None, n_blocks: int, k: int) -> str:
    """The folder of query blocks: id, vector, and the k-th best (score, id) so far."""
    rows = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    none = F.lit(None).cast("long")
    if found is None:
        rows = rows.withColumns({"beat": none, "beat_id": none})
    else:
        last = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("beat"), F.col("found_id").alias("beat_id"))
        rows = rows.join(last, "vec_id", "left")
    path = scratch_path(queries.sparkSession, "maxscore-queries")
    rows.write.partitionBy("block").parquet(path)
    return path


def _read_queries(path: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids in order, vectors, and the k-th best of each."""
    fs, base = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet"))
    parts = [pq.ParquetFile(fs.open_input_file(f)).read(["vec_id", "x", "beat", "beat_id"]) for f in files]
    if not parts:
        return None
    t = pa.concat_tables(parts).sort_by("vec_id")
    beat = np.array([-np.inf if v is None else v for v in t.column("beat").to_pylist()])
    return t.column("vec_id").to_numpy(), matrix(t.column("x")), beat, t.column("beat_id").fill_null(-1).to_numpy()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; a query has few rows here, as shards return only what can be among them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``.  Both tables: ``vec_id`` and ``x``, a vector of integers, each id once; all vectors of one length."""
    n, n_queries = vectors.count(), queries.count()
    if not n or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_shards, n_blocks = -(-n // shard), -(-n_queries // QUERY_BLOCK)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(n_shards)))
    best, done = None, 0
    while done < n_shards:
        upto = min(n_shards, max(1, done * GROWTH))
        path = _write_queries(queries, None if best is None else best.withColumnRenamed("vec_id", "found_id"), n_blocks, k)
        own = dealt.where((F.col("shard") >= done) & (F.col("shard") < upto))
        new = own.groupBy("shard").applyInArrow(lean.group(_searcher(path, n_blocks, k)), _FOUND)
        best = cut(_ranked(new if best is None else best.select("query_id", "vec_id", "score").unionByName(new), k), "maxscore-best")
        done = upto
    return best.select("query_id", "rank", "vec_id", "score")


def _searcher(path: str, n_blocks: int, k: int):
    def one(group: pa.Table) -> pa.Table:
        index = Shard(group.column("vec_id").to_numpy(), matrix(group.column("x")))
        out = [[], [], []]
        for block in range(n_blocks):
            queries = _read_queries(path, block)
            if queries is not None:
                ids, q, beat, beat_id = queries
                who, found, score = index.search(ids, q, k, beat, beat_id)
                for c, v in zip(out, (ids[who], found, score), strict=True):
                    c.append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return one


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """The ``k`` best of all rows for each row whose id is divisible by ``every``, on components scaled and floored."""
    whole = whole_vectors(vectors, embedding, F.col(vec_id).cast("long").alias("vec_id")).where("vec_id is not null")
    # huge components saturate here and are refused by the search
    rows = whole.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    rows = cut(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "maxscore-vectors")
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
