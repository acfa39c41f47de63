"""Operator 12 - whitening of embeddings by LOBPCG.

Entries become integers, their sums are exact, and a row is centred before anything is multiplied.  The eigenvectors of the covariance come from the
locally optimal block preconditioned conjugate gradient method: each round orthonormalises the iterate, residual and previous direction
blocks, multiplies the covariance with this basis in one Spark job over the centred rows (the covariance itself is never formed), and takes the
Rayleigh-Ritz vectors of the basis.  Rounds end when the residuals of a fresh product of the wanted vectors, the certificate, are at most ``TOLERANCE`` of the
largest eigenvalue.

The driver holds blocks of (dimensions) x (three times the block width) numbers and never a row; tasks return one partial product each, which
Spark adds up by position.

Defined results: rows whose vector is null, holds null or non-finite entries, or is shorter than the longest such vector (missing entries count as null) are
dropped; all others are the fit list, repeated rows and rows with a null id included.  Entries are held within +-2**52 once scaled.  Components whose
eigenvalue is not above rounding (``RANK_FLOOR`` of the trace) have no whitened form and are left out, so equal vectors give no
row.  A deviation beyond 64 bits is NULL.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lean
from .common import cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 8  # vectors beyond the wanted ones, for faster convergence
TOLERANCE = 1e-13
RANK_FLOOR = 1e-12
ROUNDS = 300
_LIMIT = 1 << 52
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


@dataclass
class Fit:
    """What the fit list gives: count, exact sums, and the eigenpairs of the covariance (columns of ``vectors``) with their certified residuals."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def whole_vectors(vectors: DataFrame, embedding: str, *keep: Column) -> DataFrame:
    """``keep, v``: the rows with a vector of the greatest length, all of whose entries are finite numbers."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(*keep, v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    return rows.where(F.size("v") == (longest or 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where they hold it, else in Python's integers."""
    if not len(x):
        return x
    fits = float(np.abs(x).max()) * n < 2.0**62 and float(np.abs(sums).max()) < 2.0**62
    return x * n - sums.astype(np.int64) if fits else x.astype(object) * n - sums


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; None beyond 64 bits."""
    if y.dtype != object and len(y) and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) * int(v) for v in row) for row in y)]


def column_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                part = x.sum(0) if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object).sum(0)
                total, n = (part.astype(object) if total is None else total + part), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([str(n), *map(str, total)])], names=["at", "s"])

    parts = fit.select("x").mapInArrow(lean.batches(run), "at int, s string")
    rows = parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one for each dimension
    found = {r["at"]: int(r["s"]) for r in rows}
    n = found.pop(-1, 0)
    return n, np.array([found[k] for k in range(len(found))], dtype=object)


def products(fit: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``block``, and the covariance's trace: one job over the rows."""
    d, m = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trace = np.zeros((d, m)), 0.0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                z = centred(x, n, sums).astype(float) / n
                out += z.T @ (z @ block)
                trace += float((z * z).sum())
        cells = np.append(out.ravel(), trace)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["at", "v"])

    rows = fit.select("x").mapInArrow(lean.batches(run), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # d * m numbers
    flat = np.zeros(d * m + 1)
    flat[[r["at"] for r in rows]] = [r["v"] for r in rows]
    return flat[:-1].reshape(d, m) / n, float(flat[-1]) / n


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the columns of ``against``."""
    for _ in range(2):
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        block = block - against @ (against.T @ block)
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    return u - against @ (against.T @ u)


def lobpcg(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest eigenvalues, their vectors, certified residuals, the trace and the number of rounds.

    Every round multiplies the whole orthonormal basis anew, so no product is carried along and none drifts."""
    width = min(d, k + guard)
    x = np.linalg.qr(np.random.Generator(np.random.PCG64(12)).normal(size=(d, width)))[0]
    none = np.zeros((d, 0))
    residual, previous = none, none
    for count in range(1, rounds + 1):
        w = orthonormal(residual, x)
        basis = np.concatenate((x, w), axis=1)
        basis = np.concatenate((basis, orthonormal(previous, basis)), axis=1)[:, :d]
        image, trace = product(basis)
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1][:width], vector[:, ::-1][:, :width]
        new, mapped = basis @ vector, image @ vector
        new, r = np.linalg.qr(new)
        new = new * np.sign(np.diag(r))
        residual, previous = mapped - new * value, new - x @ (x.T @ new)
        x = new
        size = np.linalg.norm(residual[:, :k], axis=0)
        if (size <= tolerance * max(value[0], 0.0)).all() or trace == 0:
            mapped, trace = product(x)  # the certificate
            value = (x * mapped).sum(0)
            size = np.linalg.norm(mapped - x * value, axis=0)[:k]
            if (size <= 2 * tolerance * max(value[0], 0.0)).all():
                order = np.argsort(-value[:k], kind="stable")
                return value[order], x[:, order], size[order], trace, count
            residual = mapped - x * value
    raise ArithmeticError(f"residuals of {size.max():.3g} after {rounds} rounds")


def fit_components(fit: DataFrame, k: int = COMPONENTS, tolerance: float = TOLERANCE) -> Fit:
    """``fit``: one vector ``x`` of integers a row."""
    n, sums = column_sums(fit)
    d = len(sums)
    if not n or not d:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    value, vector, size, trace, rounds = lobpcg(lambda block: products(fit, n, sums, block), d, min(k, d), tolerance=tolerance)
    real = value > RANK_FLOOR * trace if trace > 0 else np.zeros(len(value), bool)
    value, vector, size = value[real], vector[:, real], size[real]
    vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])] < 0, -1.0, 1.0)  # the greatest entry is positive
    return Fit(n, sums, trace, value, vector, size, rounds)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each vector of the fit list and component: see the module's text; ``residual`` is the certified one over the eigenvalue."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, embedding, F.col(vec_id).cast("long").alias("vec_id"))
    held = lambda c: F.greatest(F.lit(float(-_LIMIT)), F.least(F.lit(float(_LIMIT)), c * F.lit(float(scale))))
    fit = cut(whole.select("vec_id", F.transform("v", lambda c: (F.floor(held(c)) + F.lit(shift)).cast("long")).alias("x")), "whitening-fit")
    found = fit_components(fit, components)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], _OUT)
    turn = found.vectors / np.sqrt(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = centred(matrix(batch.column(1)), found.n, found.sums)
                w = (y.astype(float) / found.n) @ turn
                offs = pa.array(np.arange(0, w.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(y), pa.int64()), pa.ListArray.from_arrays(offs, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    scored = cut(fit.mapInArrow(lean.batches(run), "vec_id long, deviation long, w array<double>"), "whitening-scored")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = scored.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
    one = lambda x: F.array(*(F.lit(float(v)) for v in x))
    rows = scored.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(one(found.values / found.trace), F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"), F.element_at(one(found.residuals / found.values), F.col("at") + 1).alias("residual"),
    )
