"""Embedding whitening by LOBPCG.

Components are searched block-wise: a Rayleigh-Ritz step picks the best of the space that the iterate, its residuals and
the previous direction span. The covariance is never built: each round multiplies it with the block of residuals, as sums over
centred rows that Spark adds up, so a round is one pass over the distinct vectors and only a block of dim rows comes to
the driver. Rounds end when residuals, certified by a product of their own, are as small as double precision allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .quantised import decimals, fits, matrix_of, quantised, totals

#: Vectors of a block for each component that is asked for; residuals against the largest eigenvalue at which rounds
#: end, and the smallest eigenvalue against it that counts as one.
GUARD, TOLERANCE, LEAST = 4, 2e-13, 1e-12
MOST_ROUNDS = 1000


def _beside(w: np.ndarray, s: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of what the columns span outside of s, which is orthonormal; columns count alike, however short."""
    size = np.linalg.norm(w, axis=0)
    w = w[:, size > 0] / size[size > 0]
    for _ in range(2):
        w = w - s @ (s.T @ w)
        u, size, _ = np.linalg.svd(w, full_matrices=False)
        w = u[:, size > least]
    return np.linalg.qr(w - s @ (s.T @ w))[0]


def _ritz(s: np.ndarray, a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest Ritz values of the space s (orthonormal, a: its product) and their coefficients."""
    h = s.T @ a
    e, c = np.linalg.eigh((h + h.T) / 2)
    return e[::-1][:n], c[:, ::-1][:, :n]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, count: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """The `count` largest eigenvalues of a symmetric positive matrix, unit eigenvectors, and their certified residual.

    product(x) multiplies a block with the matrix. The residual is the largest |A x - e x| against the largest eigenvalue.
    """
    block, count = min(dim, GUARD * count), min(dim, count)
    x = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, block)))[0]
    ax, fresh, least = product(x), True, np.inf
    p = ap = np.zeros((dim, 0))
    for _ in range(MOST_ROUNDS):
        e, c = _ritz(x, ax, block)
        x, ax = x @ c, ax @ c
        if e[0] <= 0:
            return np.zeros(count), x[:, :count], 0.0
        r = ax - x * e
        size = float(np.linalg.norm(r[:, :count], axis=0).max() / e[0])
        # certified, or products of their own no longer get it down: what is left is rounding
        if fresh and (size <= tolerance or least / 2 < size < 100 * tolerance):
            return e[:count], x[:, :count] / np.linalg.norm(x[:, :count], axis=0), size
        least = size if fresh else least
        if size <= tolerance:
            x = np.linalg.qr(x)[0]
            ax, fresh, p, ap = product(x), True, p[:, :0], ap[:, :0]
            continue
        s, a = np.hstack([x, p]), np.hstack([ax, ap])
        w = _beside(r, s)
        if not w.shape[1]:  # nothing is left to add
            least, (x, ax, fresh, p, ap) = size, (x, product(x), True, p[:, :0], ap[:, :0])
            continue
        s, a, fresh = np.hstack([s, w]), np.hstack([a, product(w)]), False
        e, c = _ritz(s, a, block)
        # the direction just taken: what is new in x, chosen among coefficients, so no products are rounded again
        new = c.copy()
        new[:block] = 0
        z = _beside(new, c)
        x, ax, p, ap = s @ c, a @ c, s @ z, a @ z
    raise RuntimeError(f"residuals are still {size} after {MOST_ROUNDS} rounds")


@dataclass(frozen=True)
class Whitening:
    """A fit: vectors that it saw, their sums (whole numbers), components as columns, eigenvalues, trace of the covariance,
    and the largest entry by which the whitened vectors' covariance differs from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit(distinct: DataFrame, dim: int, count: int) -> Whitening:
    """Fits the rows of distinct (key: vectors of dim components), each once."""

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        return np.r_[matrix_of(batch.column("key"), dim).astype(object).sum(axis=0), batch.num_rows] if batch.num_rows else 0

    keys = distinct.select("key")
    *s, n = totals(keys, dim + 1, sums, exact=True).tolist()
    mean, trace = np.array([v / n for v in s]), []

    def product(x: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            rows = matrix_of(batch.column("key"), dim) - mean
            return np.r_[(rows.T @ (rows @ x)).ravel(), (rows * rows).sum()]

        out = totals(keys, x.size + 1, part) / n
        trace.append(out[-1])
        return out[:-1].reshape(x.shape)

    e, u, residual = lobpcg(product, dim, count)
    k = int((e > LEAST * e[0]).sum())
    e, u = e[:k], u[:, :k]
    onto = u / np.sqrt(e)
    if k:
        white = lambda batch: (matrix_of(batch.column("key"), dim) - mean) @ onto
        at = totals(keys, k, lambda b: white(b).sum(axis=0)) / n
        covariance = totals(keys, k * k, lambda b: ((w := white(b) - at).T @ w).ravel()) / n
        error = float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())
    return Whitening(n, s, u, e, trace[0], residual, error if k else 0.0)


def apply(rows: DataFrame, dim: int, w: Whitening) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of rows (id, key); a row for each component."""
    k, onto, mean, sums, n = len(w.eigenvalues), w.components / np.sqrt(w.eigenvalues), w.mean, np.array(w.sums, object), w.n
    far, explained, error = max(map(abs, w.sums)), w.eigenvalues / w.trace if k else np.zeros(0), w.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("key"), dim)
            small = fits(n * int(np.abs(x).max(initial=0)) + far, dim)
            away = n * (x if small else x.astype(object)) - (sums.astype(np.int64) if small else sums)
            each = np.repeat(np.arange(len(x)), k)
            rows_out = len(each)
            yield pa.record_batch([
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows_out, n)), decimals((away * away).sum(axis=1)).take(pa.array(each)),
                pa.array(((x - mean) @ onto).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(rows_out, error)),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "key").mapInArrow(run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error of floor(scale * x), whitened by the distinct vectors.

    Vectors that are null or empty or have a null or non-finite component take no part. Null and repeated ids and repeated
    rows stay, a row each; other columns are ignored. Vectors of each length are whitened on their own. Components
    are at most as many as the vectors have, and those of no variance are left out: where all vectors are
    equal there are no rows, as for an empty table. Of equal eigenvalues any basis may be found. deviation is exact, and null
    beyond 38 digits; scaled components beyond 2^53 are taken as that.
    """
    rows = stored(quantised(vectors, scale, id_col, vector_col), "vectors")
    distinct = stored(rows.groupBy("dim", "key").agg(F.lit(1).alias("one")).select("dim", "key"), "distinct")
    out = apply(rows.limit(0), 1, Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0, 0.0))
    for (dim,) in distinct.select("dim").distinct().orderBy("dim").collect():
        w = fit(distinct.where(F.col("dim") == dim), dim, components)
        if len(w.eigenvalues):
            part = apply(rows.where(F.col("dim") == dim), dim, w)
            out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it does not fit a long."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
