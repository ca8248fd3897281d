"""Exact top-k by multi-resolution segment statistics.

A vector is cut into segments with their means and deviations. For every pair |q - x|^2 is at least the sum over the
segments of length * ((mean difference)^2 + (deviation difference)^2). As q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 and |q|^2
is the sum of length * (mean^2 + deviation^2), that lower bound on distances is an upper bound on inner products. Bounds
go from few long segments to many short ones; each resolution drops the pairs that cannot enter a query's best k, and
the survivors' exact products decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import search

#: Segments per resolution, from coarse to fine.
RESOLUTIONS = (4, 8, 16, 32)


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, scaled by the root of the segments' lengths: products of rows are the bounds."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / n
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / n
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], axis=1) * np.sqrt(np.r_[n, n])


def survivors(q: np.ndarray, x: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose bounds reach the queries' k-th best score, with their exact scores."""
    slack = 1e-9 * (np.linalg.norm(q, axis=1) * max(1.0, np.linalg.norm(x, axis=1).max(initial=0.0))) + 1e-6
    # a first k-th best: the exact scores of the k + 1 candidates with the highest coarse bounds (one may be the query)
    bound = features(q, RESOLUTIONS[0]) @ features(x, RESOLUTIONS[0]).T
    if x.shape[0] > k + 1:
        some = np.argpartition(-bound, k, axis=1)[:, : k + 1]
        scores = np.sort(np.einsum("qd,qkd->qk", q, x[some]), axis=1)
        top = np.maximum(top, scores[:, 0])
    qi, xi = np.nonzero(bound >= (top - slack)[:, None])
    for segments in RESOLUTIONS[1:]:
        if segments >= x.shape[1] or not len(qi):
            break
        fq, fx = features(q, segments), features(x, segments)
        if len(qi) * 4 > len(q) * len(x):  # most pairs are left: one product of matrices is cheaper
            keep = (fq @ fx.T)[qi, xi] >= (top - slack)[qi]
        else:
            keep = np.concatenate([np.einsum("pd,pd->p", fq[qi[a : a + 65536]], fx[xi[a : a + 65536]]) for a in range(0, len(qi), 65536)]) >= (top - slack)[qi]
        qi, xi = qi[keep], xi[keep]
    if len(qi) * 4 > len(q) * len(x):
        score = (q @ x.T)[qi, xi]
    else:
        score = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", q[qi[a : a + 65536]], x[xi[a : a + 65536]]) for a in range(0, len(qi), 65536))])
    keep = score >= top[qi]
    return qi[keep], xi[keep], score[keep]


def exact_top_k(vectors: DataFrame, is_query, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * x), ties to smaller ids.

    is_query is a condition on a column named id. Vectors that are null or empty or have a null or non-finite component
    take no part, nor do null ids; vectors of other lengths never meet. Rows that repeat an id are each a candidate,
    but never for their own id. Scores are exact as long as |q| * |x| stays under 2^53.
    """

    def pack(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        return {"x": np.floor(scale * x).astype("<f8").tobytes()}

    def kernel(qx: bytes, _q: bytes, xs: bytes, _x: bytes, top: np.ndarray, n_q: int, n_x: int, k: int):
        return survivors(np.frombuffer(qx, "<f8").reshape(n_q, -1), np.frombuffer(xs, "<f8").reshape(n_x, -1), top, k)

    return search(vectors, is_query, k, pack, kernel, "long", id_col, vector_col, zero=True)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
