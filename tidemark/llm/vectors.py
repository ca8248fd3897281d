"""A stated query set against all vectors, in blocks.

Vectors are packed into blocks of bounded size; each task holds one block of queries, reads a strip of the blocks one
after the other, and keeps each query's best so far. Nothing is broadcast, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Vectors of a block of queries and of a block of candidates.
QUERY_ROWS, BLOCK_ROWS = 512, 4096
#: Bytes of a block's vectors, at most.
BLOCK_BYTES = 16 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool, keep: list[str] | None = None) -> DataFrame:
    """id, v and `keep` of the rows that take part: v has components, all finite, and isn't zero unless that is allowed."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(keep or []))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~bad)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def blocks(rows: DataFrame, n: int, pack: Callable[[np.ndarray, np.ndarray], dict[str, bytes]]) -> DataFrame:
    """block, dim, ids and pack()'s blobs of rows dealt to n even blocks by a hash; a block has one dimension only."""
    # rows that repeat an id and a vector would fill one block: their place in the scan deals them too
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block"))

    def run(t: pa.Table) -> pa.Table:
        """Blocks of a dimension, each of BLOCK_BYTES at most, however many components a vector has."""
        ids = t.column("id").combine_chunks().to_numpy()
        x = matrix(t.column("v").combine_chunks())
        order = np.lexsort((*x.T[:1], ids))
        ids, x = ids[order], x[order]
        step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
        out = [pack(ids[a : a + step], x[a : a + step]) for a in range(0, len(ids), step)]
        n_out = len(out)
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()] * n_out, pa.int32()), "dim": pa.array([x.shape[1]] * n_out, pa.int32()), "ids": pa.array([ids[a : a + step].astype("<i8").tobytes() for a in range(0, len(ids), step)], pa.binary()),
            "x": pa.array([o["x"] for o in out], pa.binary()), "extra": pa.array([o.get("extra", b"") for o in out], pa.binary()),
        })

    return dealt.groupBy("block", "dim").applyInArrow(run, "block int, dim int, ids binary, x binary, extra binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, is_query, k: int, pack: Callable, kernel: Callable, score_type: str, id_col: str, vector_col: str, zero: bool, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best.

    kernel(q, q_extra, x, x_extra, top) returns places (query, candidate) and scores of a block that hold all pairs
    which can still enter top, the queries' k-th best scores so far. Rows with other dimensions never meet.
    """
    rows = usable(vectors, id_col, vector_col, zero, keep)
    total, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n_x, n_q = max(1, -(-total // block_rows)), max(1, -(-(asked or 0) // query_rows))
    strips = min(n_x, max(4, 64 // n_q))
    x = blocks(rows, n_x, pack)
    q = blocks(rows.where(is_query), n_q, pack)
    # each strip of blocks meets each block of queries once
    left = x.select("dim", F.pmod(F.hash("block"), F.lit(strips)).alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.lit(1).alias("side"), "ids", "x", "extra")
    right = q.select("dim", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.col("block").alias("qb"), F.lit(0).alias("side"), "ids", "x", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []

        def result(state: list) -> pa.RecordBatch:
            q_ids, found = state[0], state[3]
            qi = np.concatenate([np.full(len(s), i) for i, (s, _) in enumerate(found)]) if found else np.zeros(0, int)
            s = np.concatenate([s for s, _ in found]) if found else np.zeros(0)
            v = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int64)
            return pa.record_batch([pa.array(q_ids[qi.astype(int)].astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.int64 if score_type == "long" else np.float64))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for dim, strip, qb, side, ids, xs, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, strip, qb) != key:
                    for state in states:
                        yield result(state)
                    key, states = (dim, strip, qb), []
                ids = np.frombuffer(ids, "<i8")
                if side == 0:
                    empty = (np.zeros(0), np.zeros(0, np.int64))
                    states.append([ids, xs, extra, [empty] * len(ids)])
                    continue
                for q_ids, qx, q_extra, found in states:
                    top = np.array([s[-1] if len(s) == k else -np.inf for s, _ in found])
                    qi, xi, score = kernel(qx, q_extra, xs, extra, top, len(q_ids), len(ids), k)
                    own = q_ids[qi] != ids[xi]
                    qi, xi, score = qi[own], xi[own], score[own]
                    order = np.argsort(qi, kind="stable")
                    qi, xi, score = qi[order], xi[order], score[order]
                    edge = np.searchsorted(qi, np.arange(len(q_ids) + 1))
                    for i in np.unique(qi):
                        a, b = edge[i], edge[i + 1]
                        s, v = np.r_[found[i][0], score[a:b]], np.r_[found[i][1], ids[xi[a:b]]]
                        kept = best(s, v, k)
                        found[i] = s[kept], v[kept]
        for state in states:
            yield result(state)
        tidy()

    met = left.unionByName(right).repartition(strips * n_q, "strip", "qb").sortWithinPartitions("dim", "strip", "qb", "side")
    partial = met.select("dim", "strip", "qb", "side", "ids", "x", "extra").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
