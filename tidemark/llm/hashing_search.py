"""Approximate nearest neighbours by multi-index hashing.

A bounded sample fits rotations (iterative quantisation) whose signs are a vector's binary code. Codes are split into
substrings; every block of vectors is indexed once, a table of places a substring. Each query probes every value within a
few bits of its own substring in every table: by the pigeonhole principle that retrieves all codes within a Hamming radius
of tables * (bits + 1) - 1, and most of those a good way beyond it. Whole codes' distances drop what is beyond a radius
fitted on the sample, and exact inner products of the original vectors, computed for what is left alone, rank it. Which
codes are retrieved depends on the query and the code only, never on blocks or their order.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import search, usable

#: Vectors of the sample that fits the rotations and radii; rows with the smallest hashes of their ids.
SAMPLE = 4096
#: Bits of a code at least (whole rotations), bits of a substring.
CODE_BITS, SUBSTRING_BITS = 512, 16
#: Shares of the sample's own neighbours that probing and the radius of whole codes must reach; bits that probes may differ in.
PROBED, REACH, MOST_BITS = 0.97, 0.985, 5
#: Queries that are probed at once.
AT_ONCE = 64


def fit_rotations(x: np.ndarray, rotations: int | None = None, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """(dim, rotations * dim): orthogonal matrices, each turned so that signs lose little of the sample."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations or -(-CODE_BITS // x.shape[1])):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _s, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of 16 bits of each row's code; a code is padded with zeros to whole substrings."""
    bits = x @ rotations >= 0
    if pad := -bits.shape[1] % SUBSTRING_BITS:
        bits = np.concatenate([bits, np.zeros((len(bits), pad), bool)], axis=1)
    return np.packbits(bits, axis=1).reshape(len(bits), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def _wide(code: np.ndarray) -> np.ndarray:
    """Codes as words of 64 bits, padded with zeros."""
    return np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 4)))).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a and b."""
    a, b = _wide(a), _wide(b)
    out = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def probes(bits: int) -> np.ndarray:
    """What to flip in a substring to reach all values that differ in at most `bits` bits."""
    flips = [sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(SUBSTRING_BITS), n)]
    return np.array(flips, np.uint16)


def table_order(code: np.ndarray) -> np.ndarray:
    """(tables, rows): each table's places in the order of its substring's values, made once for a block."""
    return np.argsort(code.T, axis=1, kind="stable").astype("<u2" if len(code) <= 1 << 16 else "<u4")


class Index:
    """A block's tables: for each substring where each of its 65536 values begins among the ordered places."""

    def __init__(self, code: np.ndarray, order: np.ndarray | None = None):
        self.code, self.order = code, table_order(code) if order is None else order
        self.wide = _wide(code)
        self.first = [np.r_[0, np.cumsum(np.bincount(column, minlength=1 << SUBSTRING_BITS))].astype(np.int32) for column in code.T]

    def retrieve(self, query: np.ndarray, flips: np.ndarray) -> np.ndarray:
        """(queries, rows): codes with a substring that is a flip away from the query's."""
        seen = np.zeros((len(query), len(self.code)), bool)
        for value, first, order in zip(query.T, self.first, self.order, strict=True):
            probe = value[:, None] ^ flips
            at, stop = first[probe], first[probe.astype(np.int32) + 1]
            qi, pi = np.nonzero(stop > at)
            at, n = at[qi, pi], stop[qi, pi] - at[qi, pi]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen[np.repeat(qi, n), order[np.repeat(at, n) + inner]] = True
        return seen

    def near(self, query: np.ndarray, flips: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) places of the retrieved codes within the radius."""
        qi, xi = np.nonzero(self.retrieve(query, flips))
        wide, far = _wide(query), np.zeros(len(qi), np.int32)
        for j in range(wide.shape[1]):
            far += np.bitwise_count(wide[qi, j] ^ self.wide[xi, j])
        keep = far <= radius
        return qi[keep], xi[keep]


def fit_radii(x: np.ndarray, code: np.ndarray, k: int, total: int) -> tuple[int, int]:
    """(bits to probe, radius) that reach enough of the sample's own neighbours.

    Of a table of `total` rows the k nearest lie about as near as the k * sample / total nearest of the sample.
    """
    some = np.arange(min(len(x), 512))
    near = x[some] @ x.T
    near[some, some] = -np.inf
    k = min(max(-(-k * len(x) // max(total, 1)), 2), len(x) - 1)
    if k < 1:
        return 0, code.shape[1] * SUBSTRING_BITS
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    pairs = code[some][:, None, :] ^ code[best]
    radius = int(np.quantile(np.bitwise_count(pairs).sum(axis=2, dtype=np.int32), REACH))
    least = np.bitwise_count(pairs).min(axis=2)
    return next((b for b in range(MOST_BITS) if (least <= b).mean() >= PROBED), MOST_BITS), radius


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by exact inner products, ties to smaller ids.

    Every row is indexed; only rotations and radii come from a sample of at most `sample` rows. Queries that find fewer
    than k rows in the whole table are compared with all of it. Null, empty or zero vectors and those with null or
    non-finite components take no part, nor do null ids; rows that repeat an id are candidates of their own; vectors of a
    length other than the sample's most common one are compared without codes. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col, zero=False)
    taken = [np.array(r.v) for r in rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(sample).collect()]
    lengths = [len(v) for v in taken]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    x = np.array([v for v in taken if len(v) == dim]) if taken else np.zeros((0, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rotations = fit_rotations(x) if len(x) else np.eye(dim)
    bits, radius = fit_radii(x, codes(x, rotations), k, rows.count()) if len(x) else (0, 0)
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast((rotations, probes(bits), radius))  # a few dim x dim matrices and some thousand flips

    def pack(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        r = known.value[0]
        if x.shape[1] != len(r):
            return {"x": x.astype("<f8").tobytes()}
        code = codes(x, r)
        return {"x": x.astype("<f8").tobytes(), "extra": code.astype("<u2").tobytes() + table_order(code).tobytes()}

    def unpack(data: bytes, n: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(data, "<u2", n * tables).reshape(n, tables)
        order = np.frombuffer(data, "<u2" if n <= 1 << 16 else "<u4", offset=2 * n * tables).reshape(tables, n)
        return code, order

    def kernel(qx: bytes, q_extra: bytes, xs: bytes, x_extra: bytes, top: np.ndarray, n_q: int, n_x: int, k: int):
        rotations, flips, radius = known.value
        q, x = np.frombuffer(qx, "<f8").reshape(n_q, -1), np.frombuffer(xs, "<f8").reshape(n_x, -1)
        if not x_extra:
            return all_pairs(q, x, top)
        tables = -(-rotations.shape[1] // SUBSTRING_BITS)
        index, qc = Index(*unpack(x_extra, n_x, tables)), unpack(q_extra, n_q, tables)[0]
        parts = []
        for a in range(0, n_q, AT_ONCE):
            qi, xi = index.near(qc[a : a + AT_ONCE], flips, radius)
            parts.append((qi + a, xi, np.einsum("ij,ij->i", q[qi + a], x[xi])))
        qi, xi, score = map(np.concatenate, zip(*parts, strict=True))
        keep = score >= top[qi]
        return qi[keep], xi[keep], score[keep]

    def all_pairs(q: np.ndarray, x: np.ndarray, top: np.ndarray):
        score = q @ x.T
        qi, xi = np.nonzero(score >= top[:, None])
        return qi, xi, np.einsum("ij,ij->i", q[qi], x[xi])

    def exact(qx: bytes, q_extra: bytes, xs: bytes, x_extra: bytes, top: np.ndarray, n_q: int, n_x: int, k: int):
        return all_pairs(np.frombuffer(qx, "<f8").reshape(n_q, -1), np.frombuffer(xs, "<f8").reshape(n_x, -1), top)

    found = stored(search(rows, is_query, k, pack, kernel, "double", "id", "v", zero=False), "found")
    asked = rows.where(is_query).select("id").distinct()
    short = asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id"), "id", "left_anti")
    if short.isEmpty():
        return found
    short = stored(short, "short")
    # written before it is dealt to blocks: a task that runs again must see the rows in the same order
    again = stored(rows.join(short.withColumn("short", F.lit(True)), "id", "left"), "again")
    rest = search(again, F.col("short"), k, lambda ids, x: {"x": x.astype("<f8").tobytes()}, exact, "double", "id", "v", zero=False, keep=["short"])
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
