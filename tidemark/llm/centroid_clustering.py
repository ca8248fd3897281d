"""Centroid clustering of distinct vectors with multiplicities.

Vectors are quantised to whole numbers and equal ones grouped, so a vector that many rows repeat is met once, with a weight.
Lloyd's rounds run over the distinct vectors: a task adds up weighted whole numbers a centroid, Spark adds up the
tasks, and centroids are their exact floors. Assignments are joined back to the rows at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .quantised import decimals, fits, matrix_of, meet, quantised, totals


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and the squared distance to it, in whole numbers."""
    if not fits(int(np.abs(x).max(initial=0)) + max(abs(int(c)) for c in centroids.ravel()), x.shape[1]):
        x = x.astype(object)
    else:
        centroids = centroids.astype(np.int64)
    best, least = np.zeros(len(x), np.int64), None
    for c, at in enumerate(centroids):
        away = x - at
        distance = (away * away).sum(axis=1)
        if least is None:
            least = distance
            continue
        closer = (distance < least).astype(bool)
        best[closer], least = c, np.where(closer, distance, least)
    return best, least


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after so many rounds over distinct (key, n). Empty ones stay."""
    k, dim = len(centroids), len(centroids[0])
    for _ in range(rounds):
        now = np.array(centroids, object)

        def part(batch: pa.RecordBatch, now: np.ndarray = now) -> np.ndarray:
            x, n = matrix_of(batch.column("key"), dim), batch.column("n").to_numpy()
            of, _ = nearest(x, now)
            if int(n.sum()) * int(np.abs(x).max(initial=0)) >= 1 << 62:
                x, n = x.astype(object), n.astype(object)
            rows = np.column_stack([x * n[:, None], n])
            return np.concatenate([rows[of == c].sum(axis=0) for c in range(k)])

        sums = totals(distinct, k * (dim + 1), part, exact=True).reshape(k, dim + 1)
        centroids = [[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old for row, old in zip(sums.tolist(), centroids, strict=True)]
    return centroids


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, length: int = 64, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256 of every vector of `length` components.

    Vectors that are null, of another length or have a null or non-finite component take no part. The first centroids
    are the rows whose sha256 of seed and id comes first; equal ids by vector, null ids last. Repeated rows count as often as they
    occur, also among the first centroids: of equal centroids only the first is ever met. With fewer rows than
    clusters there are fewer centroids; an empty table gives no rows; other columns are ignored. Distances and their sums are
    exact, and null beyond 38 digits; scaled components beyond 2^53 are taken as that.
    """
    rows = stored(quantised(vectors, scale, id_col, vector_col, length).select("id", "key"), "vectors")
    distinct = stored(rows.groupBy("key").agg(F.count("*").alias("n")), "distinct")
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("at"), "key").orderBy(F.asc_nulls_last("at"), "key").limit(clusters).collect()
    if not first:
        return rows.limit(0).select(F.col("id").alias(id_col), *(F.lit(None).cast(kind).alias(c) for c, kind in (("cluster", "int"), ("distance", "decimal(38,0)"), ("cluster_inertia", "decimal(38,0)"), ("inertia", "decimal(38,0)"), ("centroid", "array<long>"), ("centroid_sha256", "string"))))
    start = [matrix_of(pa.array([bytes(r.key)], pa.binary()), length)[0].tolist() for r in first]
    found = lloyd(distinct, start, rounds)
    at = np.array(found, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, distance = nearest(matrix_of(batch.column("key"), length), at)
            yield pa.record_batch([batch.column("key"), batch.column("n"), pa.array(of.astype(np.int32)), decimals(distance)], names=["key", "n", "cluster", "distance"])

    assigned = stored(distinct.mapInArrow(run, "key binary, n long, cluster int, distance decimal(38,0)"), "assigned")
    weighed = F.try_multiply(F.col("distance"), F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)")
    sums = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.try_sum(weighed).alias("inertia"), F.sum("n").alias("n")).collect()}
    each = [sums[c].inertia if c in sums else 0 for c in range(len(found))]
    total = None if None in each else sum(each)
    long = lambda v: F.lit(None if v is None else str(v)).cast("decimal(38,0)")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    out = meet(rows, assigned, "key", sum(r.n for r in sums.values()))
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", of([long(v) for v in each]).alias("cluster_inertia"), long(total).alias("inertia"),
        of([F.array(*(F.lit(v).cast("long") for v in c)) for c in found]).alias("centroid"), of([F.lit(s) for s in shas]).alias("centroid_sha256"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and their sums are null where they do not fit a long."""
    long = {c: F.col(c).try_cast("bigint") for c in ("distance", "cluster_inertia", "inertia")}
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid").withColumns(long)


def _sql(clusters: int = 8, rounds: int = 10) -> str:
    """A pair of tables a round: the nearest centroid of each distinct vector, then the floors of weighted sums."""
    steps = ["""e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), d AS MATERIALIZED (SELECT v, count(*) AS n FROM e GROUP BY v),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) AS INTEGER) - 1 AS c, v FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT """ + str(clusters) + """)
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v, n, m.d AS distance, m.c AS cluster FROM (
    SELECT d.v, d.n, min(struct_pack(d := list_sum(list_transform(list_zip(d.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS m
    FROM d CROSS JOIN c{r} c GROUP BY d.v, d.n)
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(f.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(n * x) AS s, sum(n) AS n FROM (SELECT cluster, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster) f ON f.cluster = c.c
)""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT e.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM e JOIN a{rounds} a ON e.v = a.v JOIN c{rounds} c ON c.c = a.cluster
"""
    )


OP12_SQL = _sql()
