"""Whitening, centroid clustering and sharding against brute force, on nulls, ties, repeats, odd lengths and empty tables."""

import collections
import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroid_clustering, sharding, whitening
from tidemark.llm.quantised import LIMIT, meet, quantised, totals


def vectors(seed=0, n=300, dim=64):
    rng = np.random.default_rng(seed)
    base = (rng.normal(0, 0.2, (n, dim)) * np.linspace(0.2, 1, dim)).tolist()
    rows = list(enumerate(base))
    rows += [(n + i, base[i % 3]) for i in range(n)]  # a third of all rows have one of three vectors
    bad = [None, [], [None] * dim, [0.1] * (dim - 1) + [math.nan], [math.inf] + [0.0] * (dim - 1)]
    rows += [(2 * n + i, v) for i, v in enumerate(bad)]
    return [*rows, (None, base[5]), (7, base[7]), (7, base[8]), (7, base[7])]


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("id", "key", "n", "dim", "cluster", "component", "v")})


def good(rows, dim):
    return [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def whitened(rows, dim, k, scale=256):
    rows = good(rows, dim)
    x = np.floor(scale * np.array([v for _, v in rows])).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return rows, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening(spark):
    rows = vectors()
    kept, n, deviation, white, explained = whitened(rows, 64, 4)
    got = whitening.whiten(table_of(spark, rows)).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in got)
    for k in range(4):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == k + 1)
        for sign in (1, -1):
            true = sorted((i is None, i or 0, int(d), sign * w) for (i, _), d, w in zip(kept, deviation, white[:, k], strict=True))
            if np.allclose([m[3] for m in mine], [t[3] for t in true], atol=1e-9):
                break
        else:
            pytest.fail(f"component {k + 1}")
        assert [m[:3] for m in mine] == [t[:3] for t in true]


def test_whitening_of_few_equal_and_mixed_vectors(spark):
    assert whitening.whiten(table_of(spark, [])).collect() == []
    assert whitening.whiten(table_of(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    two = whitening.whiten(table_of(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [5.0]), (5, [7.0])])).collect()
    found = {(r.vec_id, r.component): round(abs(r.whitened), 9) for r in two}  # a line: one component; each length on its own
    assert found == dict.fromkeys([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)], 1.0)
    huge = whitening.whiten(table_of(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {(r.vec_id, int(r.deviation)) for r in huge if r.component == 1} == {(1, 9 * LIMIT**2 + 9 * 256**2), (2, 9 * LIMIT**2), (3, 9 * 256**2)}


@pytest.mark.parametrize("dim,n", [(64, 200), (5, 40), (150, 900), (20, 8)])
def test_lobpcg_finds_the_largest_eigenvectors(dim, n):
    x = np.random.default_rng(dim).normal(size=(n, dim))
    a = x.T @ x / n
    e, u, residual = whitening.lobpcg(lambda b: a @ b, dim, 4)
    true, vectors_ = np.linalg.eigh(a)
    assert residual < 1e-12 and np.allclose(e, true[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs((u * vectors_[:, ::-1][:, :4]).sum(0)), 1, atol=1e-12)


def test_lobpcg_of_equal_eigenvalues_and_nothing():
    e, u, residual = whitening.lobpcg(lambda b: 2 * b, 30, 4)
    assert np.allclose(e, 2) and np.allclose(u.T @ u, np.eye(4)) and residual < 1e-14
    assert not whitening.lobpcg(lambda b: 0 * b, 30, 4)[0].any()


def clustered(rows, k, rounds, dim=64):
    rows = [(i, [math.floor(1024 * c) for c in v]) for i, v in good(rows, dim)]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in rows:
            groups[near(v)[1]].append(v)
        at = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(at)]
    found = [(i, *near(v)) for i, v in rows]
    sums = collections.Counter()
    for _, d, j in found:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return collections.Counter((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, d, j in found)


@pytest.mark.parametrize("n,k", [(100, 8), (2, 8), (40, 3)])
def test_centroid_clustering(spark, n, k):
    rows = vectors(seed=n, n=n) if n > 10 else good(vectors(n=10), 64)[:n] * 3
    got = centroid_clustering.cluster(table_of(spark, rows), clusters=k).drop("centroid").collect()
    assert collections.Counter((r[0], *r[1:2], *map(int, r[2:5]), r[5]) for r in got) == clustered(rows, k, 10)


def test_centroid_clustering_of_nothing_and_of_huge_numbers(spark):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    empty = centroid_clustering.cluster(table_of(spark, [(1, [1.0]), (2, None)]))
    assert empty.columns == names and empty.collect() == []
    far = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [1e9, 3.0]), (4, [1e300, 0.0])]
    got = centroid_clustering.cluster(table_of(spark, far), clusters=2, length=2)
    true = clustered([(i, [min(c, LIMIT / 1024) for c in v]) for i, v in far], 2, 10, dim=2)
    assert collections.Counter((r[0], r[1], *map(int, r[2:5]), r[6]) for r in got.collect()) == true


def test_hot_groups_meet_by_broadcast_and_others_by_shuffle(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), (F.max("key") + 1).alias("more"))
    got = meet(rows, groups, "key", 5000)
    assert got.count() == 5000 and got.where("more <> key + 1").count() == 0 and got.select("id").distinct().count() == 5000


def test_exact_sums(spark):
    rows = quantised(spark.createDataFrame([(i, [1e12, -1.0]) for i in range(1000)], "id long, v array<double>"), 1000, "id", "v")
    part = lambda b: np.array([10**15 * b.num_rows, -b.num_rows], object) * 10**9
    assert totals(rows, 2, part, exact=True).tolist() == [10**27, -(10**12)]


def by_heap(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], collections.Counter()
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        out[s] += size
        heapq.heappush(heap, (load + size, s))
    return {s: out[s] for s in range(shards)}


def test_spread_is_what_a_heap_does_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        loads = [rng.randint(0, 60) for _ in range(rng.randint(1, 7))]
        size, count = rng.randint(1, 20), rng.randint(0, 60)
        heap, true = [(x, s) for s, x in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heapq.heappop(heap)
            true[s] += 1
            heapq.heappush(heap, (load + size, s))
        assert sharding.spread(loads, size, count) == true


@pytest.mark.parametrize("shards", [1, 16])
def test_sharding(spark, shards):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aéb ") for _ in range(rng.choice([3, 20, 21, 22, 300]))) for _ in range(700)]
    rows = list(enumerate([*texts, *["copy"] * 400, None, "", None, "long " * 40000])) + [(3, texts[3]), (3, texts[3]), (None, "copy"), (None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "size", "key", "shard", "n", "row", "bytes", "crc")})
    got = sharding.shard(docs.repartition(7), shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    groups, loads, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for _, t in rows:
        groups[t or ""] += size(t)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id is None, r.doc_id or 0))
    assert {s: loads[s] for s in range(shards)} == by_heap(groups.values(), shards)
    assert len({(r.size, r.text_crc32, r.shard) for r in got}) == len(groups)
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s))) and [x[1:] for x in s] == sorted(x[1:] for x in s)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_sharding_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
