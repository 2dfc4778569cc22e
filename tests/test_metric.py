"""Neighbours by cells against all pairs."""

import numpy as np
import pytest

from passagelake.operators import metric, retrieve

VECTORS = "chunk_pos long, embedding array<double>"


def frame(spark, v, name="chunk_pos"):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], f"{name} long, embedding array<double>")


def brute(queries, vectors, k):
    out = []
    for i, q in enumerate(queries):
        d = np.round(((vectors - q) ** 2).sum(1), 9)
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k], 1):
            out.append((i, int(j), float(d[j]), rank))
    return out


def clustered(rng, n, dims):
    return (rng.normal(size=(12, dims)) * 6)[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("seed,n,nq,dims,k,pivots", [(0, 400, 60, 8, 5, 16), (1, 300, 40, 3, 10, 64), (2, 50, 20, 4, 7, 50), (3, 30, 10, 2, 40, 4), (4, 500, 30, 16, 3, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, n, nq, dims, k, pivots):
    monkeypatch.setattr(metric, "PART", 16)
    rng = np.random.default_rng(seed)
    v, q = clustered(rng, n, dims), clustered(rng, nq, dims)
    v[:20] = v[20]  # a common vector
    q[:5] = v[20]
    found, pairs = metric.knn_by_cells(frame(spark, q, "q_id"), frame(spark, v), k, pivots)
    assert sorted((r["q_id"], r["chunk_pos"], round(r["dist"], 9), r["rank"]) for r in found.collect()) == sorted(brute(q, v, k))
    counted = {r["q_id"]: r["pairs"] for r in pairs.collect()}
    assert set(counted) == set(range(nq)) and max(counted.values()) <= n


def test_most_pairs_are_not_compared(spark):
    rng = np.random.default_rng(9)
    v = clustered(rng, 3000, 8)
    q = v[:200] + 0.01
    found, pairs = metric.knn_by_cells(frame(spark, q, "q_id"), frame(spark, v), 5, 48)
    assert sorted((r["q_id"], r["chunk_pos"], r["rank"]) for r in found.collect()) == sorted((a, b, r) for a, b, _, r in brute(q, v, 5))
    assert sum(r["pairs"] for r in pairs.collect()) < 0.25 * 200 * 3000


def test_cells_hold_their_bounds():
    rng = np.random.default_rng(5)
    v, q = clustered(rng, 500, 6), clustered(rng, 50, 6)
    centres = v[:20]
    d = np.sqrt(metric.squared(v, centres))
    own, gap = d.argmin(1), d.min(1)
    cell = lambda f, empty: np.array([f(gap[own == c]) if (own == c).any() else empty for c in range(20)])
    known = metric.Partition(centres, np.bincount(own, minlength=20), cell(np.min, 0.0), cell(np.max, 0.0))
    _, begins, sure = known.bounds(q, 9)
    true = np.sqrt(metric.squared(q, v))
    for c in range(20):
        if (own == c).any():
            assert (begins[:, c] <= true[:, own == c].min(1) + 1e-9).all()
    assert (np.sort(true, 1)[:, 8] <= sure + 1e-9).all()


def test_empty_sides(spark):
    one = frame(spark, np.ones((3, 2)))
    none = spark.createDataFrame([], VECTORS)
    assert metric.knn_by_cells(frame(spark, np.ones((2, 2)), "q_id"), none, 3)[0].count() == 0
    assert metric.knn_by_cells(none.withColumnRenamed("chunk_pos", "q_id"), one, 3)[0].count() == 0


def test_many_queries_stay_a_table(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, q = clustered(rng, 90, 4), clustered(rng, 40, 4)
    plain = sorted(map(tuple, retrieve.dense_topk(frame(spark, q, "q_id"), frame(spark, v), 4).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 8)
    assert sorted(map(tuple, retrieve.dense_topk(frame(spark, q, "q_id"), frame(spark, v), 4).collect())) == plain
