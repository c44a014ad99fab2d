"""Centroid clustering against plain rounds over all distances."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import yinyang


def plain(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance) in Python's whole numbers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, [max(-yinyang.LARGEST, min(yinyang.LARGEST, int(np.floor(1024 * float(np.float32(x)))))) for x in e]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), at


def made(n, seed, spread=1.0, dims=64):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims)) * spread
    return [(i, [float(np.float32(x)) for x in middles[i % 5] + rng.normal(size=dims) * 0.5]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize(("spread", "group_size"), [(0.0, 3), (0.3, 1), (1.5, 8)])
def test_clusters_are_those_of_plain_rounds(spark, spread, group_size):
    rows, rounds = made(150, 1, spread), 10 if group_size == 3 else 5
    expected, at = plain(rows, rounds=rounds)
    found = yinyang.cluster_vectors(spark, spark.createDataFrame(rows, SCHEMA), rounds=rounds, group_size=group_size)
    assert sorted((tuple(r) for r in found.rows.drop("v").collect()), key=str) == expected
    assert found.centroids == at


def test_edge_vectors(spark):
    rows = made(40, 2)
    rows += [(None, rows[1][1]), (None, None), (50, None), (51, []), (52, rows[0][1][:63]), (53, [*rows[0][1], 1.0]), (54, [None, *rows[0][1][1:]]), (55, [float("nan"), *rows[0][1][1:]]), (56, [float("-inf"), *rows[0][1][1:]]), (57, [1e38, -1e38, *rows[0][1][2:]]), rows[3], rows[3], (3, rows[4][1])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "cluster", "upper", "was", "distance")})
    expected, at = plain(rows)
    found = yinyang.cluster_vectors(spark, docs)
    assert sorted((tuple(r) for r in found.rows.drop("v").collect()), key=str) == expected and found.centroids == at
    total = yinyang.with_inertia(spark, found).collect()
    assert {r.inertia for r in total} == {sum(r[2] for r in expected)}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = made(n, 3)
    found = yinyang.cluster_vectors(spark, spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in found.rows.drop("v").collect()), key=str) == plain(rows)[0]
    assert yinyang.with_inertia(spark, found).count() == n


def test_equal_vectors_take_the_smaller_number(spark):
    rows = [(i, [0.5] * 64) for i in range(30)] + [(99, [0.25] * 64)]
    found = yinyang.cluster_vectors(spark, spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in found.rows.drop("v").collect()), key=str) == plain(rows)[0]


def test_filters_save_distances():
    """In later rounds most vectors need no scan; what they keep is what a scan gives."""
    rng = random.Random(4)
    v = np.array([[rng.randint(-40, 40) + (900 * (i % 6) if d < 8 else 0) for d in range(64)] for i in range(600)], np.int64)
    at = v[:6].copy()
    group = yinyang.grouped(at)
    own, upper, lower = np.full(600, -1), np.zeros(600), np.zeros((600, group.max() + 1))
    drift, scans = np.zeros(6), []
    for _ in range(4):
        own, upper, lower, computed = yinyang.assign(v, own, upper, lower, at, drift, group)
        full = ((v[:, None] - at[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all()
        scans.append(computed)
        new = np.array([v[own == c].sum(0) // (own == c).sum() for c in range(6)])
        drift, at = np.sqrt(((new - at) ** 2).sum(1).astype(float)), new
    assert scans[0] == 3600 and scans[-1] < 360
