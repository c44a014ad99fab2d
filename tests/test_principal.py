"""Principal components and orthogonal factors against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import principal

DAYS = [dt.date(2024, 1, d) for d in range(1, 5)]


def made(k, seed=1, n=30):
    rng = np.random.default_rng(seed)
    return {d: rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) * 10.0 ** rng.integers(-2, 3, k) for d in DAYS}


def frame(spark, data, k):
    rows = [(d, f"c{i}", *map(float, row)) for d, m in data.items() for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "date date, code string, " + ", ".join(f"f{i} double" for i in range(k)))


def signed(vectors):
    lead = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1, 1)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_components_are_those_of_numpy(spark, k):
    data = made(k)
    names = [f"f{i}" for i in range(k)]
    df = frame(spark, data, k)
    found = {r.date: r for r in principal.components(df, names).collect()}
    scores = {(r.date, r.code): r for r in principal.principal_components(df, names, k).collect()}
    for d, m in data.items():
        value, vector = np.linalg.eigh(np.atleast_2d(np.cov(m.T)))
        value, vector = value[::-1], signed(vector[:, ::-1])
        assert [p.value for p in found[d].pairs] == pytest.approx(value.tolist(), rel=1e-6, abs=value[0] * 1e-12)
        for j in range(k):
            assert found[d].pairs[j].vector == pytest.approx(vector[:, j].tolist(), abs=1e-6)
        expected = (m - m.mean(0)) @ vector
        for i in range(len(m)):
            assert [scores[d, f"c{i}"][f"pc_{j + 1}"] for j in range(k)] == pytest.approx(expected[i].tolist(), abs=1e-5 * abs(expected).max())


def test_share_of_variance_decides_how_many_stay(spark):
    data = made(4, 2)
    df = frame(spark, data, 4)
    got = principal.principal_components(df, ["f0", "f1", "f2", "f3"], 0.8)
    kept = {r.date: [r[f"pc_{j}"] is not None for j in range(1, 5)] for r in got.collect()}
    for d, m in data.items():
        value = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
        n = int(np.searchsorted(np.cumsum(value) / value.sum(), 0.8, "right")) + 1
        assert kept[d] == [j < n for j in range(4)]


def test_orthogonal_factors_are_uncorrelated_and_nearest(spark):
    data = made(3, 3)
    df = frame(spark, data, 3).withColumn("f2", F.when(F.col("code") != "c7", F.col("f2")))
    got = principal.orthogonal(df, ["f0", "f1", "f2"]).collect()
    assert all(r.f0_orth is None for r in got if r.code == "c7")
    for d, m in data.items():
        rest = np.delete(m, 7, 0)
        at = {r.code: [r.f0_orth, r.f1_orth, r.f2_orth] for r in got if r.date == d}
        u = np.array([at[f"c{i}"] for i in range(len(m)) if i != 7])
        assert np.cov(u.T) == pytest.approx(np.eye(3), abs=1e-7)
        value, vector = np.linalg.eigh(np.cov(rest.T))
        assert u == pytest.approx((rest - rest.mean(0)) @ vector @ np.diag(value**-0.5) @ vector.T, abs=1e-5)


def test_singular_and_small_groups(spark):
    rows = [(DAYS[0], f"c{i}", float(i), 2.0 * i) for i in range(5)] + [(DAYS[1], "a", 1.0, 2.0), (DAYS[2], "a", None, 1.0)] + [(DAYS[3], c, 4.0, 4.0) for c in "ab"]
    df = spark.createDataFrame(rows, "date date, code string, f0 double, f1 double")
    assert {r.f0_orth for r in principal.orthogonal(df, ["f0", "f1"]).collect()} == {None}
    got = principal.principal_components(df, ["f0", "f1"], 2).collect()
    assert [r.pc_1 for r in got if r.date in DAYS[1:3]] == [None, None] and {r.pc_1 for r in got if r.date == DAYS[3]} == {0.0}
    assert sorted(round(r.pc_1, 6) for r in got if r.date == DAYS[0]) == [round(5**0.5 * i, 6) for i in range(-2, 3)]
    assert principal.principal_components(df.limit(0), ["f0", "f1"]).count() == 0
