"""Classifiers and penalised regressions fitted forward in time, against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import transform
from tidepanel.operators import walk_forward as wf

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]


def made(seed=1, codes=12):
    rng = np.random.default_rng(seed)
    rows = []
    for d in DAYS:
        for c in range(codes):
            a, b, noise, u = rng.normal(), rng.normal(), rng.normal(), rng.uniform(0.5, 2)
            rows.append((d, f"c{c}", float(a), float(b), float(0.8 * a - 0.3 * b + noise), float(0.8 * a - 0.3 * b + noise > 0), float(u)))
    return rows


SCHEMA = "date date, code string, a double, b double, y double, up double, w double"


def newton(x, y, w, steps, ridge):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        penalty = 2 * ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        beta = beta + np.linalg.solve((x.T * (w * p * (1 - p))) @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
    return beta


@pytest.mark.parametrize(("dates", "weight", "ridge"), [(None, None, 0.0), (3, "w", 0.5)])
def test_logistic_fits_are_newton_steps(spark, dates, weight, ridge):
    rows = made()
    df = spark.createDataFrame([*rows, (DAYS[2], "x", None, 1.0, 1.0, 1.0, 1.0), (DAYS[9], "y", 1.0, 1.0, None, None, 1.0)], SCHEMA)
    policy = wf.Policy(every=3, first=3, embargo=2, dates=dates)
    fits = {r.date: r for r in wf.logistic_fits(df, ["a", "b"], "up", policy, 4, ridge, weight).collect()}
    assert sorted(fits) == [DAYS[3], DAYS[6], DAYS[9]] and [fits[d].until for d in sorted(fits)] == [DAYS[5], DAYS[8], DAYS[9]]
    for i in (3, 6, 9):
        use = [r for r in rows if DAYS[0 if dates is None else max(0, i - 2 - dates + 1)] <= r[0] <= DAYS[i - 2]]
        x, y, w = np.array([[1, r[2], r[3]] for r in use]), np.array([r[5] for r in use]), np.array([r[6] if weight else 1.0 for r in use])
        assert fits[DAYS[i]].n == len(use) and fits[DAYS[i]].beta == pytest.approx(newton(x, y, w, 4, ridge).tolist())
    scored = wf.logistic_scores(df, ["a", "b"], wf.logistic_fits(df, ["a", "b"], "up", policy, 4, ridge, weight))
    assert scored.filter(F.col("date") < DAYS[3]).count() == 0
    one = scored.filter((F.col("date") == DAYS[7]) & (F.col("code") == "c4")).first()
    assert one.probability == pytest.approx(1 / (1 + np.exp(-np.dot(fits[DAYS[6]].beta, [1, one.a, one.b]))))


def test_fits_without_rows_or_spread_are_null(spark):
    policy = wf.Policy(every=4, first=1)
    same = spark.createDataFrame([(d, "c", 2.0, 1.0, 0.0, float(i % 2), 1.0) for i, d in enumerate(DAYS)], SCHEMA)
    assert {r.beta for r in wf.logistic_fits(same, ["a", "b"], "up", policy).collect()} == {None}
    assert wf.logistic_scores(same, ["a"], wf.logistic_fits(same, ["a"], "up", policy)).filter("probability is not null").count() == 0
    none = same.filter("a > 9")
    assert wf.logistic_fits(none, ["a"], "up", policy).count() == 0 and wf.elastic_net_path(none, ["a"], "y", 0.1).count() == 0


@pytest.mark.parametrize(("penalty", "mix"), [(0.0, 1.0), (0.15, 1.0), (0.2, 0.4)])
def test_elastic_net_meets_the_conditions_of_the_optimum(spark, penalty, mix):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("flat", F.lit(3.0))
    names = ["a", "b", "flat", "w"]
    path = {r.date: r for r in wf.elastic_net_path(df, names, "y", penalty, mix, embargo=1, dates=4, sweeps=80).collect()}
    assert path[DAYS[0]].beta is None and path[DAYS[0]].n == 0
    for i in range(1, 10):
        use = [r for r in rows if DAYS[max(0, i - 4)] <= r[0] <= DAYS[i - 1]]
        x, y = np.array([[r[2], r[3], 3.0, r[6]] for r in use]), np.array([r[4] for r in use])
        beta = np.array(path[DAYS[i]].beta)
        left = y - beta[0] - x @ beta[1:]
        assert left.mean() == pytest.approx(0, abs=1e-9)
        pull = (x - x.mean(0)).T @ left / len(y) - penalty * (1 - mix) * beta[1:]
        for g, b in zip(pull, beta[1:], strict=True):
            assert abs(g) <= penalty * mix + 1e-7 and (b == 0 or g == pytest.approx(np.sign(b) * penalty * mix, abs=1e-7))
        assert beta[3] == 0
    if penalty == 0.15:
        assert any(r.beta and r.beta[4] == 0 for r in path.values())


def test_votes_and_ndcg(spark):
    df = spark.createDataFrame([(DAYS[0], "a", 0.9, 0.2, 3.0), (DAYS[0], "b", 0.6, None, 1.0), (DAYS[0], "c", None, None, 2.0)], "date date, code string, p double, q double, g double")
    assert [r.vote for r in wf.votes(df, ["p", "q"]).orderBy("code").collect()] == [0.5, 1.0, None]
    got = wf.ndcg(df.fillna({"p": 0.7}), "p", "g").first()
    best = 3 + 2 / np.log2(3) + 1 / 2
    assert got.n == 3 and got.ndcg == pytest.approx((3 + 2 / np.log2(3) + 1 / 2) / best)
    worst = wf.ndcg(df.fillna({"p": 0.1}), "p", "g", 2).first()
    assert worst.ndcg == pytest.approx((3 + 1 / np.log2(3)) / (3 + 2 / np.log2(3)))


def test_quantile_edges_that_are_rows(spark):
    """Four values: the edges of thirds are the second and the third; equal edges count once; a null has no bucket."""
    rows = [(DAYS[0], c, v) for c, v in zip("abcde", [1.0, 2.0, 3.0, 4.0, None], strict=True)] + [(DAYS[1], c, v) for c, v in zip("abcd", [5.0, 5.0, 5.0, 6.0], strict=True)]
    got = {(r.date, r.code): r.quantile for r in transform.quantize(spark.createDataFrame(rows, "date date, code string, value double"), 3).collect()}
    assert [got[DAYS[0], c] for c in "abcde"] == [1, 1, 2, 3, None]
    assert [got[DAYS[1], c] for c in "abcd"] == [1, 1, 1, 2]
