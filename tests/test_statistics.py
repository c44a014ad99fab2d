"""Significance, regressions on quantiles, and labels of rules, against closed forms and small cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expr as x
from tidepanel.functions.statistics import incomplete_beta, log_gamma, student_p
from tidepanel.operators import labels, report

DAYS = [dt.date(2024, 1, d) for d in range(1, 13)]


def test_log_gamma_and_incomplete_beta(spark):
    values = [0.5, 1.0, 1.5, 3.7, 12.0, 250.5, 1e5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(log_gamma(F.col("v"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-11)
    rows = [(q, a, b) for q in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0) for a, b in ((1.0, 1.0), (2.0, 3.0), (5.0, 2.0))]
    got = [r[0] for r in spark.createDataFrame(rows, "q double, a double, b double").select(incomplete_beta(F.col("q"), F.col("a"), F.col("b"))).collect()]
    # Of whole parameters it is the chance of at least a successes among a + b - 1.
    whole = lambda q, a, b: sum(math.comb(int(a + b) - 1, j) * q**j * (1 - q) ** (int(a + b) - 1 - j) for j in range(int(a), int(a + b)))
    assert got == pytest.approx([whole(*r) for r in rows], abs=1e-12)


def test_p_values_of_known_degrees(spark):
    rows = [(t, v) for t in (0.0, 0.5, -1.3, 2.0, 12.0) for v in (1, 2, 4000)] + [(1.0, 0), (None, 5)]
    got = {(r.t, r.v): r.p for r in spark.createDataFrame(rows, "t double, v long").withColumn("p", student_p(F.col("t"), F.col("v"))).collect()}
    for t in (0.0, 0.5, -1.3, 2.0, 12.0):
        assert got[t, 1] == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-10)
        assert got[t, 2] == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), abs=1e-10)
        assert got[t, 4000] == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), abs=1e-3)
    assert got[1.0, 0] is None and got[None, 5] is None


@pytest.mark.parametrize("q", [0.5, 0.25])
def test_quantile_regression_is_the_best_line_through_two_points(spark, q):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=41), None
    b = 2 - 1.5 * a + rng.standard_t(2, size=41)
    loss = lambda c, m: np.where((r := b - c - m * a) >= 0, q * r, (q - 1) * r).sum()
    best = min(loss(b[i] - m * a[i], m) for i in range(41) for j in range(i) for m in [(b[i] - b[j]) / (a[i] - a[j])])
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(a, b, strict=True)] + [(None, 1.0), (1.0, None)], "a double, b double")
    found = report.quantile_regression_report(df, "b", "a", q).first()
    assert found.n == 41 and loss(found.intercept, found.slope) == pytest.approx(best, rel=1e-3)
    assert 0.05 < found.std_error < 1 and found.t == pytest.approx(found.slope / found.std_error) and 0 <= found.p < 0.05
    none = report.quantile_regression_report(df.filter("a > 99"), "b", "a", q).first()
    assert none.n == 0 and none.p is None


def test_a_rule_earns_after_its_signal(spark):
    close = [10.0, 11.0, 12.0, 13.0, 12.0, 9.0, 9.0, 10.0, 12.0]
    df = spark.createDataFrame([(d, "a", v) for d, v in zip(DAYS, close, strict=False)], "date date, code string, close double")
    got = {r.date: (r.label, r.label_end) for r in labels.double_mean_returns(df, 1, 2, 2).collect()}
    # The rule is up on the 2nd to the 4th, the 7th and later, so it earns on the 3rd to the 5th, and from the 8th on.
    assert sorted(got) == [DAYS[2], DAYS[3], DAYS[4], DAYS[7], DAYS[8]]
    assert got[DAYS[2]] == (pytest.approx(13 / 12 - 1 + 12 / 13 - 1), DAYS[4]) and got[DAYS[4]][0] == pytest.approx(10 / 9 - 1 + 12 / 10 - 1) and got[DAYS[7]] == (None, None)


def test_sharpe_of_the_bars_ahead(spark):
    close = {"a": [10.0, 11.0, 10.0, 12.0], "b": [10.0, 9.0, 9.5, 9.0], "c": [1.0, 1.0, 1.0, 1.0]}
    df = spark.createDataFrame([(d, k, v) for k, row in close.items() for d, v in zip(DAYS, row, strict=False)], "date date, code string, close double")
    got = {(r.date, r.code): r for r in labels.intraday_sharpe(df, 2, 1).collect()}
    one = lambda p: (lambda r: r.mean() / r.std(ddof=1))(np.diff(p) / np.array(p[:-1]))
    s = np.array([one(close[k][:3]) for k in "ab"])
    assert got[DAYS[0], "a"].label == pytest.approx((s[0] - s.mean()) / s.std(ddof=1), abs=1e-4) and got[DAYS[0], "a"].label_end == DAYS[1]
    assert (DAYS[0], "c") not in got and got[DAYS[1], "b"].label_end is None


def test_variance_of_falls_is_that_of_rises_turned_over(spark):
    df = spark.createDataFrame([(d, "a", v) for d, v in zip(DAYS, [1.0, -2.0, 3.0, -4.0], strict=False)], "date date, code string, v double")
    rows = x.with_factors(df, {"up": x.positive_variance(x.col("v"), 4), "down": x.negative_variance(x.col("v"), 4)}).orderBy("date").collect()
    assert rows[3].up == pytest.approx(2 * 1.0 / 4) and rows[3].down == pytest.approx(2 * 1.0 / 4) and rows[2].down == 0.0


def test_report_of_a_factor_has_its_tables(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(d, f"c{i}", float(v), float(v + e)) for d in DAYS[:4] for i, (v, e) in enumerate(rng.normal(size=(20, 2)))], "date date, code string, value double, label double")
    tables = report.single_factor_report(df, 5)
    got = {k: t.collect() for k, t in tables.items()}
    assert set(got) == {"summary", "ic", "ic_summary", "quantiles", "turnover"} and len(got["ic"]) == 4 and len(got["quantiles"]) == 5
    assert got["ic"][0].ic > 0.4 and got["ic_summary"][0].mean == pytest.approx(np.mean([r.ic for r in got["ic"]]))
