"""Models, bounded weights, forecasts, intraday features and the backtest, by hand-worked values or numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expr as x
from tidepanel.operators import bounded, evaluate, forecasts, intraday, joins, models, report, transform
from tidepanel.operators.backtest import backtest
from tidepanel.plans import genetic

DAYS = [dt.date(2024, 1, d) for d in range(1, 9)]


def test_walk_forward_sees_only_dates_before(spark):
    rng = np.random.default_rng(3)
    rows = [(d, f"c{k}", float(a), float(b), float(1 + 2 * a - b + e)) for d in DAYS for k, (a, b, e) in enumerate(rng.normal(size=(6, 3)))]
    df = spark.createDataFrame(rows, "date date, code string, a double, b double, y double")
    fits = {r.date: r for r in models.walk_forward_fit(df, ["a", "b"], "y", embargo=2, dates=3).collect()}
    assert fits[DAYS[0]].beta is None and fits[DAYS[1]].n == 0
    for i in range(2, len(DAYS)):
        use = [r for r in rows if DAYS[max(0, i - 4)] <= r[0] <= DAYS[i - 2]]
        m = np.array([[1.0, r[2], r[3]] for r in use])
        assert fits[DAYS[i]].n == len(use)
        assert fits[DAYS[i]].beta == pytest.approx(np.linalg.lstsq(m, np.array([r[4] for r in use]), rcond=None)[0].tolist())
    got = models.walk_forward_predict(df, ["a", "b"], "y", embargo=2, dates=3).filter(F.col("date") == DAYS[5]).orderBy("code").first()
    assert got.prediction == pytest.approx(np.dot(fits[DAYS[5]].beta, [1, got.a, got.b]))


def test_singular_fit_is_null(spark):
    df = spark.createDataFrame([(d, "c", 2.0, float(i)) for i, d in enumerate(DAYS)], "date date, code string, a double, y double")
    assert {r.beta for r in models.walk_forward_fit(df, ["a"], "y").collect()} == {None}


def test_greedy_weights_reach_the_best_of_random_ones(spark):
    score, bench, tilt = [3.0, -1.0, 2.0, None, 0.5], [0.3, 0.3, 0.2, 0.15, 0.05], 0.1
    df = spark.createDataFrame([(DAYS[0], f"c{i}", s, b) for i, (s, b) in enumerate(zip(score, bench, strict=True))], "date date, code string, value double, b double")
    w = np.array([r.weight for r in bounded.enhanced_weights(df, "value", "b", tilt).orderBy("code").collect()])
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and (abs(w - bench) <= tilt + 1e-12).all()
    a = np.array([-9.0 if s is None else s for s in score])
    rng = np.random.default_rng(0)
    for _ in range(500):
        other = np.clip(np.array(bench) + rng.uniform(-tilt, tilt, 5), 0, None)
        if abs(other.sum() - 1) < 0.01:
            assert a @ w >= a @ other - 0.1
    assert w == pytest.approx([0.4, 0.2, 0.3, 0.05, 0.05])


def test_newest_report_of_each_institution_counts_for_its_months(spark):
    at = lambda m, d: dt.datetime(2024, m, d)
    rows = [("c", "x", at(1, 5), 10.0), ("c", "x", at(1, 20), 14.0), ("c", "y", at(2, 3), 20.0), ("c", "y", None, 9.0)]
    df = spark.createDataFrame(rows, "code string, institution string, pub_date timestamp, value double")
    got = {r.date: (r["mean"], r.n) for r in forecasts.consensus(df, 2).collect()}
    assert got == {dt.date(2024, 2, 1): (14.0, 1), dt.date(2024, 3, 1): (17.0, 2), dt.date(2024, 4, 1): (20.0, 1)}


def test_smart_slots_are_those_that_move_most_for_their_volume(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=h), "c", p, v, k) for k, (h, p, v) in enumerate([(9, 10.0, 10), (9, 12.0, 10), (10, 12.0, 40), (10, 12.0, 40), (11, 12.0, 10)])]
    s = intraday.slots(spark.createDataFrame(rows, "ts timestamp, code string, price double, volume int, key int"))
    q = intraday.smart_money(s, 0.2).first().q
    assert q == pytest.approx(11.0 / ((100 + 120 + 960 + 120) / 110))


def test_mean_shift_finds_the_step(spark):
    df = spark.createDataFrame([(d, "c", v) for d, v in zip(DAYS, [1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0], strict=True)], "date date, code string, value double")
    got = transform.mean_shift(df, 8).orderBy("date").collect()
    assert got[-1].age == 3 and got[0].age is None
    assert got[-1].strength == pytest.approx(7.5 / (np.std([1] * 5 + [5] * 3) * np.sqrt(8)))


BARS = [(DAYS[0], "a", 10.0, True), (DAYS[0], "b", 20.0, True), (DAYS[1], "a", 11.0, True), (DAYS[1], "b", 20.0, False), (DAYS[2], "a", 11.0, True), (DAYS[2], "b", 15.0, True), (DAYS[3], "a", 5.0, True), (DAYS[3], "b", None, True)]


def test_backtest_pays_fees_and_keeps_what_cannot_trade(spark):
    bars = spark.createDataFrame(BARS, "date date, code string, close double, tradable boolean")
    targets = spark.createDataFrame([("s", DAYS[0], "a", 0.5), ("s", DAYS[0], "b", 0.5), ("s", DAYS[1], "a", 1.0)], "strategy string, date date, code string, weight double")
    got = backtest(targets, bars, cash=1000.0, buy_fee=0.0, sell_fee=0.01, stop=0.5).orderBy("date").collect()
    assert (got[0].cash, got[0].holdings, got[0].n_held) == (0.0, 1000.0, 2)
    # All is wanted in a; b cannot be sold and no cash is left to buy a.
    assert (got[1].cash, got[1].nav, got[1].n_unfilled) == (0.0, 1050.0, 1)
    assert (got[2].holdings, got[2].n_held) == (50 * 11.0 + 25 * 15.0, 2)
    # a has lost half: sold with a fee of one hundredth; b has no price and stays at its last.
    assert got[3].fee == pytest.approx(2.5) and got[3].cash == pytest.approx(247.5) and got[3].holdings == 375.0


def test_backtest_buys_whole_shares_within_its_cash(spark):
    bars = spark.createDataFrame([(DAYS[0], "a", 300.0, None)], "date date, code string, close double, tradable boolean")
    targets = spark.createDataFrame([("s", DAYS[0], "a", 2.0), ("s", DAYS[0], "z", 1.0)], "strategy string, date date, code string, weight double")
    got = backtest(targets, bars, cash=1000.0, buy_fee=0.0002).first()
    assert got.n_held == 1 and got.cash == pytest.approx(1000 - 900 * 1.0002)


def test_rounds_end_at_no_position(spark):
    rows = [("c", 1, 0, 2, 10.0), ("c", 2, 0, -2, 12.0), ("c", 3, 0, 1, 5.0)]
    got = evaluate.trade_rounds(spark.createDataFrame(rows, "code string, ts int, key int, shares int, price double")).orderBy("round").collect()
    assert [(r["round"], r.trades, r.profit) for r in got] == [(1, 2, 4.0), (2, 1, None)]


def test_forward_path(spark):
    df = spark.createDataFrame([(d, "c", v) for d, v in zip(DAYS, [10.0, 12.0, 6.0, 9.0], strict=False)], "date date, code string, close double")
    got = evaluate.forward_path(df, 3).orderBy("date").collect()
    assert (got[0].ret, got[0].drawdown, got[0].calmar) == (pytest.approx(-0.1), -0.5, pytest.approx(-0.2)) and got[1].ret is None


def test_rebased_prices_keep_the_last_row(spark):
    df = spark.createDataFrame([(d, "c", v) for d, v in zip(DAYS, [10.0, 5.0, 6.0], strict=False)], "date date, code string, close double")
    changes = spark.createDataFrame([("c", DAYS[1], 2.0)], "code string, date date, factor double")
    assert [r.close for r in joins.rebased(df, changes, ["close"]).orderBy("date").collect()] == [5.0, 5.0, 6.0]


def test_slice_features(spark):
    rows = [(DAYS[0], "a", i, float(p), float(q)) for i, (p, q) in enumerate([(5, 1), (1, 4), (9, 2), (7, 8), (3, 6)])] + [(DAYS[1], "a", 0, 2.0, None)]
    df = spark.createDataFrame(rows, "date date, code string, i int, price double, swap double")
    names = {"avg": ("all", "swap"), "open_avg": ("open", "swap"), "intra_avg": ("intra", "swap"), "close_std": ("close", "swap"), "high_avg": ("high", "swap"), "low_avg": ("low", "swap")}
    got = report.slice_features(df, ["date", "code"], ["i"], "price", 2, names).orderBy("date").collect()
    assert got[0][2:] == pytest.approx((4.2, 2.5, 2.0, 2**0.5, 11 / 3, 5.0))
    assert got[1][2:] == (None,) * 6


def test_genetic_factors_by_numpy(spark):
    rng = np.random.default_rng(5)
    names = [*genetic.FEATURES, "corrpriceswap"]
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(16)]
    v = {n: rng.normal(size=16) for n in names}
    df = spark.createDataFrame([(d, "a", *(float(v[n][k]) for n in names)) for k, d in enumerate(days)], "date date, code string, " + ", ".join(f"{n} double" for n in names))
    got = {r.date: r for r in x.with_factors(df, genetic.on_slices()).collect()}
    late, late_std, k = v["close_retavg"], v["close_swapstd"], 12
    last = lambda a, d: a[k - d + 1 : k + 1]
    row = got[days[k]]
    assert row.genetic_slices_1 == pytest.approx(last(late_std, 3).max() ** 3 + v["corrpriceswap"][k] * last(late, 3).mean())
    assert row.genetic_slices_2 == pytest.approx(last(late_std, 3).mean() * last(v["corrpriceswap"], 3).max() + late[k] - last(v["open_retavg"], 3).min())
    assert row.genetic_slices_3 == pytest.approx(last(late, 3).mean() * last(late, 3).max() * last(v["swapstd"], 5).mean() ** 3)
    assert row.genetic_slices_5 == pytest.approx((last(v["high_retstd"], 3).mean() ** 3 + late[k] + last(late_std, 3).max()) ** 3)
    norm = lambda d: (late[k] - last(late, d).min()) / np.ptp(last(late, d))
    assert row.genetic_slices_7 == pytest.approx(last(v["high_swapstd"], 3).max() ** 3 + norm(3) ** (1 / 3))
    assert row.genetic_slices_8 == pytest.approx(last(v["high_swapavg"], 3).max() * last(late_std, 3).max() * v["high_swapstd"][k] * norm(10))
    assert row.genetic_slices_2_mean == pytest.approx(np.mean([got[days[j]].genetic_slices_2 for j in range(k - 4, k + 1)]))
    assert got[days[3]].genetic_slices_3 is None and got[days[5]].genetic_slices_2_mean is None


def test_reports_meet_before_they_are_dealt_to_months(spark):
    rows = [("a", "i", dt.datetime(2024, 1, 5), 1.0), ("a", "i", dt.datetime(2024, 1, 9), 2.0), ("a", "j", dt.datetime(2024, 2, 1), 4.0), ("a", "i", dt.datetime(2024, 4, 1), 8.0)]
    df = forecasts.consensus(spark.createDataFrame(rows, "code string, institution string, pub_date timestamp, value double"), 2)
    got = {(r.date.month, r["mean"], r.n) for r in df.collect()}
    assert got == {(2, 2.0, 1), (3, 3.0, 2), (4, 4.0, 1), (5, 8.0, 1), (6, 8.0, 1)}
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
