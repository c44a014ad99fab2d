"""Operators on small panels, against values worked out by hand or in numpy."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest

from tidepanel.functions import expr as x
from tidepanel.operators import evaluate, joins, statements, transform
from tidepanel.plans import cycles
from tidepanel.sources import panels

DAYS = [dt.date(2024, 1, d) for d in range(1, 9)]


def one_code(spark, values):
    return spark.createDataFrame([(d, "a", v) for d, v in zip(DAYS, values, strict=False)], "date date, code string, close double")


def long_code(spark, values):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), "a", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, code string, close double")


def values(df, e):
    return [r.value for r in x.with_factors(df, {"value": e}).orderBy("code", "date").collect()]


c = x.col("close")


def test_higher_order_difference(spark):
    assert values(one_code(spark, [1.0, 4.0, 9.0, 16.0]), x.delta(c, 2)) == [None, None, 2.0, 2.0]
    assert values(one_code(spark, [1.0, 4.0, 9.0, 16.0]), x.delta(c, 2, order=False)) == [None, None, 8.0, 12.0]


def test_rank_of_newest_and_age_of_extremes(spark):
    df = one_code(spark, [3.0, 1.0, 2.0, 2.0, None, 5.0])
    assert values(df, x.ts_rank(c, 3)) == [0.5, 0.0, 0.5, 0.75, None, 1.0]
    assert values(df, x.ts_argmax(c, 3))[-1] == 0.0
    assert values(df, x.ts_argmin(c, 4))[3] == pytest.approx(2 / 4)


def test_decay_and_full_windows(spark):
    df = one_code(spark, [1.0, 2.0, 3.0, 4.0])
    assert values(df, x.decay_linear(c, 3)) == [None, None, pytest.approx(14 / 6), pytest.approx(20 / 6)]
    assert values(df, x.ts_mean(c, 3, 3)) == [None, None, 2.0, 3.0]


def test_constant_series_has_no_correlation(spark):
    df = one_code(spark, [2.0] * 5)
    assert values(df, x.correlation(c, c * 1.0, 3)) == [None] * 5


def test_cross_section_rank_with_ties(spark):
    df = spark.createDataFrame([(DAYS[0], k, v) for k, v in zip("abcd", [1.0, 2.0, 2.0, None], strict=True)], "date date, code string, close double")
    assert values(df, x.rank(c)) == [pytest.approx(1 / 2.5), 1.0, 1.0, None]


def test_no_look_ahead(spark):
    full = one_code(spark, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    e = x.ts_rank(x.decay_linear(c, 2), 4) + x.stddev(c, 3)
    assert values(full.filter("date < '2024-01-06'"), e) == values(full, e)[:5]


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(DAYS[i], "a") for i in (0, 2, 5)], "date date, code string")
    right = spark.createDataFrame([(DAYS[1], "a", 1.0), (DAYS[5], "a", 2.0), (DAYS[0], "b", 3.0)], "date date, code string, v double")
    assert [r.v for r in joins.asof(left, right, ["v"]).orderBy("date").collect()] == [None, 1.0, 2.0]
    spans = spark.createDataFrame([("a", DAYS[0], DAYS[2]), ("b", DAYS[1], DAYS[1])], "code string, start_date date, end_date date")
    assert sorted((r.code, r.date) for r in joins.expand_intervals(spans).collect()) == [("a", DAYS[0]), ("a", DAYS[1])]


def test_intervals_that_overlap_are_dealt_to_many_tasks(spark):
    spans = spark.createDataFrame([("a", 0, 3), ("a", 1, 2), ("a", 2, 5), ("a", 6, 7), ("a", 5, 6), ("b", 4, 4)], "code string, lo int, hi int").selectExpr("code", "date_add(date'2024-01-01', lo) as start_date", "date_add(date'2024-01-01', hi) as end_date")
    out = joins.expand_intervals(spans)
    assert [(r.code, r.date.day - 1) for r in out.orderBy("code", "date").collect()] == [("a", i) for i in range(7)]
    # A few rows make many days: adaptive plans shall not put them into one task.
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_group_neutralisation_and_residual(spark):
    rows = [(DAYS[0], k, g, v, s) for k, g, v, s in (("a", "x", 1.0, 1.0), ("b", "x", 3.0, 2.0), ("c", "y", 10.0, 5.0), ("d", "y", 2.0, 4.0))]
    df = spark.createDataFrame(rows, "date date, code string, g string, value double, size double")
    shift = 0.0
    for total, n in ((4.0, 2), (12.0, 2)):
        shift += (total - n * shift) / 4
    assert [r.value for r in transform.industry_neutralize(df, "g").orderBy("code").collect()] == pytest.approx([v - shift for v in (1, 3, 10, 2)])
    left = np.array([r.value for r in transform.size_industry_residual(df, "g", "size").orderBy("code").collect()])
    design = np.array([[1, 0, 1], [1, 0, 2], [0, 1, 5], [0, 1, 4]], float)
    y = np.array([1, 3, 10, 2], float)
    assert left == pytest.approx(y - design @ np.linalg.lstsq(design, y, rcond=None)[0])


def test_portfolio_value(spark):
    w = spark.createDataFrame([(DAYS[i], "a", 1.0) for i in range(3)], "date date, code string, weight double")
    r = spark.createDataFrame([(DAYS[i], "a", v) for i, v in enumerate((0.5, -0.5, 1.0))], "date date, code string, ret double")
    rows = evaluate.portfolio_value(w, r).orderBy("date").collect()
    assert [x.nav for x in rows] == pytest.approx([1.5, 0.75, 1.5]) and rows[1].drawdown == pytest.approx(-0.5)


def test_exponential_mean_matches_the_recurrence_over_gaps(spark):
    given = [1.0, None, 2.0, 3.0, None, 7.0, 1.0, 4.0]
    expected, last = [], None
    for i, q in enumerate(given):
        known = [k for k in given[: i + 1] if k is not None]
        if q is not None and len(known) >= 2:
            last = sum(known) / 2 if len(known) == 2 else last + (q - last) * 2 / 3
        expected.append(pytest.approx(last) if q is not None and len(known) >= 2 else None)
    assert values(one_code(spark, given), x.exponential(c, 2)) == expected


def test_picked_sum_takes_rows_by_another_column(spark):
    df = spark.createDataFrame([(d, "a", v, k) for d, v, k in zip(DAYS, [1.0, 2.0, 4.0, 8.0], [3.0, 1.0, 2.0, 2.0], strict=False)], "date date, code string, close double, k double")
    assert values(df, x.picked_sum(c, x.col("k"), 3, 2)) == [None, None, 6.0, 6.0]
    assert values(df, x.picked_sum(c, x.col("k"), 3, 1, lowest=False)) == [None, None, 1.0, 4.0]


def test_neutralize_folds_groups_as_the_transform_does(spark):
    rows = [(DAYS[0], k, g, v) for k, g, v in (("a", "x", 1.0), ("b", "x", 3.0), ("c", "y", 10.0), ("d", "y", 2.0), ("e", None, 4.0), ("f", "y", None))]
    df = spark.createDataFrame(rows, "date date, code string, g string, close double")
    folded = transform.industry_neutralize(df, "g", "close").orderBy("code").collect()
    assert values(df, x.neutralize(c, "g")) == [r.close if r.close is None else pytest.approx(r.close) for r in folded]


def test_statements_need_the_quarters_they_name(spark):
    q = [dt.date(2023, m, 1) for m in (1, 4, 7, 10)] + [dt.date(2024, 1, 1), dt.date(2024, 7, 1)]
    df = spark.createDataFrame([(d, "a", v) for d, v in zip(q, [1.0, 3.0, 6.0, 10.0, 2.0, 9.0], strict=True)], "period date, code string, ytd double")
    single = statements.single_quarter(df, "ytd", "s")
    assert [r.s for r in single.orderBy("period").collect()] == [1.0, 2.0, 3.0, 4.0, 2.0, None]
    assert [r.t for r in statements.trailing_year(single, "s", "t").orderBy("period").collect()] == [None, None, None, 10.0, 11.0, None]
    assert [r.g for r in statements.year_over_year(df, "ytd", "g").orderBy("period").collect()] == [None, None, None, None, 1.0, 0.5]


def test_barriers_and_episodes(spark):
    df = one_code(spark, [10.0, 11.0, 16.0, 5.0, 5.0, 5.0])
    assert [r.label for r in evaluate.triple_barrier(df, 0.5, 0.4, 2).orderBy("date").collect()] == [2, 0, 0, 1, None, None]
    nav = spark.createDataFrame([(d, v) for d, v in zip(DAYS, [1.0, 2.0, 1.0, 1.5, 2.0, 1.8], strict=False)], "date date, nav double")
    found = evaluate.drawdown_episodes(nav).orderBy("start").collect()
    assert [(r.start, r.valley, r.end, r.rows) for r in found] == [(DAYS[2], DAYS[2], DAYS[3], 2), (DAYS[5], DAYS[5], DAYS[5], 1)]


@pytest.mark.parametrize("period", [9.0, 14.0, 22.5])
def test_period_and_phase_of_a_known_wave(spark, period):
    w = 2 * math.pi / period
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(d, "a", 50 + 7 * math.cos(w * i + 0.4)) for i, d in enumerate(days)], "date date, code string, close double")
    rows = x.with_factors(df, cycles.cycle(c)).orderBy("date").collect()
    late = rows[40:]
    assert [r.period for r in late] == pytest.approx([period] * len(late), rel=1e-6)
    steps = [(b.phase - a.phase) % (2 * math.pi) for a, b in zip(late, late[1:], strict=False)]
    assert steps == pytest.approx([w] * len(steps), abs=1e-6)
    # In phase and quadrature are a quarter turn apart: their squares add up to the same size at every row.
    size = [r.in_phase**2 + r.quadrature**2 for r in late]
    assert size == pytest.approx([size[0]] * len(size), rel=1e-6)
    assert rows[5].period is None and sum(r.turning for r in late) == pytest.approx(len(late) / period, abs=1)


def test_exponential_mean_of_sparse_values_keeps_its_whole_history(spark):
    """A window of rows held few values where most are null, and lost what still weighs."""
    v = [None if i % 10 else (1e6 if i == 0 else float(i % 7)) for i in range(900)]
    got = values(long_code(spark, v), x.exponential(c, 6, 2 / 13))
    y, k = 0.0, 0
    for i, q in enumerate(v):
        if q is not None:
            k += 1
            y = y + q / 6 if k <= 6 else y * (11 / 13) + q * (2 / 13)
        assert got[i] == (None if q is None or k < 6 else pytest.approx(y, rel=1e-12))


def test_exponential_mean_over_blocks_and_of_one_value(spark):
    v = [float(i * 7919 % 101) for i in range(1500)]  # a weight of 0.5 makes a block of 663 values
    y, want = 0.0, []
    for i, q in enumerate(v):
        y = y + q / 3 if i < 3 else y * 0.5 + q * 0.5
        want.append(pytest.approx(y, rel=1e-12) if i > 1 else None)
    df = long_code(spark, v)
    assert values(df, x.exponential(c, 3)) == want
    assert values(df, x.exponential(c, 1)) == v


def test_long_windows_are_put_together_of_running_parts(spark):
    n, d = 137, 41
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), "a", None if i % 11 == 3 else (5.1 if i < 60 else float(i * 7919 % 101)), float(i * 31 % 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, code string, close double, open double")
    pair = x.correlation(c, x.col("open"), d)
    full = x.correlation(x.coalesce(c, 3.0), x.col("open"), d)
    kinds = {"sum": x.ts_sum(c, d), "mean": x.ts_mean(c, d, d), "lo": x.ts_min(c, d), "hi": x.ts_max(c, d), "dev": x.stddev(c, d), "var": x.variance(x.col("open"), d), "pair": pair, "full": full, "slope": x.regression_slope(x.col("open"), x.coalesce(c, 3.0), d), "flat": x.correlation(x.where(c > 1e9, c, 5.1), x.col("open"), d)}
    out = x.with_factors(df, kinds)
    found = out.orderBy("date").collect()
    for i, r in enumerate(found):
        w = [(q[2], q[3]) for q in rows[max(0, i - d + 1) : i + 1]]
        v = [a for a, _ in w if a is not None]
        enough = len(v) >= d // 2
        near = lambda t: pytest.approx(t, rel=1e-9, abs=1e-9)
        assert (r["sum"], r["lo"], r["hi"]) == ((near(sum(v)), min(v), max(v)) if enough else (None,) * 3)
        assert r["dev"] == (near(statistics.pstdev(v)) if enough else None)
        assert r["mean"] is None and r["pair"] is None and r["flat"] is None
        if i >= d - 1:
            a, b = [3.0 if p is None else p for p, _ in w], [q for _, q in w]
            assert r["var"] == near(statistics.pvariance(b))
            assert r["full"] == near(statistics.correlation(a, b))
            assert r["slope"] == near(statistics.linear_regression(a, b).slope)
        else:
            assert r["var"] is None and r["full"] is None and r["slope"] is None
    # No frame of d rows, each of which would be aggregated anew.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"RowFrame, -{d - 1}, currentrow" not in plan and "RowFrame" in plan


def test_ranks_of_a_date_share_an_exchange(spark):
    df = spark.createDataFrame([(DAYS[i % 3], str(i), float(i % 5), float(i % 4)) for i in range(12)], "date date, code string, close double, open double")
    plan = x.with_factors(df, {"r": x.rank(x.delay(c, 1)) + x.rank(x.col("open")) + x.rank(c) + x.rank(x.ts_sum(c, 2))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_rank_in_a_window_collects_no_frame(spark):
    df = long_code(spark, [float(i * 37 % 11) if i % 6 else None for i in range(90)])
    plan = x.with_factors(df, {"value": x.ts_rank(c, 19)})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    known = [float(i * 37 % 11) if i % 6 else None for i in range(90)]
    for i, got in enumerate(values(df, x.ts_rank(c, 19))):
        window = [v for v in known[max(0, i - 18) : i + 1] if v is not None]
        if known[i] is None or len(window) < 9:
            assert got is None
        else:
            assert got == pytest.approx((sum(v < known[i] for v in window) + 0.5 * (sum(v == known[i] for v in window) - 1)) / (len(window) - 1))


def sorts(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if " Sort [code" in line]


def test_blocks_of_a_code_are_sorted_once(spark):
    """A running mean's blocks and what is carried over them share an order; so do a long window's first part and the lag of its second."""
    df = long_code(spark, [float(i % 7) for i in range(9)])
    assert len(sorts(x.with_factors(df, {"value": x.exponential(c, 3)}))) == 2
    assert len(sorts(x.with_factors(df, {"value": x.ts_sum(c, 50)}))) == 3


def test_bars_by_code_are_those_of_all_trades_and_in_the_order_of_windows(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1 + k, 12)
    trades = [(None if i % 13 == 0 else i % 4, day(i % 5) if i % 17 else None, None if i % 11 == 0 else i % 6, 1, i % 3, float(i * 7919 % 101) if i % 19 else None, float(i % 9)) for i in range(200)]
    columns = "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(trades, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    apart, dealt = panels.bars(spark, str(tmp_path), "day"), panels.bars(spark, str(tmp_path), "day", by_code=True)
    assert apart.columns == dealt.columns and sorted(map(str, apart.collect())) == sorted(map(str, dealt.collect()))
    want = {}
    for code, when, *key, price, quantity in trades:
        if when and price is not None:
            # A null of the key comes first.
            want.setdefault((when.date(), code), []).append((when, *[(k is not None, k or 0) for k in key], price, quantity))
    for r in dealt.collect():
        w = sorted(want.pop((r.date, r.code)))
        assert (r.open, r.close, r.low, r.high, r.trades, r.volume, r.money) == (w[0][-2], w[-1][-2], min(t[-2] for t in w), max(t[-2] for t in w), len(w), sum(t[-1] for t in w), sum(t[-2] for t in w))
    assert not want
    out = x.with_factors(dealt, {"value": x.delay(c, 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(sorts(out)) == 1


def test_long_covariance_of_a_series_with_itself_is_its_variance(spark):
    v = [None if i == 70 else (5.1 if i < 50 else float(i * 7919 % 101)) for i in range(160)]
    out = x.with_factors(long_code(spark, v), {"value": x.covariance(c, c, 41)})
    for i, r in enumerate(out.orderBy("date").collect()):
        w = v[max(0, i - 40) : i + 1]
        assert r.value == (pytest.approx(statistics.pvariance(w), rel=1e-9, abs=1e-9) if len(w) == 41 and None not in w else None)
    assert "covar_pop" not in out._jdf.queryExecution().logical().toString()
