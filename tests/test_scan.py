"""Recurrences by the associative scan and the as-of join by buckets, against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import joins, scan

DAYS = [dt.date(2023, 11, 1) + dt.timedelta(days=7 * i) for i in range(40)]


def made(seed=1, codes=3, nulls=0.15):
    rng = random.Random(seed)
    return [(d, f"c{c}", None if rng.random() < nulls else round(rng.uniform(5, 50), 2)) for c in range(codes) for d in DAYS]


def exponential(values, n, alpha=None):
    """Seeded with the mean of the first n known values; null before and at unknown ones."""
    alpha, out, known = alpha or 2 / (n + 1), [], []
    for v in values:
        if v is None:
            out.append(None)
            continue
        known.append(v)
        if len(known) == n:
            last = sum(known) / n
        elif len(known) > n:
            last += alpha * (v - last)
        out.append(last if len(known) >= n else None)
    return out


@pytest.mark.parametrize("unit", ["week", "month", "year"])
def test_linear_scan_is_a_loop_for_every_bucket(spark, unit):
    rng = random.Random(2)
    rows = [(d, f"c{c}", rng.choice([None, 0.0, 0.5, 1.0, -0.7]), rng.choice([None, 1.0, -2.5, 0.0])) for c in range(3) for d in DAYS]
    df = spark.createDataFrame(rows, "date date, code string, a double, b double").withColumn("_bucket", F.date_trunc(unit, "date"))
    got = scan.linear_scan(df, {"y": (F.col("a"), F.col("b")), "before": (F.lit(0.0), F.col("b"))}, before=("before",))
    assert got.columns == ["date", "code", "a", "b", "_bucket", "y", "before"]
    found = {(r.code, r.date): (r.y, r.before) for r in got.collect()}
    assert len(found) == len(rows)
    for c in range(3):
        y, last = 0.0, 0.0
        for d, code, a, b in rows:
            if code == f"c{c}":
                assert found[code, d][1] == last
                last = last if b is None else b
                y = y if a is None or b is None else a * y + b
                assert found[code, d][0] == pytest.approx(y)


def test_a_code_is_spread_over_tasks(spark):
    df = spark.createDataFrame([(dt.date(2000 + i, 1, 1), "one", 1.0) for i in range(64)], "date date, code string, v double").withColumn("_bucket", F.date_trunc("year", "date"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = scan.linear_scan(df, {"n": (F.lit(1.0), F.col("v"))}).withColumn("task", F.spark_partition_id()).collect()
        asked = joins.asof_bucketed(df.select("code", "date"), df.select("code", "date", "v"), ["v"], "year").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r.n for r in got) == list(range(1, 65)) and len({r.task for r in got}) == len({r.task for r in asked}) == 4


def test_indicators_are_plain_loops(spark):
    rows = made()
    got = {(r.code, r.date): r for r in scan.indicators(spark.createDataFrame(rows, "date date, code string, close double"), unit="month").collect()}
    assert len(got) == len(rows)
    for c in ("c0", "c1", "c2"):
        v = [x for _, code, x in rows if code == c]
        steps = [None if i == 0 or x is None or v[i - 1] is None else x - v[i - 1] for i, x in enumerate(v)]
        fast, slow = exponential(v, 12), exponential(v, 26)
        macd = [None if a is None or b is None else a - b for a, b in zip(fast, slow, strict=True)]
        up, down = (exponential([None if s is None else max(sign * s, 0) for s in steps], 6, 1 / 6) for sign in (1, -1))
        expected = {"ema_6": exponential(v, 6), "sma_6_2": exponential(v, 5), "macd": macd, "macd_signal": exponential(macd, 9), "rsi_6": [None if a is None else 100 * a / (a + b) for a, b in zip(up, down, strict=True)]}
        for name, values in expected.items():
            for d, e in zip(DAYS, values, strict=True):
                assert got[c, d][name] == (None if e is None else pytest.approx(e)), (c, d, name)


def test_adaptive_mean_runs_fast_on_a_straight_path(spark):
    values = {"a": [1.0, 2.0, None, 3.0, 4.0], "b": [1.0, 2.0, 1.0, 2.0, 1.0]}
    df = spark.createDataFrame([(DAYS[i], c, v) for c, row in values.items() for i, v in enumerate(row)], "date date, code string, close double")
    three = {(r.code, r.date): r.adaptive for r in scan.adaptive_mean(df, "close", 3, unit="week").collect()}
    assert three["a", DAYS[3]] is None and three["a", DAYS[4]] == pytest.approx(3 + (2 / 3) ** 2) and ("a", DAYS[2]) not in three
    two = {(r.code, r.date): r.adaptive for r in scan.adaptive_mean(df, "close", 2).collect()}
    assert two["b", DAYS[2]] == pytest.approx(2 + (2 / 31) ** 2 * -1)


def test_parabolic_stop_trails_a_rise_and_flips(spark):
    high, low = [10.0, 11.0, 12.0, 13.0, 8.0], [9.0, 10.0, 11.0, 12.0, 5.0]
    rows = [(d, "a", h, lo) for d, h, lo in zip(DAYS, high, low, strict=False)] + [(DAYS[5], "a", None, 3.0), (DAYS[0], "alone", 1.0, 1.0)]
    got = [r.stop for r in scan.parabolic_stop(spark.createDataFrame(rows, "date date, code string, high double, low double")).filter("code = 'a'").orderBy("date").collect()]
    assert len(got) == 5 and got[0] is None and got[1] == 9.0 and got[2] == pytest.approx(9.0)  # 9 + 0.02 * (11 - 9) = 9.04, held to the lows of two rows
    assert all(x < lo for x, lo in zip(got[1:4], low[1:4], strict=True)) and got[4] == 13.0


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_asof_by_buckets_is_asof(spark, unit):
    rng = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * rng.randint(0, 200))
    left = spark.createDataFrame([(rng.choice("abc"), at(), i) for i in range(120)] + [(None, at(), -1), ("a", None, -2)], "code string, date timestamp, id int")
    right = spark.createDataFrame([(rng.choice("ab"), at(), float(i)) for i in range(60)] + [("a", None, 0.5)], "code string, date timestamp, v double")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(joins.asof_bucketed(left, right, ["v"], unit)) == rows(joins.asof(left, right, ["v"]))
    assert rows(joins.asof_bucketed(left, right.limit(0), ["v"], unit)) == rows(joins.asof(left, right.limit(0), ["v"]))
    assert joins.asof_bucketed(left.limit(0), right, ["v"], unit).count() == 0


def test_period_of_the_mean_with_two_numbers():
    assert scan.sma_period(6, 2) == 5 and scan.sma_period(3, 1) == 5 and math.isclose(2 / (scan.sma_period(12, 1) + 1), 1 / 12)


def test_stop_is_folded_once_a_code(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), "a", 10.0 + i % 5, 9.0 + i % 5) for i in range(12)]
    df = scan.parabolic_stop(spark.createDataFrame(rows, "date date, code string, high double, low double"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The fold lies below the generator, not above it, where it would run for each of its rows.
    assert plan.index("Generate") < plan.index("aggregate(")
    got = [r.stop for r in df.orderBy("date").collect()]
    assert len(got) == 12 and got[0] is None and None not in got[1:]
