"""Weights under bands and turnover against all weights of a lattice, and principal components against numpy."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from tidepanel.operators import optimise

DAYS = [dt.date(2024, 1, d) for d in range(1, 9)]
STEP = 0.05


def lattice_best(rows, tilt, band, limit):
    """The best score over all weights in multiples of STEP; the constraints are as in the operator."""
    b, p, s, g = ([r[k] for r in rows] for k in (1, 2, 3, 4))
    best = None
    ranges = [range(max(0, round((x - tilt) / STEP)), round((x + tilt) / STEP) + 1) for x in b]
    for w in itertools.product(*ranges):
        if sum(w) != round(sum(b) / STEP):
            continue
        w = [k * STEP for k in w]
        if any(abs(sum(x - y for x, y, k in zip(w, b, g, strict=True) if k == q)) > band + 1e-9 for q in set(g)):
            continue
        if limit is not None and sum(abs(x - y) for x, y in zip(w, p, strict=True)) > limit + 1e-9:
            continue
        value = sum(x * y for x, y in zip(w, s, strict=True))
        best = value if best is None or value > best else best
    return best


def instance(rng):
    n = 5
    deal = lambda: [rng.randint(0, 6) for _ in range(n)]
    b, p = deal(), deal()
    return [(f"c{i}", b[i] * STEP, p[i] * STEP, float(rng.randint(-5, 5)), rng.choice("xy")) for i in range(n)]


@pytest.mark.parametrize("limit", [None, 0.4, 0.9])
def test_weights_reach_the_best_of_the_lattice(spark, limit):
    rng = random.Random(5)
    cases = [instance(rng) for _ in range(8)]
    df = spark.createDataFrame([(DAYS[k], *r) for k, case in enumerate(cases) for r in case], "date date, code string, b double, p double, s double, g string")
    tilt, band = 0.2, 0.1
    out = optimise.banded_weights(df, "s", "b", tilt, "g", band) if limit is None else optimise.turnover_weights(df, "s", "b", tilt, "g", band, "p", limit)
    got = {(r.date, r.code): r.weight for r in out.collect()}
    checked = 0
    for k, case in enumerate(cases):
        w = np.array([got[DAYS[k], r[0]] for r in case])
        b, p, s = (np.array([r[i] for r in case]) for i in (1, 2, 3))
        assert w.sum() == pytest.approx(b.sum()) and (w >= -1e-12).all() and (abs(w - b) <= tilt + 1e-12).all()
        for q in "xy":
            assert abs(sum(w[i] - b[i] for i, r in enumerate(case) if r[4] == q)) <= band + 1e-9
        best = lattice_best(case, tilt, band, limit)
        if best is None:
            continue
        checked += 1
        if limit is not None:
            assert abs(w - p).sum() <= limit + 1e-9
        assert s @ w >= best - 2e-4
        if limit is None:
            assert s @ w == pytest.approx(best)
    assert checked >= 4


def test_without_room_the_benchmark_stays(spark):
    df = spark.createDataFrame([(DAYS[0], "a", 0.5, None, 1.0, "x"), (DAYS[0], "b", None, 0.3, None, None), (DAYS[0], "c", 0.5, 0.7, 2.0, "x")], "date date, code string, b double, p double, s double, g string")
    got = {r.code: r.weight for r in optimise.banded_weights(df, "s", "b", 0.0, "g", 0.0).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.5}
    least = optimise.turnover_weights(df, "s", "b", 0.1, "g", 1.0, "p", 0.0).collect()
    # a cannot come to 0, nor b beyond 0.1: the least turnover leaves a at its lower bound.
    assert {r.code: round(r.weight, 9) for r in least} == {"a": 0.4, "b": 0.1, "c": 0.5} or {r.code: round(r.weight, 9) for r in least} == {"a": 0.4, "b": 0.0, "c": 0.6}
    assert optimise.turnover_weights(df.limit(0), "s", "b", 0.1, "g", 1.0, "p", 0.5).count() == 0


def test_search_for_the_multiplier_sorts_one_point_a_date_at_once(spark, monkeypatch):
    rows = [(DAYS[0], f"c{i}", float(i % 7), 0.1, "g", 0.2 * (i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, code string, s double, b double, g string, p double")
    sizes, pieces = [], optimise._pieces

    def counted(part, multiplier):
        sizes.append(part.count())
        return pieces(part, multiplier)

    monkeypatch.setattr(optimise, "_pieces", counted)
    out = optimise.turnover_weights(df, "s", "b", 0.1, "g", 1.0, "p", 0.3).collect()
    assert abs(sum(r.weight for r in out) - 1.0) < 1e-9 and max(r.turnover for r in out) < 0.3 + 1e-9
    assert max(sizes) <= 2 * len(rows)
