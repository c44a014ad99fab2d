"""Weights that maximise the weighted score within bounds, industry bands and a limit of turnover.

Without the limit this is a linear programme over nested sums (a row, its industry, its date), whose optimum is
greedy: rows start at their lower bounds, an industry first takes what its own lower band demands, best scores first,
and what is left of the date's total goes to the best scores that their industries still admit.  Two
windows express it.

A limit on turnover against previous weights is taken into the score with a multiplier t: weight up to the
previous one gains score + t, weight beyond it score - t, so that a row becomes two pieces and the same greedy is
exact for each t.  Turnover falls as t grows, so each round finds its place in a grid of t within a date's bracket by halving: every step is one
aggregation at a single t a date, for all dates at once.  Between the two ends of the last bracket the mix of their weights that just meets the limit is
taken: it is within all bounds, and its score is below the optimum by at most the width of the bracket times the limit.  Previous weights are a
column, so dates do not depend on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, GRID = 4, 16


def _pieces(df: DataFrame, multiplier: Column) -> DataFrame:
    """Two pieces a row, up to the previous weight and beyond it, each with its gain and room."""
    mid = F.greatest(F.col("_lo"), F.least(F.col("_p"), F.col("_hi")))
    up = F.struct(F.lit(0).alias("k"), (F.col("_s") + multiplier).alias("gain"), (mid - F.col("_lo")).alias("room"))
    beyond = F.struct(F.lit(1).alias("k"), (F.col("_s") - multiplier).alias("gain"), (F.col("_hi") - mid).alias("room"))
    return df.select("*", F.inline(F.array(up, beyond)))


def _taken(df: DataFrame, by: list[str]) -> DataFrame:
    """The pieces with ``_take``, what the greedy optimum for each value of ``by`` places in them."""
    pieces = _pieces(df, F.col("_t") if "_t" in by else F.lit(0.0))
    inside = Window.partitionBy(*by, "_g").orderBy(F.desc("gain"), "code", "k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("room").over(inside), F.lit(0.0))
    zero = F.lit(0.0)
    placed = pieces.withColumn("_at", before)
    # What the lower band of the industry demands, and what its upper band admits beyond that.
    own = F.greatest(zero, F.least(F.col("_need") - F.col("_at"), F.col("room")))
    end = F.least(F.col("_at") + F.col("room"), F.col("_most"))
    more = F.greatest(zero, end - F.greatest(F.col("_at"), F.col("_need")))
    placed = placed.withColumns({"_own": own, "_more": more})
    across = Window.partitionBy(*by).orderBy(F.desc("gain"), "code", "k").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("_more").over(across), F.lit(0.0))
    left = F.col("_total") - F.sum("_own").over(Window.partitionBy(*by)) - F.col("_low")
    return placed.withColumn("_take", F.col("_own") + F.greatest(zero, F.least(left - taken, F.col("_more"))))


def _greedy(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, code, weight, _p) of the greedy optimum for each value of ``by``."""
    return _taken(df, by).groupBy(*by, "code").agg((F.first("_lo") + F.sum("_take")).alias("weight"), F.first("_p").alias("_p"))


def _turnover(df: DataFrame) -> DataFrame:
    """Rows (date, _t, turnover) of the greedy optimum, summed over pieces: a row fills the piece up to the previous weight first."""
    away = F.when(F.col("k") == 0, F.abs(F.greatest(F.col("_lo"), F.least(F.col("_p"), F.col("_hi"))) - F.col("_p")) + F.col("room") - F.col("_take")).otherwise(F.col("_take"))
    return _taken(df, ["date", "_t"]).groupBy("date", "_t").agg(F.sum(away).alias("turnover"))


def _prepared(df: DataFrame, value: str, benchmark: str, tilt: float, industry: str, band: float, previous: str | None) -> DataFrame:
    day, group = Window.partitionBy("date"), Window.partitionBy("date", "_g")
    b = F.coalesce(F.col(benchmark), F.lit(0.0))
    score = F.coalesce(F.col(value), F.min(value).over(day) - F.coalesce(F.stddev_samp(value).over(day), F.lit(0.0)), F.lit(0.0))
    base = df.select("date", "code", F.col(industry).alias("_g"), score.alias("_s"), b.alias("_b"), F.greatest(F.lit(0.0), b - tilt).alias("_lo"), (b + tilt).alias("_hi"), (F.coalesce(F.col(previous), F.lit(0.0)) if previous else F.lit(0.0)).alias("_p"))
    base = base.withColumns({"_base": F.sum("_lo").over(group), "_held": F.sum("_b").over(group), "_room": F.sum("_hi").over(group)})
    base = base.withColumns({"_total": F.sum("_b").over(day), "_low": F.sum("_lo").over(day)})
    need, most = F.greatest(F.col("_base"), F.col("_held") - band) - F.col("_base"), F.least(F.col("_room"), F.col("_held") + band) - F.col("_base")
    return base.select("date", "code", "_g", "_s", "_p", "_lo", "_hi", "_total", "_low", need.alias("_need"), most.alias("_most"))


def banded_weights(df: DataFrame, value: str, benchmark: str, tilt: float, industry: str, band: float) -> DataFrame:
    """(date, code, weight): at most ``tilt`` off the benchmark weight and never negative, an industry at most ``band`` off the benchmark's, with the benchmark's total.

    A null score counts as the date's least less its deviation, a null benchmark weight as 0, rows without an industry as one industry; ties go to the smaller code.
    """
    return _greedy(_prepared(df, value, benchmark, tilt, industry, band, None), ["date"]).drop("_p")


def turnover_weights(df: DataFrame, value: str, benchmark: str, tilt: float, industry: str, band: float, previous: str, limit: float, rounds: int = ROUNDS, grid: int = GRID) -> DataFrame:
    """(date, code, weight, turnover): ``banded_weights`` whose sum of absolute differences to the ``previous`` weights is at most ``limit``.

    Where no weights within the bounds meet the limit, those of the least turnover.  A null previous weight is 0.
    """
    base = _prepared(df, value, benchmark, tilt, industry, band, previous).persist()  # read once for all rounds, and by the result
    kind = df.schema["date"].dataType.simpleString()
    spread = base.groupBy("date").agg((F.max("_s") - F.min("_s")).alias("d")).collect()  # one row a date, as below
    brackets = {r.date: (0.0, float(r.d) * 1.001 + 1e-12) for r in spread if r.date is not None}

    def at(points: dict) -> DataFrame:
        rows = [(d, float(t)) for d, ts in points.items() for t in dict.fromkeys(ts)]
        return base.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"date {kind}, _t double")), "date")

    for i in range(rounds):
        points = {d: [a + (b - a) * k / grid for k in range(grid + 1)] for d, (a, b) in brackets.items()}
        # Of each date the last place known to exceed the limit and the first known to meet it; a bracket's ends are known after the first round.
        places = {d: (-1, grid + 1) if not i else (0, grid) if a < b else (0, 0) for d, (a, b) in brackets.items()}
        for _ in range((grid + 2).bit_length()):
            asked = {d: (lo + hi) // 2 for d, (lo, hi) in places.items() if hi - lo > 1}
            if not asked:
                break
            for d, _, turnover in _turnover(at({d: [points[d][k]] for d, k in asked.items()})).collect():
                lo, hi = places[d]
                places[d] = (lo, asked[d]) if turnover <= limit else (asked[d], hi)
        brackets = {d: (points[d][min(max(lo, 0), grid)], points[d][min(hi, grid)]) for d, (lo, hi) in places.items()}
    if not brackets:
        return df.sparkSession.createDataFrame([], f"date {kind}, code {df.schema['code'].dataType.simpleString()}, weight double, turnover double")
    ends = _greedy(at(brackets), ["date", "_t"])
    both = ends.groupBy("date", "code").agg(F.min_by("weight", "_t").alias("_more"), F.max_by("weight", "_t").alias("_less"), F.first("_p").alias("_p"))
    day = Window.partitionBy("date")
    away = lambda c: F.sum(F.abs(F.col(c) - F.col("_p"))).over(day)
    both = both.withColumns({"_a": away("_more"), "_z": away("_less")})
    share = F.when((F.col("_a") > limit) & (F.col("_z") <= limit), (F.lit(limit) - F.col("_z")) / (F.col("_a") - F.col("_z"))).otherwise(F.when(F.col("_a") <= limit, 1.0).otherwise(0.0))
    mixed = both.withColumn("weight", F.col("_more") * share + F.col("_less") * (1 - share))
    return mixed.select("date", "code", "weight", away("weight").alias("turnover"))
