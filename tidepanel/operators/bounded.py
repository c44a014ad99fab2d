"""Weights within bounds around a benchmark that maximise the weighted score.

With bounds on each weight and one total (for a date, or for each group of it) the
linear programme has a greedy optimum: all start at their lower bounds, and what
is left of the total goes to the best scores first, each up to its upper bound.
Two windows express it, without a solver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enhanced_weights(df: DataFrame, value: str, benchmark: str, tilt: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``weight``: within ``tilt`` of the benchmark weight, never negative, with the benchmark's total in each date (and group).

    A null score counts as the worst; ties go to the smaller code; a null benchmark weight is zero.
    """
    b = F.coalesce(F.col(benchmark), F.lit(0.0))
    df = df.withColumn("_lo", F.greatest(F.lit(0.0), b - tilt)).withColumn("_room", b + tilt - F.col("_lo"))
    group = Window.partitionBy("date", *by)
    before = group.orderBy(F.desc_nulls_last(value), "code").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(b - F.col("_lo")).over(group) - F.coalesce(F.sum("_room").over(before), F.lit(0.0))
    return df.withColumn("weight", F.col("_lo") + F.greatest(F.lit(0.0), F.least(left, F.col("_room")))).drop("_lo", "_room")


def sector_budget_top(df: DataFrame, scores: DataFrame, multiplier: float, value: str = "value", sector: str = "sector") -> DataFrame:
    """The best codes of each sector and date, as many as the whole part of the sector's score (date, sector, score) times the multiplier."""
    n = F.row_number().over(Window.partitionBy("date", sector).orderBy(F.desc(value), "code"))
    return df.filter(F.col(value).isNotNull()).withColumn("_n", n).join(scores, ["date", sector]).filter(F.col("_n") <= F.floor(F.col("score") * multiplier)).drop("_n", "score")


def index_weights(panel: DataFrame, weights: DataFrame, days: int) -> DataFrame:
    """Adds ``weight``: the last index weight (date, code, weight) up to ``days`` days old, over the total of the date; null without one."""
    from .joins import asof

    known = asof(panel, weights.select("code", F.col("date").alias("_at"), F.col("date").alias("_seen"), F.col("weight").alias("_w")), ["_w", "_seen"], "date", "_at")
    fresh = known.withColumn("_w", F.when(F.datediff("date", "_seen") <= days, F.col("_w")))
    return fresh.withColumn("weight", F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy("date")))).drop("_w", "_seen", "_at")


def norm_score(df: DataFrame, beta: float, value: str = "value") -> DataFrame:
    """The value over ``beta`` times the sum of absolutes of its date."""
    return df.withColumn(value, F.try_divide(F.col(value), F.sum(F.abs(value)).over(Window.partitionBy("date")) * beta))


def fixed_bounds(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumns({"lower": F.col(value), "upper": F.col(value)})


def score_bounds(df: DataFrame, edges: list[float], grouped: bool, value: str = "value") -> DataFrame:
    """Adds lower and upper: the quantile edges of the date around the value; without ``grouped`` the outermost buckets keep the value itself.

    The lowest edge lies a thousandth below the least value.
    """
    w = Window.partitionBy("date")
    cut = F.percentile(value, F.array(*[F.lit(e) for e in edges])).over(w)
    df = df.withColumn("_e", cut)
    n = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(value))), F.lit(1))
    lower = F.when(n == 1, F.element_at("_e", 1) - 0.001).otherwise(F.element_at("_e", n))
    upper = F.element_at("_e", n + 1)
    outer = (n == 1) | (n == len(edges) - 1)
    own = F.lit(grouped) | ~outer
    return df.withColumns({"lower": F.when(own, lower).otherwise(F.col(value)), "upper": F.when(own, upper).otherwise(F.col(value))}).drop("_e")


def add_sector_score(df: DataFrame, scores: DataFrame, beta: float, value: str = "value", sector: str = "sector") -> DataFrame:
    """The value plus ``beta`` times its sector's score (date, sector, score); rows of unknown sectors go."""
    return df.filter(F.col(sector).isNotNull()).join(scores, ["date", sector], "left").withColumn(value, F.col(value) + F.col("score") * beta).drop("score")


def tilt_bounds(df: DataFrame, r: float, n: int = 2, value: str = "value") -> DataFrame:
    """Adds lower and upper weights off the benchmark by bucket of the value: of two (-r to 0, 0 to r) or of three (-r to -r/2, to r/2, to r)."""
    from .transform import quantize

    at = {2: ((-r, 0.0), (0.0, r)), 3: ((-r, -r / 2), (-r / 2, r / 2), (r / 2, r))}[n]
    q = quantize(df, n, value, "_q")
    # A place that is null is asked for first: element_at of an array without nulls counts as never null.
    pick = lambda side: F.when(F.col("_q").isNotNull(), F.element_at(F.array(*[F.lit(b[side]) for b in at]), F.col("_q")))
    return q.withColumns({"lower": pick(0), "upper": pick(1)}).drop("_q")
