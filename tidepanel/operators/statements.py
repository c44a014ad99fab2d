"""Periodic statements: single quarters, trailing years, growth, and what was known at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof


def _lagged(value: str, quarters: int, code: str, period: str) -> Column:
    """The value of the period so many quarters before; null where that period is missing, however the rows lie."""
    w = Window.partitionBy(code).orderBy("_q").rangeBetween(-quarters, -quarters)
    return F.max(value).over(w)


def _numbered(df: DataFrame, period: str) -> DataFrame:
    return df.withColumn("_q", F.year(period) * 4 + F.quarter(period))


def single_quarter(df: DataFrame, value: str, out: str, code: str = "code", period: str = "period") -> DataFrame:
    """Quarter values of figures that add up from the start of each year."""
    df = _numbered(df, period)
    before = _lagged(value, 1, code, period)
    return df.withColumn(out, F.when(F.quarter(period) == 1, F.col(value)).otherwise(F.col(value) - before)).drop("_q")


def trailing_year(df: DataFrame, value: str, out: str, code: str = "code", period: str = "period") -> DataFrame:
    """Sum of the last four quarters; null unless all four are there."""
    w = Window.partitionBy(code).orderBy("_q").rangeBetween(-3, 0)
    return _numbered(df, period).withColumn(out, F.when(F.count(value).over(w) == 4, F.sum(value).over(w))).drop("_q")


def year_over_year(df: DataFrame, value: str, out: str, code: str = "code", period: str = "period") -> DataFrame:
    df = _numbered(df, period).withColumn("_b", _lagged(value, 4, code, period))
    return df.withColumn(out, F.try_divide(F.col(value) - F.col("_b"), F.abs("_b"))).drop("_q", "_b")


def average_of_last(df: DataFrame, value: str, out: str, n: int = 4, code: str = "code", period: str = "period") -> DataFrame:
    """Mean over the last n quarters that are there."""
    w = Window.partitionBy(code).orderBy("_q").rangeBetween(-(n - 1), 0)
    return _numbered(df, period).withColumn(out, F.avg(value).over(w)).drop("_q")


def surprise(df: DataFrame, value: str, out: str, n: int = 8, code: str = "code", period: str = "period") -> DataFrame:
    """Growth on the year before, less its mean over the n quarters before, in sample deviations."""
    df = _numbered(df, period).withColumn("_g", F.col(value) - _lagged(value, 4, code, period))
    w = Window.partitionBy(code).orderBy("_q").rangeBetween(-n, -1)
    return df.withColumn(out, F.try_divide(F.col("_g") - F.avg("_g").over(w), F.stddev_samp("_g").over(w))).drop("_q", "_g")


def as_known(panel: DataFrame, statements: DataFrame, values: list[str], published: str) -> DataFrame:
    """Each row of the panel with the figures published last at its date."""
    return asof(panel, statements, values, "date", published)
