"""Selection of instruments by date, and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, value: str, by: tuple[str, ...], down: bool) -> DataFrame:
    order = F.col(value).desc() if down else F.col(value).asc()
    return df.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("date", *by).orderBy(order, "code")))


def top_n(df: DataFrame, n: int | Column, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """The n greatest values of each date (and group); n may be a column.  Ties go to the smaller code."""
    return _numbered(df, value, by, True).filter(F.col("_n") <= n).drop("_n")


def bottom_n(df: DataFrame, n: int | Column, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return _numbered(df, value, by, False).filter(F.col("_n") <= n).drop("_n")


def _edge(value: str, q: float, by: tuple[str, ...]) -> Column:
    return F.percentile(F.col(value), F.lit(q)).over(Window.partitionBy("date", *by))


def above_quantile(df: DataFrame, q: float, value: str = "value", strict: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Values above the date's quantile q, or at it too where not strict."""
    df = df.withColumn("_e", _edge(value, q, by))
    return df.filter(F.col(value) > F.col("_e") if strict else F.col(value) >= F.col("_e")).drop("_e")


def below_quantile(df: DataFrame, q: float, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("_e", _edge(value, q, by)).filter(F.col(value) < F.col("_e")).drop("_e")


def in_universe(df: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    return df.join(members.select(*keys).distinct(), list(keys), "left_semi")


def out_of_universe(df: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    return df.join(members.select(*keys).distinct(), list(keys), "left_anti")


def listed_for(df: DataFrame, info: DataFrame, days: int) -> DataFrame:
    """Rows more than ``days`` after the code's start_date."""
    return df.join(info.select("code", "start_date"), "code").filter(F.datediff("date", "start_date") > days).drop("start_date")


def equal_weight(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.try_divide(F.lit(1.0), F.count("*").over(Window.partitionBy("date"))))


def proportional_weight(df: DataFrame, by: str) -> DataFrame:
    """Weights in proportion to a column (capitalisation, index weight), summing to 1 each date."""
    return df.withColumn("weight", F.try_divide(F.col(by), F.sum(by).over(Window.partitionBy("date"))))


def long_short_weight(df: DataFrame, value: str = "value", by: tuple[str, ...] = (), equal: bool = False) -> DataFrame:
    """Demeaned values (their signs, if equal) over the sum of absolutes."""
    away = F.col(value) - F.avg(value).over(Window.partitionBy("date", *by))
    df = df.withColumn("_d", F.signum(away) if equal else away)
    return df.withColumn("weight", F.try_divide(F.col("_d"), F.sum(F.abs("_d")).over(Window.partitionBy("date")))).drop("_d")


def append_rows(*panels: DataFrame) -> DataFrame:
    """All rows of panels with the same columns."""
    out = panels[0]
    for panel in panels[1:]:
        out = out.unionByName(panel)
    return out
