"""Which rows may be held or traded: limits, pauses, listing, snapshots, and selectors in turn.

A selector is a function of a panel (date, code, ...) that returns some of its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import above_quantile, in_universe

Selector = Callable[[DataFrame], DataFrame]


def at_limit(price: str = "close") -> dict[str, Column]:
    """Flags of a price that stands at the day's upper or lower limit."""
    return {"at_high": (F.col(price) == F.col("high_limit")).cast("int"), "at_low": (F.col(price) == F.col("low_limit")).cast("int")}


def one_price(side: str | None = None) -> Column:
    """Whether the bar has a single price, at the ``high`` or the ``low`` limit (or either)."""
    high, low = F.col("close") == F.col("high_limit"), F.col("close") == F.col("low_limit")
    return (F.col("high") == F.col("low")) & {"high": high, "low": low, None: high | low}[side]


def can_trade(buys: bool, at_close: bool) -> Column:
    """A paused bar trades nothing; at a limit nothing trades towards it, if the bar has one price or the order is for the close."""
    limit = F.col("high_limit" if buys else "low_limit")
    single = F.col("high") == F.col("low")
    stuck = F.when(single, F.col("high") == limit).otherwise((F.col("close") == limit) if at_close else F.lit(False))
    return (F.coalesce(F.col("paused"), F.lit(0)) != 1) & ~F.coalesce(stuck, F.lit(False))


def null_where_untradable(df: DataFrame, bars: DataFrame, value: str = "value") -> DataFrame:
    """``value`` becomes null where the bar (date, code, close, limits, paused) is paused, closes at a limit or is absent."""
    free = (F.col("paused") == 0) & (F.col("close") != F.col("high_limit")) & (F.col("close") != F.col("low_limit"))
    flags = bars.select("date", "code", F.coalesce(free, F.lit(False)).alias("_free"))
    return df.join(flags, ["date", "code"], "left").withColumn(value, F.when(F.col("_free"), F.col(value))).drop("_free")


def rolling_above_quantile(df: DataFrame, column: str, rows: int, q: float) -> DataFrame:
    """Rows whose sum over the last ``rows`` rows of the code, all known, reaches the date's quantile."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-(rows - 1), 0)
    full = df.withColumn("_s", F.when(F.count(column).over(w) == rows, F.sum(column).over(w)))
    return above_quantile(full, q, "_s", strict=False).drop("_s")


def price_between(df: DataFrame, low: float, high: float, price: str = "close") -> DataFrame:
    return df.filter(F.col(price).between(low, high))


def listed_codes(df: DataFrame, codes, keep: bool = True) -> DataFrame:
    """Rows of a white list (or all but a black list) of codes."""
    inside = F.col("code").isin(list(codes))
    return df.filter(inside if keep else ~inside)


def zero_unless_traded(df: DataFrame, rows: int, least: int, value: str = "value", paused: str = "paused") -> DataFrame:
    """``value`` times 0 where fewer than ``least`` of the code's last ``rows`` rows traded, or where they are not all known."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-(rows - 1), 0)
    enough = (F.count(paused).over(w) == rows) & (F.sum(paused).over(w) <= rows - least)
    return df.withColumn(value, F.when(enough, F.col(value)).otherwise(F.col(value) * 0))


def not_flagged(df: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag (date, code, flag) is known to be false."""
    return in_universe(df, flags.filter(~F.col(flag)))


def in_snapshot(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Members of the last snapshot (date, code) at or before each row's date."""
    marks = df.select("date", F.lit(0).alias("_s")).unionByName(snapshots.select("date", F.lit(1).alias("_s"))).groupBy("date").agg(F.max("_s").alias("_s"))
    # A window over distinct dates, which a calendar bounds.
    last = F.last(F.when(F.col("_s") == 1, F.col("date")), ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    dated = marks.select("date", last.alias("_snapshot"))
    members = snapshots.select(F.col("date").alias("_snapshot"), "code").distinct()
    return df.join(dated, "date").join(members, ["_snapshot", "code"], "left_semi").drop("_snapshot")


def traded_value_members(bars: DataFrame, rows: int, q: float | None = None, least: float | None = None) -> DataFrame:
    """(date, code) of bars whose mean money over the code's last ``rows`` rows reaches the date's quantile, or an amount."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-(rows - 1), 0)
    mean = bars.withColumn("_m", F.when(F.count("money").over(w) == rows, F.avg("money").over(w)))
    kept = mean.filter(F.col("_m") >= least) if q is None else above_quantile(mean, q, "_m", strict=False)
    return kept.select("date", "code")


def pipeline(df: DataFrame, *selectors: Selector) -> DataFrame:
    """Rows of ``df`` that remain when its keys pass one selector behind the other."""
    kept = reduce(lambda keys, select: select(keys), selectors, df)
    return in_universe(df, kept)


def report_kind(start: str = "start_date", end: str = "end_date", report: str = "report_date", kind: str = "report_type") -> Column:
    """``annual``, ``first``, ``half`` or ``third`` for the current statement of a period that begins with its year; else null."""
    s, e = F.col(start), F.col(end)
    whole = (F.year(s) == F.year(e)) & (F.month(s) == 1) & (F.dayofmonth(s) == 1) & (e == F.last_day(e)) & (e == F.col(report)) & (F.col(kind) == 0)
    return F.when(whole, F.when(F.month(e) == 12, "annual").when(F.month(e) == 3, "first").when(F.month(e) == 6, "half").when(F.month(e) == 9, "third"))


def with_exchange(code: str = "code") -> Column:
    """The code with the suffix of its exchange by its first digit; Hong Kong codes stay; others are null."""
    c = F.col(code)
    bare = F.substring_index(c, ".", 1)
    return F.when(c.endswith(".HK"), c).when(c.startswith("6"), F.concat(bare, F.lit(".SH"))).when(c.startswith("3") | c.startswith("0"), F.concat(bare, F.lit(".SZ")))
