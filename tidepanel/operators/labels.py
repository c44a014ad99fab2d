"""Labels: what a row's instrument does over the rows that follow it.

A path is the array of structs that a window ahead collects; a path function is a
Column of that array, so labels of one's own need no Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transform import quantize

ROUND = 3e-8


def _ahead():
    return Window.partitionBy("code").orderBy("date")


def next_open_returns(bars: DataFrame, rows: int, digits: int = 4) -> DataFrame:
    """(date, code, label, label_end): return from the next row's open over so many rows; null where that open stands at a limit."""
    w = _ahead()
    free = (F.col("open") != F.col("low_limit")) & (F.col("open") != F.col("high_limit"))
    moved = bars.withColumn("_r", F.when(free, F.lead("open", rows).over(w) / F.col("open") - 1))
    label = F.round(F.lead("_r", 1).over(w) + ROUND, digits)
    return moved.select("date", "code", label.alias("label"), F.lead("date", rows + 1).over(w).alias("label_end"))


def demeaned(df: DataFrame, label: str = "label", clip: float | None = None, digits: int = 4) -> DataFrame:
    """The label less its date's mean; with ``clip``, held between that quantile of all rows and its mirror."""
    df = df.withColumn(label, F.round(F.col(label) - F.avg(label).over(Window.partitionBy("date")) + ROUND, digits))
    if clip is None:
        return df
    edges = df.agg(F.percentile(label, F.array(F.lit(clip), F.lit(1 - clip))).alias("_e"))
    return df.join(F.broadcast(edges), how="inner").withColumn(label, F.when(F.col(label).isNotNull(), F.greatest(F.least(F.col(label), F.col("_e")[1]), F.col("_e")[0]))).drop("_e")  # one row


def excess(df: DataFrame, benchmark: DataFrame, rows: int, label: str = "label", digits: int = 4) -> DataFrame:
    """The label less the return of a benchmark (date, close) over the same rows of its own calendar."""
    ahead = F.lead("close", rows).over(Window.orderBy("date")) / F.col("close") - 1  # a benchmark has one row a date
    moved = benchmark.select("date", ahead.alias("_b"))
    return df.join(moved, "date", "left").withColumn(label, F.round(F.col(label) - F.col("_b") + ROUND, digits)).drop("_b")


def with_path(bars: DataFrame, rows: int, columns: tuple[str, ...], first: int = 0) -> DataFrame:
    """Adds ``path``: the structs of the rows ``first`` to ``rows`` ahead, in order; shorter at the end of a code."""
    w = _ahead().rowsBetween(first, rows)
    return bars.withColumn("path", F.collect_list(F.struct(*columns)).over(w))


def path_labels(bars: DataFrame, rows: int, columns: tuple[str, ...], label: Callable[[Column], Column], first: int = 0, least: int | None = None) -> DataFrame:
    """(date, code, label) of a path function; null where the path has fewer than ``least`` rows (all of them by default)."""
    least = rows - first + 1 if least is None else least
    full = F.size("path") >= least
    return with_path(bars, rows, columns, first).select("date", "code", F.when(full, label(F.col("path"))).alias("label"))


def buy_and_hold(path: Column) -> Column:
    """From the first open to the last close."""
    return F.element_at(path, -1)["close"] / path[0]["open"] - 1


def hold_unless_stuck(path: Column) -> Column:
    """As ``buy_and_hold``, null where the first row is paused or opens at a limit."""
    start = path[0]
    stuck = (start["paused"] == 1) | (start["open"] == start["high_limit"]) | (start["open"] == start["low_limit"])
    return F.when(~stuck, buy_and_hold(path))


def moves(path: Column, price: str = "close") -> Column:
    """The returns from each row of a path to the next."""
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.element_at(path, i + 1)[price] / F.element_at(path, i)[price] - 1)


def mean_over_deviation(values: Column, sample: bool = True) -> Column:
    """Mean of an array over its standard deviation; null for fewer than two values or no deviation."""
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda t, v: t + v)
    square = F.aggregate(values, F.lit(0.0), lambda t, v: t + (v - total / n) * (v - total / n))
    return F.when(n > 1, F.try_divide(total / n, F.sqrt(square / (n - 1 if sample else n))))


def forward_sharpe(bars: DataFrame, rows: int, least: int, periods: int = 252, price: str = "close") -> DataFrame:
    """(date, code, label): mean over deviation, a year's worth, of the known returns over the next rows; null with fewer than ``least``."""
    known = bars.filter(F.col(price).isNotNull())
    sharpe = lambda path: F.when(F.size(path) > least, mean_over_deviation(moves(path, price)) * F.sqrt(F.lit(float(periods))))
    return path_labels(known, rows, (price,), sharpe, least=2)


def barrier_returns(bars: DataFrame, up: float, down: float, rows: int, price: str = "close") -> DataFrame:
    """(date, code, label): ``up`` or ``-down`` if the path reaches that barrier (of both, that of the earlier extreme), else its return."""
    known = bars.filter(F.col(price).isNotNull())

    def label(path: Column) -> Column:
        prices = F.transform(path, lambda p: p[price])
        start, top, low = prices[0], F.array_max(prices), F.array_min(prices)
        over, under = top >= start * (1 + up), low <= start * (1 - down)
        first = F.array_position(prices, top) <= F.array_position(prices, low)
        return F.when(over & (first | ~under), up).when(under, -down).otherwise(F.element_at(prices, -1) / start - 1)

    return path_labels(known, rows, (price,), label)


def sign_class(df: DataFrame, label: str = "label") -> DataFrame:
    """1 where the label is above zero, 0 elsewhere."""
    return df.withColumn(label, (F.col(label) > 0).cast("int"))


def group_class(df: DataFrame, bins: int, label: str = "label") -> DataFrame:
    """The label's bucket among its date, from 1."""
    return quantize(df, bins, label, "_q").withColumn(label, F.col("_q")).drop("_q")


def _dated(df: DataFrame, rows: int) -> DataFrame:
    """(date, _i, label_end) of the dates of ``df`` in order, as many as the calendar has: their numbers, and the date so many dates on."""
    w = Window.orderBy("date")
    return df.select("date").distinct().select("date", F.row_number().over(w).alias("_i"), F.lead("date", rows).over(w).alias("label_end"))


def double_mean_returns(bars: DataFrame, short: int, long: int, rows: int, unit: str = "day", price: str = "close") -> DataFrame:
    """(date, code, label, label_end): what a rule earns over the next ``rows`` dates that holds a code while its short mean is not below its long one.

    ``bars`` are bars within the unit (date, code, price), taken by the rule from the bar after its signal.  Returns are added up by unit;
    units in which the rule earns nothing on any code are no dates; a code without bars on one of the dates has no label.
    """
    w = Window.partitionBy("code").orderBy("date")
    p = F.col(price)
    mean = lambda n: F.when(F.count(p).over(w.rowsBetween(1 - n, 0)) == n, F.avg(p).over(w.rowsBetween(1 - n, 0)))
    df = bars.withColumns({"_up": mean(short) >= mean(long), "_ret": p / F.lag(p).over(w) - 1})
    df = df.withColumn("_earned", F.when(F.coalesce(F.lag("_up").over(w), F.lit(False)), F.col("_ret")).otherwise(F.lit(0.0)))
    day = df.groupBy(F.date_trunc(unit, "date").cast("date").alias("date"), "code").agg(F.coalesce(F.sum("_earned"), F.lit(0.0)).alias("_earned"))
    dates = _dated(day.filter("_earned <> 0"), rows)
    ahead = Window.partitionBy("code").orderBy("_i").rangeBetween(1, rows)
    full = day.join(dates, "date").withColumn("label", F.when(F.count("_earned").over(ahead) == rows, F.sum("_earned").over(ahead)))
    return full.select("date", "code", "label", "label_end")


def intraday_sharpe(bars: DataFrame, ahead: int, rows: int, unit: str = "day", price: str = "close", digits: int = 4) -> DataFrame:
    """(date, code, label, label_end): mean over deviation of the next ``ahead`` bars' returns as known from the last bar of a unit, scaled by the date.

    The last value of the unit that there is counts; ``label_end`` is ``rows`` dates on, null at the end.
    """
    w = Window.partitionBy("code").orderBy("date")
    p = F.col(price)
    df = bars.withColumn("_ret", p / F.lag(p).over(w) - 1)
    next_ = w.rowsBetween(1, ahead)
    sharpe = F.when(F.count("_ret").over(next_) == ahead, F.try_divide(F.avg("_ret").over(next_), F.stddev_samp("_ret").over(next_)))
    day = df.withColumn("_s", sharpe).filter("_s is not null").groupBy(F.date_trunc(unit, "date").cast("date").alias("date"), "code").agg(F.max_by("_s", "date").alias("_s"))
    on = Window.partitionBy("date")
    scaled = F.round(F.try_divide(F.col("_s") - F.avg("_s").over(on), F.stddev_samp("_s").over(on)) + ROUND, digits)
    return day.withColumn("label", scaled).filter("label is not null").join(_dated(day, rows), "date").select("date", "code", "label", "label_end")
