"""Scalar functions of dates, quarters and the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 26.2.17, of the normal distribution function (error below 7.5e-8).
RATE = 0.2316419
TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
ROOT = 0.3989422804014327

_T = f"(1 / (1 + {RATE} * abs({{0}})))"
NORMAL_SQL = f"(CASE WHEN {{0}} >= 0 THEN 1 - {ROOT} * exp(-{{0}} * {{0}} / 2) * ({' + '.join(f'{c} * pow({_T}, {i})' for i, c in enumerate(TERMS, 1))}) ELSE {ROOT} * exp(-{{0}} * {{0}} / 2) * ({' + '.join(f'{c} * pow({_T}, {i})' for i, c in enumerate(TERMS, 1))}) END)"


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    t = 1 / (1 + RATE * F.abs(x))
    sum_ = F.lit(0.0)
    for c in reversed(TERMS):
        sum_ = (sum_ + c) * t
    tail = ROOT * F.exp(-x * x / 2) * sum_
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def quarter_name(date: str | Column) -> Column:
    """A date's quarter as text, such as 1997S3."""
    return F.concat(F.year(date).cast("string"), F.lit("S"), F.quarter(date).cast("string"))


def shift_quarter(name: Column, n: int) -> Column:
    """The quarter n quarters behind that of a name (before it if negative)."""
    number = F.split(name, "S")[0].cast("int") * 4 + F.split(name, "S")[1].cast("int") - 1 + n
    return F.concat(F.floor(number / 4).cast("string"), F.lit("S"), (F.pmod(number, F.lit(4)) + 1).cast("string"))


def is_end(date: str, unit: str) -> Column:
    """Whether a date is the last day of its month, quarter or year."""
    day = F.to_date(date)
    last = day == F.last_day(day)
    return last & {"month": F.lit(True), "quarter": F.month(day) % 3 == 0, "year": F.month(day) == 12}[unit]
