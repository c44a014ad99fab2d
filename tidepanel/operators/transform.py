"""Cross-sectional transforms that need more than one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _date(*by: str):
    return Window.partitionBy("date", *by)


def winsorize(df: DataFrame, share: float, value: str = "value") -> DataFrame:
    """Replaces the int(share * n) lowest and highest values of a date by the nearest one kept."""
    v = F.col(value)
    up = Window.partitionBy("date", v.isNull()).orderBy(v)
    df = df.withColumns({"_r": F.row_number().over(up), "_n": F.count(v).over(_date())})
    k = F.floor(F.col("_n") * share)
    inside = F.when(v.isNotNull() & (F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k), v)
    df = df.withColumns({"_lo": F.min(inside).over(_date()), "_hi": F.max(inside).over(_date())})
    return df.withColumn(value, F.when(v.isNotNull(), F.greatest(F.least(v, "_hi"), "_lo"))).drop("_r", "_n", "_lo", "_hi")


def quantize(df: DataFrame, bins: int, value: str = "value", out: str = "quantile") -> DataFrame:
    """Bucket 1 to ``bins`` by interpolated quantile edges of the date, closed on the right; equal edges count once.

    Edges are not computed, as the last digit of a double would decide about rows that are edges: the edge i lies at the
    place (n - 1) * i / bins of the sorted values, on or above the value at its whole part and below the next one, so a value
    is above the edge if its rank, counted from 0, is above that whole part.
    """
    v = F.col(value)
    df = df.withColumns({"_r": F.rank().over(Window.partitionBy("date", v.isNull()).orderBy(v)) - 1, "_n": F.count(v).over(_date())})
    places = [F.expr(f"((_n - 1) * {i}) div {bins}") for i in range(1, bins)]
    at = lambda place: F.max(F.when(v.isNotNull() & (F.col("_r") <= place), v)).over(_date())
    df = df.withColumns({f"_{side}{i}": at(p + k) for i, p in enumerate(places) for k, side in enumerate(("v", "w"))})
    rest = [F.expr(f"((_n - 1) * {i}) % {bins}") for i in range(1, bins)]
    edges = [F.struct(F.col(f"_v{i}").alias("v"), F.when(F.col(f"_w{i}") > F.col(f"_v{i}"), r).otherwise(F.lit(0)).alias("part")) for i, r in enumerate(rest)]
    bucket = F.size(F.array_distinct(F.filter(F.array(*edges), lambda e: e["v"] < v))) + 1
    return df.withColumn(out, F.when(v.isNotNull(), bucket)).drop("_r", "_n", *[f"_{side}{i}" for i in range(bins - 1) for side in "vw"])


def industry_neutralize(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """In the order of groups, subtracts from every value the mean, over all values of the date, of what the group's members have left."""
    v = F.col(value)
    per = df.filter(v.isNotNull() & F.col(group).isNotNull()).groupBy("date", group).agg(F.sum(v).alias("s"), F.count(v).alias("n"))
    total = df.groupBy("date").agg(F.count(v).alias("_n"))
    folded = per.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "s", "n"))).alias("_g")).join(total, "date")
    shift = F.aggregate("_g", F.lit(0.0), lambda c, g: c + (g["s"] - g["n"] * c) / F.col("_n"))
    return df.join(folded.select("date", shift.alias("_c")), "date", "left").withColumn(value, v - F.coalesce("_c", F.lit(0.0))).drop("_c")


def size_industry_residual(df: DataFrame, group: str, size: str, value: str = "value") -> DataFrame:
    """Residual of a regression, each date, on group dummies and a size: both sides are demeaned within groups, which leaves one slope."""
    inside = _date(group)
    usable = F.col(value).isNotNull() & F.col(size).isNotNull() & F.col(group).isNotNull()
    keep: Column = F.when(usable, F.col(value))
    df = df.withColumns({"_y": keep - F.avg(keep).over(inside), "_x": F.when(usable, F.col(size)) - F.avg(F.when(usable, F.col(size))).over(inside)})
    slope = F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(_date()), F.sum(F.col("_x") * F.col("_x")).over(_date()))
    return df.withColumn(value, F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")).drop("_x", "_y")


def decay_fill(df: DataFrame, half_life: float, value: str = "value") -> DataFrame:
    """Carries a value forward, halved every ``half_life`` rows since it was known."""
    w = Window.partitionBy("code").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    row = F.row_number().over(w)
    df = df.withColumn("_row", row).withColumn("_known", F.when(F.col(value).isNotNull(), F.col("_row")))
    age = F.col("_row") - F.last("_known", ignorenulls=True).over(upto)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(upto) * F.pow(F.lit(0.5), age / half_life)).drop("_row", "_known")


def mean_shift(panel: DataFrame, rows: int, value: str = "value") -> DataFrame:
    """(date, code, age, strength) of the likeliest change of mean within the last ``rows`` values of a code.

    The change lies where the running sum strays farthest from that of a constant mean; age counts the rows since,
    strength is the distance in deviations times the root of the rows.  Null where the window is not full or constant.
    """
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-(rows - 1), 0)
    known = panel.filter(F.col(value).isNotNull())
    df = known.withColumn("_p", F.collect_list(F.col(value).cast("double")).over(w)).withColumn("_s", F.stddev_pop(value).over(w)).withColumn("_t", F.sum(value).over(w))
    plus = lambda t, q: t + q
    stray = F.transform(F.sequence(F.lit(1), F.lit(rows - 1)), lambda k: F.round(F.abs(F.aggregate(F.slice("_p", 1, k), F.lit(0.0), plus) - k * F.col("_t") / rows), 4))
    df = df.withColumn("_d", F.when(F.size("_p") == rows, stray)).withColumn("_m", F.array_max("_d"))
    return df.select("date", "code", F.when(F.col("_s") > 0, rows - F.array_position("_d", F.col("_m"))).alias("age"), F.try_divide(F.col("_m"), F.col("_s") * F.sqrt(F.lit(float(rows)))).alias("strength"))


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds session (0, 1 or 2 by thirds of the day), weekday (Monday 0), and how far the month's dates that occur have gone, 0 to 1."""
    day = F.to_date(ts)
    dates = df.select(day.alias("_d")).distinct()
    month = Window.partitionBy(F.trunc("_d", "month"))
    share = dates.withColumn("month_share", F.row_number().over(month.orderBy("_d")) / F.count("*").over(month))
    out = df.withColumn("session", F.floor(F.hour(ts) / 8).cast("int")).withColumn("weekday", F.weekday(ts)).withColumn("_d", day)
    return out.join(share, "_d", "left").drop("_d")


def winsorize_within(df: DataFrame, share: float, group: str, value: str = "value", standard: bool = False) -> DataFrame:
    """``winsorize`` within a group of each date; ``standard`` then takes the group's mean and sample deviation out."""
    v = F.col(value)
    up = Window.partitionBy("date", group, v.isNull()).orderBy(v)
    df = df.withColumns({"_r": F.row_number().over(up), "_n": F.count(v).over(_date(group))})
    k = F.floor(F.col("_n") * share)
    inside = F.when(v.isNotNull() & (F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k), v)
    df = df.withColumns({"_lo": F.min(inside).over(_date(group)), "_hi": F.max(inside).over(_date(group))})
    df = df.withColumn(value, F.when(v.isNotNull(), F.greatest(F.least(v, "_hi"), "_lo"))).drop("_r", "_n", "_lo", "_hi")
    return df.withColumn(value, F.try_divide(v - F.avg(v).over(_date(group)), F.stddev_samp(v).over(_date(group)))) if standard else df


def category_codes(df: DataFrame, column: str, out: str = "category") -> DataFrame:
    """Numbers from 0 in the order of the column's distinct values, which are few; null for null."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    numbered = values.withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(numbered, column, "left")


def padded_to(panel: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """(period, code, values): the panel's last date in each unit, null where the code had nothing then; a unit without any date repeats the one before."""
    period = F.to_date(F.date_trunc(unit, "date"))
    last = panel.select("date").distinct().groupBy(period.alias("period")).agg(F.max("date").alias("date"))
    ends = last.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    step = F.expr("interval 3 months") if unit == "quarter" else F.expr(f"interval 1 {unit}")
    calendar = ends.select(F.explode(F.sequence("lo", "hi", step)).alias("period")).join(last, "period", "left")
    calendar = calendar.withColumn("date", F.last("date", ignorenulls=True).over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))
    return panel.join(calendar, "date").select("period", "code", *values).na.drop(subset=values, how="all")


def factor_union(factors: dict[str, DataFrame], steps: dict[str, list], selector=None) -> DataFrame:
    """(date, code, one column a factor) of rows that all factors (date, code, value) know, each behind its steps.

    A factor's steps are functions of its panel; a list of lists of them gives as many columns, name_0 and so on.
    """
    from .joins import outer_concat

    done = []
    for name, panel in factors.items():
        chains = steps.get(name, [])
        many = bool(chains) and isinstance(chains[0], list)
        for i, chain in enumerate(chains if many else [chains]):
            out = panel
            for step in chain:
                out = step(out)
            done.append(out.select("date", "code", F.col("value").alias(f"{name}_{i}" if many else name)))
    every = outer_concat(done).na.drop()
    return selector(every) if selector else every
