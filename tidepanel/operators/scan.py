"""Recurrences over the rows of a code: linear ones as an associative scan, others as a fold.

A step y = a * (y before) + b is a pair (a, b); two steps in turn are again a pair.  So the rows
of a code are cut into buckets of time, each bucket is folded by itself, in a task of its own, the buckets'
pairs are folded over the code, and each row is its bucket's prefix applied to the carry.  A
long history spreads over many tasks, and a bucket holds as many rows as its unit of time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _fold(rows: str, names: range, pair) -> Column:
    """The composed pairs up to each element of the array ``rows``; ``pair`` takes an element's pair of a number."""

    def append(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        parts = []
        for i in names:
            a, b = pair(e, i)
            before_a, before_b = F.coalesce(last[f"a{i}"], F.lit(1.0)), F.coalesce(last[f"b{i}"], F.lit(0.0))
            parts += [(before_a * a).alias(f"a{i}"), (a * before_b + b).alias(f"b{i}")]
        return F.concat(done, F.array(F.struct(*parts)))

    kind = "array<struct<" + ", ".join(f"a{i}: double, b{i}: double" for i in names) + ">>"
    return F.aggregate(rows, F.array().cast(kind), append)


def linear_scan(panel: DataFrame, steps: dict[str, tuple[Column, Column]], before: tuple[str, ...] = (), order: str = "date", by: str = "code") -> DataFrame:
    """``panel`` with a column for each step (a, b): y = a * (y of the row before) + b, and 0 before the first row.

    The panel has a column ``_bucket`` that does not fall in the order of ``order``.  A step of which a part is null leaves
    y as it is.  Columns named in ``before`` hold the y that the row found.
    """
    names = range(len(steps))
    pairs = []
    for i, (a, b) in enumerate(steps.values()):
        both = a.isNotNull() & b.isNotNull()
        pairs += [F.when(both, a.cast("double")).otherwise(1.0).alias(f"a{i}"), F.when(both, b.cast("double")).otherwise(0.0).alias(f"b{i}")]
    rest = [c for c in panel.columns if c not in (by, BUCKET, order)]
    element = F.struct(F.col(order), *[F.col(f"`{c}`") for c in rest], F.struct(*pairs).alias("_pair"))
    rows = panel.select(by, BUCKET, element.alias("_e")).groupBy(by, BUCKET).agg(F.sort_array(F.collect_list("_e")).alias("_rows"))
    folded = rows.withColumn("_upto", _fold("_rows", names, lambda e, i: (e["_pair"][f"a{i}"], e["_pair"][f"b{i}"])))
    # One row a bucket from here to the carry.
    whole = folded.select(by, F.struct(BUCKET, F.element_at("_upto", -1).alias("_pair")).alias("_e")).groupBy(by).agg(F.sort_array(F.collect_list("_e")).alias("_buckets"))
    ends = whole.withColumn("_upto", _fold("_buckets", names, lambda e, i: (e["_pair"][f"a{i}"], e["_pair"][f"b{i}"])))
    carry = ends.select(by, F.posexplode("_buckets").alias("_n", "_e"), "_upto").select(by, F.col(f"_e.{BUCKET}").alias(BUCKET), F.get("_upto", F.col("_n") - 1).alias("_carry"))
    joined = folded.join(carry, [by, BUCKET]).select(by, BUCKET, "_carry", "_upto", F.posexplode("_rows").alias("_n", "_e"))
    out = {}
    for i, name in enumerate(steps):
        at = F.get("_upto", F.col("_n") - (1 if name in before else 0))
        start = F.coalesce(F.col("_carry")[f"b{i}"], F.lit(0.0))
        out[name] = F.coalesce(at[f"a{i}"], F.lit(1.0)) * start + F.coalesce(at[f"b{i}"], F.lit(0.0))
    kept = [F.col(f"_e.`{c}`").alias(c) if c in (order, *rest) else F.col(c) for c in panel.columns if c not in steps]
    return joined.select(*kept, *[v.alias(k) for k, v in out.items()])


def seeded(value: Column, index: Column, n: int, alpha: float | None = None) -> tuple[Column, Column]:
    """The step of an exponential mean seeded with the mean of the first ``n`` values; ``index`` counts the values, from 1."""
    alpha = alpha or 2 / (n + 1)
    first = index <= n
    return F.when(value.isNull(), None).when(first, 1.0).otherwise(1 - alpha), F.when(first, value / n).otherwise(value * alpha)


def span_of(decay: float) -> int:
    """Steps over which ``decay`` falls to about 1e-200."""
    return max(2, int(460 / -math.log(decay))) if decay > 0 else 1 << 40


def decayed(value: Column, index: Column, n: int, alpha: float | None = None) -> tuple[Column, Column, Column]:
    """(block, place in it, term) of a seeded exponential mean as running sums: within a block the mean is decay ** place times the sum of terms.

    Terms grow as decay falls, so what a sum rounds away decays with it.  A block ends before they overflow; of the blocks before, only
    the last value of the one just before still weighs anything (``decayed_mean``).
    """
    alpha = alpha or 2 / (n + 1)
    decay = max(0.0, 1 - alpha)
    after = F.greatest(index - n, F.lit(0)).cast("long")
    span = span_of(decay)
    place = F.pmod(after, F.lit(span))
    term = F.when(index <= n, value / n).otherwise(value * alpha * F.pow(F.lit(decay), -place) if decay else F.lit(0.0))
    return F.floor(after / span), place, term


def decayed_mean(value: Column, index: Column, n: int, total: Column, before: Column, alpha: float | None = None) -> Column:
    """The mean of the block's running ``total`` of terms and the mean at the end of the block ``before``; null before it is seeded."""
    alpha = alpha or 2 / (n + 1)
    decay = max(0.0, 1 - alpha)
    if not decay:
        return F.when(index > n, value).when(index == n, total)
    block, place, _ = decayed(value, index, n, alpha)
    carried = F.when(block > 0, F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(decay), place + 1)).otherwise(0.0)
    return F.when(index >= n, total * F.pow(F.lit(decay), place) + carried)


def counted(rows: DataFrame, order: list[str], by: str, name: str) -> DataFrame:
    """``rows`` with their number, from 1, in the order of ``order``, of which ``_bucket`` is a part that does not fall: a bucket counts by itself, and takes what the buckets before it hold."""
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(by, BUCKET).orderBy(*order)))
    sizes = rows.groupBy(by, BUCKET).agg(F.count("*").alias("_size"))
    w = Window.partitionBy(by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    past = sizes.select(by, BUCKET, F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_past"))
    return inside.join(past, [by, BUCKET]).withColumn(name, F.col("_in") + F.col("_past")).drop("_in", "_past")


def means_in_order(rows: DataFrame, periods: dict[str, int], value: str, order: list[str], by: str, unit: str, at: str) -> DataFrame:
    """``rows`` with exponential means of ``value``, which is never null, however many rows ``by`` holds: numbered by buckets of ``unit`` of the time ``at``, then summed by blocks."""
    df = counted(rows.withColumn(BUCKET, F.date_trunc(unit, at)), order, by, "_k").drop(BUCKET)
    for name, n in periods.items():
        block, place, term = decayed(F.col(value), F.col("_k"), n)
        span = span_of(1 - 2 / (n + 1)) if n > 1 else span_of(0.0)
        df = df.withColumns({"_block": block, "_term": term})
        total = F.sum("_term").over(Window.partitionBy(by, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_total", total)
        # One row a block.
        ends = df.filter((place == span - 1) & (F.col("_k") >= n)).select(by, (F.col("_block") + 1).alias("_block"), (F.col("_total") * F.pow(F.lit(1 - 2 / (n + 1)), place)).alias("_before"))
        df = df.join(ends, [by, "_block"], "left")
        df = df.withColumn(name, decayed_mean(F.col(value), F.col("_k"), n, F.col("_total"), F.col("_before"))).drop("_block", "_term", "_total", "_before")
    return df


def sma_period(n: int, m: int = 1) -> int:
    """The period of the mean that weighs a new value m / n, cut to whole rows."""
    return int(2 / (m / n) - 1)


def _known(name: str, index: str, n: int, value: str) -> Column:
    return F.when(F.col(value).isNotNull() & (F.col(index) >= n), F.col(name))


def exponential_means(panel: DataFrame, periods: dict[str, int], value: str, unit: str = "year") -> DataFrame:
    """``panel`` with exponential means of ``value``, null before they are seeded and where the value is."""
    df = panel.withColumn(BUCKET, F.date_trunc(unit, "date"))
    df = linear_scan(df, {"_k": (F.lit(1.0), F.when(F.col(value).isNotNull(), 1.0))})
    df = linear_scan(df, {k: seeded(F.col(value), F.col("_k"), n) for k, n in periods.items()})
    return df.withColumns({k: _known(k, "_k", n, value) for k, n in periods.items()}).drop("_k", BUCKET)


def indicators(panel: DataFrame, price: str = "close", unit: str = "year") -> DataFrame:
    """(date, code, ema_6, sma_6_2, rsi_6, macd, macd_signal) from prices; ``unit`` is the time of a bucket."""
    p, one = F.col("_p"), F.lit(1.0)
    df = panel.select("date", "code", F.col(price).cast("double").alias("_p")).withColumn(BUCKET, F.date_trunc(unit, "date"))
    # The price of the row before, known or not, and how many are known.
    df = linear_scan(df, {"_k": (one, F.when(p.isNotNull(), 1.0)), "_last": (F.lit(0.0), F.coalesce(p, F.lit(0.0))), "_there": (F.lit(0.0), F.when(p.isNotNull(), 1.0).otherwise(0.0))}, before=("_last", "_there"))
    df = df.withColumn("_step", F.when(F.col("_there") > 0.5, p - F.col("_last")))
    s, k = F.col("_step"), F.col("_k")
    means = {"ema_6": 6, "sma_6_2": sma_period(6, 2), "_fast": 12, "_slow": 26}
    df = linear_scan(df, {"_j": (one, F.when(s.isNotNull(), 1.0)), **{name: seeded(p, k, n) for name, n in means.items()}})
    df = df.withColumns({name: _known(name, "_k", n, "_p") for name, n in means.items()}).withColumn("macd", F.col("_fast") - F.col("_slow"))
    up, down, j = F.greatest(s, F.lit(0.0)), F.greatest(-s, F.lit(0.0)), F.col("_j")
    # greatest skips nulls, so a step that is null is kept out.
    only = lambda v: F.when(s.isNotNull(), v)
    df = linear_scan(df, {"_up": seeded(only(up), j, 6, 1 / 6), "_down": seeded(only(down), j, 6, 1 / 6), "macd_signal": seeded(F.col("macd"), k - 25, 9)})
    rsi = F.when(s.isNotNull() & (j >= 6), F.try_divide(100 * F.col("_up"), F.col("_up") + F.col("_down")))
    signal = F.when(F.col("macd").isNotNull() & (k - 25 >= 9), F.col("macd_signal"))
    return df.select("date", "code", "ema_6", "sma_6_2", rsi.alias("rsi_6"), "macd", signal.alias("macd_signal"))


def adaptive_mean(panel: DataFrame, value: str, n: int = 6, fast: int = 2, slow: int = 30, unit: str = "year") -> DataFrame:
    """(date, code, adaptive): exponential mean whose weight follows how straight the last n steps went, over the known values; it starts from the n-th and is given after it."""
    p = F.col("_p")
    w = Window.partitionBy("code").orderBy("date")
    df = panel.filter(F.col(value).isNotNull()).select("date", "code", F.col(value).cast("double").alias("_p"))
    df = df.withColumn("_move", F.abs(p - F.lag("_p").over(w)))
    path, far = F.sum("_move").over(w.rowsBetween(1 - n, 0)), F.abs(p - F.lag("_p", n).over(w))
    straight = F.coalesce(F.try_divide(far, path), F.lit(0.0))
    weight = F.pow(straight * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), F.lit(2.0))
    df = df.withColumns({"_w": weight, "_k": F.row_number().over(w).cast("double")}).withColumn(BUCKET, F.date_trunc(unit, "date")).drop("_move")
    k = F.col("_k")
    a = F.when(k < n, 1.0).when(k == n, 0.0).otherwise(1 - F.col("_w"))
    b = F.when(k < n, 0.0).when(k == n, p).otherwise(F.col("_w") * p)
    df = linear_scan(df, {"adaptive": (a, b)})
    return df.select("date", "code", F.when(k > n, F.col("adaptive")).alias("adaptive"))


def parabolic_stop(panel: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """(date, code, stop) from high and low: a stop-and-reverse level that closes in on the extreme of a trend, faster with every new one, and flips when passed.

    The state does not compose, so a code's history, bounded by the calendar, is folded in order; null in the first row.
    """
    row = F.struct("date", F.col("high").cast("double").alias("h"), F.col("low").cast("double").alias("l"))
    known = panel.filter("high is not null and low is not null")
    history = known.groupBy("code").agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def begin(first: Column, second: Column) -> Column:
        up = ~(first["l"] - second["l"] > F.greatest(second["h"] - first["h"], F.lit(0.0)))
        parts = (up, F.when(up, first["l"]).otherwise(first["h"]), F.when(up, second["h"]).otherwise(second["l"]), F.lit(step), first["h"], first["l"], F.array().cast("array<double>"))
        return F.struct(*parts).cast("struct<up: boolean, stop: double, extreme: double, pace: double, h: double, l: double, out: array<double>>")

    def follow(s: Column, e: Column) -> Column:
        passed = F.when(s["up"], e["l"] <= s["stop"]).otherwise(e["h"] >= s["stop"])
        up = s["up"] != passed
        level = F.when(~passed, s["stop"]).when(up, F.least(s["extreme"], e["l"], s["l"])).otherwise(F.greatest(s["extreme"], e["h"], s["h"]))
        further = F.when(s["up"], e["h"] > s["extreme"]).otherwise(e["l"] < s["extreme"])
        extreme = F.when(passed | further, F.when(up, e["h"]).otherwise(e["l"])).otherwise(s["extreme"])
        pace = F.when(passed, step).when(further, F.least(F.lit(most), s["pace"] + step)).otherwise(s["pace"])
        moved = level + pace * (extreme - level)
        held = F.when(up, F.least(moved, e["l"], s["l"])).otherwise(F.greatest(moved, e["h"], s["h"]))
        return F.struct(up.alias("up"), held.alias("stop"), extreme.alias("extreme"), pace.alias("pace"), e["h"].alias("h"), e["l"].alias("l"), F.concat(s["out"], F.array(level)).alias("out"))

    levels = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))), begin(F.get("_rows", F.lit(0)), F.coalesce(F.get("_rows", F.lit(1)), F.get("_rows", F.lit(0)))), follow, lambda s: s["out"])
    # Zipped before they are dealt out: beside a generator the fold would run again for every row of the history.
    stops = F.concat(F.array(F.lit(None).cast("double")), levels)
    zipped = history.select("code", F.arrays_zip(F.col("_rows.date").alias("date"), stops.alias("stop")).alias("_out"))
    return zipped.select("code", F.inline("_out").alias("date", "stop")).select("date", "code", "stop")


def trailing_levels(panel: DataFrame, n: int = 6) -> DataFrame:
    """(date, code, adaptive, stop) of close, high and low, for every row of the panel."""
    return panel.select("date", "code").join(adaptive_mean(panel, "close", n), ["date", "code"], "left").join(parabolic_stop(panel), ["date", "code"], "left")
