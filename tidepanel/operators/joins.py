"""Joins in time: as of a date, latest vintage, carrying forward, intervals to days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, values: list[str], left_on: str = "date", right_on: str = "date", by: str = "code") -> DataFrame:
    """Each left row with the values of the latest right row of its code at or before its time.

    One union and one window: no pair of rows is formed.  At equal times the right row counts; among right rows
    of equal time the one with the greatest values.
    """
    r = right.select(F.col(by), F.col(right_on).alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    lf = left.withColumn("_row", F.struct(*left.columns)).select(F.col(by), F.col(left_on).alias("_t"), "_row", F.lit(1).alias("_side"))
    w = Window.partitionBy(by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lf, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_bucketed(left: DataFrame, right: DataFrame, values: list[str], unit: str, left_on: str = "date", right_on: str = "date", by: str = "code") -> DataFrame:
    """``asof`` for codes with very many rows: their rows are cut into buckets of a unit of time, each a task of its own.

    Within a bucket the last right row is found by a window; what a bucket does not hold itself comes from the
    buckets before it, of which only the last right row is kept, one row a bucket.
    """
    bucket = lambda df: df.withColumn("_bucket", F.date_trunc(unit, "_t"))
    r = bucket(right.select(F.col(by), F.col(right_on).cast("timestamp").alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_side")))
    lf = bucket(left.select(F.col(by), F.col(left_on).cast("timestamp").alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side")))
    inside = Window.partitionBy(by, "_bucket").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lf, allowMissingColumns=True).withColumn("_inside", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = r.groupBy(by, "_bucket").agg(F.max(F.struct("_t", "_v")).alias("_end"))
    asked = lf.select(by, "_bucket").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    # One row a bucket; a bucket takes from those before it.
    spans = ends.unionByName(asked).groupBy(by, "_bucket").agg(F.max("_end").alias("_end"))
    carry = spans.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    found = both.join(carry.select(by, "_bucket", "_carry"), [by, "_bucket"], "left").withColumn("_last", F.coalesce("_inside", F.col("_carry._v")))
    return found.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def latest_vintage(statements: DataFrame, keys: list[str], published: str) -> DataFrame:
    """Of each key the row published last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(published), *[F.desc(c) for c in statements.columns if c not in (*keys, published)])
    return statements.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def forward_fill(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Fills nulls of a code with the last value before, over at most ``limit`` rows."""
    w = Window.partitionBy("code").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0) if limit is None else w.rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def expand_intervals(intervals: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(date, code) for each day of [start, end): overlapping intervals of a code are made one, which explodes its own days, without a range join.

    The days need no comparison, as intervals made one have none in common.  Few intervals make many days, so they are dealt to
    tasks by number, which their own size would not do.
    """
    spark = intervals.sparkSession
    w = Window.partitionBy("code").orderBy("_lo", "_hi")
    known = intervals.select("code", F.to_date(start).alias("_lo"), F.to_date(end).alias("_hi")).filter("_lo < _hi")
    seen = known.withColumn("_seen", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = seen.withColumn("_n", F.count(F.when(F.col("_seen").isNull() | (F.col("_lo") > F.col("_seen")), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = spans.groupBy("code", "_n").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return joined.repartition(tasks).select(F.explode(F.sequence("_lo", F.date_sub("_hi", 1))).alias("date"), "code")


def resample_last(df: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """The last row of each code in each calendar unit."""
    g = df.groupBy(F.trunc("date", unit).alias("period"), "code")
    return g.agg(*[F.max_by(v, "date").alias(v) for v in values])


def rebased(panel: DataFrame, changes: DataFrame, prices: list[str], factor: str = "factor") -> DataFrame:
    """Prices in terms of each code's last row: times the factor known at the row over that known at the last.

    ``changes`` (code, date, factor) holds a code's cumulative factors; before the first one it is 1.
    """
    known = asof(panel, changes.select("code", F.col("date").alias("_at"), F.col(factor).alias("_f")), ["_f"], "date", "_at").withColumn("_f", F.coalesce("_f", F.lit(1.0)))
    final = F.last("_f").over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.withColumn("_f", F.try_divide("_f", final)).withColumns({p: F.col(p) * F.col("_f") for p in prices}).drop("_f")


def outer_concat(panels: list[DataFrame]) -> DataFrame:
    """Full outer join of panels (date, code, ...) of distinct columns."""
    out = panels[0]
    for panel in panels[1:]:
        out = out.join(panel, ["date", "code"], "full")
    return out


def with_fundamentals(market: DataFrame, facts: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Market rows with facts of the same date, carried forward over the code's rows (at most ``limit``)."""
    return forward_fill(market.join(facts.select("date", "code", *columns), ["date", "code"], "left"), columns, limit)


def carried_in(facts: DataFrame, start) -> DataFrame:
    """Facts (date, code, ...), of which the last one before ``start`` of each code is dated ``start``."""
    moved = facts.withColumn("_was", F.col("date")).withColumn("date", F.greatest(F.col("date"), F.lit(start).cast(facts.schema["date"].dataType)))
    w = Window.partitionBy("code", "date").orderBy(F.desc("_was"))
    return moved.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_was")


def fundamentals_together(first: DataFrame, second: DataFrame, start=None, end=None, codes: DataFrame | None = None) -> DataFrame:
    """Two fact tables outer joined by date and code, each column carried forward; facts known at ``start`` are carried in."""
    sides = []
    for facts in (first, second):
        facts = carried_in(facts, start) if start is not None else facts
        facts = facts.filter(F.col("date") <= F.lit(end)) if end is not None else facts
        sides.append(facts if codes is None else facts.join(codes.select("code").distinct(), "code", "left_semi"))
    both = outer_concat(sides)
    return forward_fill(both, [c for c in both.columns if c not in ("date", "code")])


def membership_intervals(events: DataFrame, order: str = "date") -> DataFrame:
    """(code, start_date, end_date) from events (code, date, adds): a membership runs from an addition to the code's next removal; without one the end is null."""
    w = Window.partitionBy("code").orderBy(order)
    turned = events.withColumn("_before", F.lag("adds").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("adds")))
    ends = turned.withColumn("end_date", F.lead("date").over(w)).filter("adds")
    return ends.select("code", F.col("date").alias("start_date"), "end_date")


def on_calendar(intervals: DataFrame, unit: str, until) -> DataFrame:
    """(date, code) for every first day of a calendar unit in [start, end); an open end is ``until``, itself included."""
    start = F.to_date("start_date")
    first = F.trunc(start, unit)
    first = F.when(first < start, F.add_months(first, {"month": 1, "quarter": 3, "year": 12}[unit])).otherwise(first)
    end = F.coalesce(F.date_sub(F.to_date("end_date"), 1), F.lit(until).cast("date"))
    step = F.expr(f"interval 1 {unit}") if unit != "quarter" else F.expr("interval 3 months")
    return intervals.select("code", first.alias("_a"), end.alias("_b")).filter("_a <= _b").select(F.explode(F.sequence("_a", "_b", step)).alias("date"), "code").distinct()


def left_panels(left: DataFrame, *rights: DataFrame) -> DataFrame:
    """``left`` with the columns of other panels at the same date and code."""
    for right in rights:
        left = left.join(right, ["date", "code"], "left")
    return left
