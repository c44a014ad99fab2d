"""Features of a day from its ticks: one row for each date and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """(date, code, slot, open, high, low, close, volume, money) of ticks (ts, code, price, volume, key); the key orders ticks of one time."""
    order = F.struct("ts", "key")
    return ticks.groupBy(F.to_date("ts").alias("date"), "code", F.date_trunc(unit, "ts").alias("slot")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").cast("double").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("money"),
    )


def _day() -> Window:
    return Window.partitionBy("date", "code")


def realized(slots_: DataFrame, noon: int = 12) -> DataFrame:
    """(date, code, ...): moments of the slots' log moves, jump share, volume shares and the path's efficiency."""
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(_day().orderBy("slot"))))
    df = slots_.withColumn("r", r).withColumn("r1", F.lag("r").over(_day().orderBy("slot"))).withColumn("total", F.sum("volume").over(_day()))
    share = F.try_divide(F.col("volume"), F.col("total"))
    n, sq = F.count("r"), F.col("r") * F.col("r")
    rv = F.sum(sq)
    sums = df.groupBy("date", "code").agg(
        rv.alias("variance"),
        F.try_divide(F.sqrt(n) * F.sum(sq * F.col("r")), F.pow(rv, F.lit(1.5))).alias("skew"),
        F.try_divide(n * F.sum(sq * sq), rv * rv).alias("kurt"),
        F.try_divide(F.sum(F.when(F.col("r") > 0, sq).otherwise(0.0)), rv).alias("up_share"),
        (F.sum(F.abs(F.col("r") * F.col("r1"))) * 1.5707963267948966).alias("bipower"),
        F.sum(F.when(F.hour("slot") < noon, share).otherwise(0.0)).alias("morning_share"),
        F.sum(F.when(share > 0, -share * F.ln(share)).otherwise(0.0)).alias("entropy"),
        F.max(share).alias("peak_share"),
        F.try_divide(F.try_divide(F.sum("money"), F.sum("volume")), F.max_by("close", "slot")).alias("vwap_ratio"),
        F.try_divide(F.sum("r"), F.sum(F.abs("r"))).alias("efficiency"),
    )
    return sums.withColumn("jump_share", F.greatest(F.lit(0.0), 1 - F.try_divide("bipower", "variance"))).drop("bipower")


def smart_money(slots_: DataFrame, share: float = 0.2, root: float = 0.5) -> DataFrame:
    """(date, code, q): mean price of the slots that move most for their volume, up to a share of the day's volume, over that of all."""
    move = F.abs(F.try_divide(F.col("close"), F.col("open")) - 1)
    df = slots_.filter("volume > 0").withColumn("s", F.round(move / F.pow("volume", F.lit(root)), 12))
    upto = _day().orderBy(F.desc("s"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("smart", F.sum("volume").over(upto) <= F.sum("volume").over(_day()) * share)
    of = lambda c: F.sum(F.when(F.col("smart"), F.col(c)))
    return df.groupBy("date", "code").agg(F.try_divide(F.try_divide(of("money"), of("volume")), F.try_divide(F.sum("money"), F.sum("volume"))).alias("q"))


def order_flow(trades: DataFrame, small: float, large: float) -> DataFrame:
    """(date, code, buy_sm, sell_sm, buy_md, ...): money of trades (date, code, side, size, money) by side and size; below ``small``, above ``large``, and between."""
    kind: Column = F.when(F.col("size") < small, "sm").when(F.col("size") > large, "lg").otherwise("md")
    sums = [F.round(F.sum(F.when((kind == k) & (F.col("side") == s), F.col("money")).otherwise(0.0)), 2).alias(f"{name}_{k}") for s, name in ((1, "buy"), (-1, "sell")) for k in ("sm", "md", "lg")]
    return trades.groupBy("date", "code").agg(*sums)
