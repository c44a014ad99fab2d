"""Queries of the genetic-programming factors.

Given tables have no minute bars.  Stand-in: a supplier's lines of a month are the trades of a day, in the order
of their dates; price is money over quantity, swap the quantity, and a return is against the line before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import duck
from .functions import expr as x
from .operators import joins, report
from .plans import genetic
from .queries import DENSE_SQL, dense, expressions, register
from .sources import panels

EDGE = 3
_SLICE = {"all": "true", "open": f"r <= {EDGE}", "close": f"r > n - {EDGE}", "high": "price >= m"}
_MADE = ", ".join(f"{'stddev_samp' if name.endswith('std') else 'avg'}(CASE WHEN {_SLICE[part]} THEN {column} END) AS {name}" for name, (part, column) in genetic.FEATURES.items())
FEATURES_SQL = f"""SELECT date, code, {_MADE}, CASE WHEN stddev_pop(price) > 0 AND stddev_pop(swap) > 0 THEN corr(price, swap) END AS corrpriceswap
 FROM (SELECT *, price / lag(price) OVER w - 1 AS ret, row_number() OVER w AS r, count(*) OVER g AS n, quantile_cont(price, 0.5) OVER g AS m
       FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS code, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_extendedprice / l_quantity AS price, l_quantity AS swap FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity > 0)
       WINDOW w AS (PARTITION BY date, code ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice), g AS (PARTITION BY date, code)) GROUP BY 1, 2"""
PANEL_SQL = f"SELECT * FROM (SELECT date, code FROM ({DENSE_SQL})) LEFT JOIN ({FEATURES_SQL}) USING (date, code)"


def trade_features(s: SparkSession, d: str) -> DataFrame:
    """``genetic.FEATURES`` and corrpriceswap by month and supplier."""
    keys, order = ["date", "code"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = panels.table(s, d, "lineitem").filter("l_shipdate is not null and l_extendedprice is not null and l_quantity > 0")
    trades = lines.select(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("code"), *order, (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("swap"))
    trades = trades.withColumn("ret", F.try_divide("price", F.lag("price").over(Window.partitionBy(*keys).orderBy(*order))) - 1)
    paired = report.group_correlations(trades, keys, "price", "swap").select(*keys, F.col("pearson").alias("corrpriceswap"))
    return joins.outer_concat([report.slice_features(trades, keys, order, "price", EDGE, genetic.FEATURES), paired])


for _name, _e in genetic.on_bars().items():
    expressions(_name, {"value": _e}, 1 if _name == "genetic_bars_3" else 4)

for _name, _e in genetic.on_slices().items():
    if _name.startswith("genetic_slices_5"):  # a ninth power: its cube root is shown, whose digits can be compared
        _e = x.cube_root(_e)

    def _query(s: SparkSession, d: str, e=_e) -> DataFrame:
        panel = joins.left_panels(dense(s, d).select("date", "code"), trade_features(s, d))
        return x.with_factors(panel, {"value": e}).select("date", "code", x.rounded("value", 3).alias("value"))

    register(_name, duck.sql(PANEL_SQL, {"value": _e}, digits=3))(_query)
