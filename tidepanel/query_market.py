"""Handwritten queries: limits, pauses, membership, selectors, fundamentals beside the market.

Given tables have no limits, pauses or flags.  Stand-ins: the extremes of a supplier's
last five days are its limits, a day with one small trade is a pause, and a day with one trade is flagged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expr as x
from .operators import joins, select, universe
from .queries import DENSE_SQL, bars_sql, dense
from .query_panels import BARE, _orders, simple
from .sources import panels

LIMITS_SQL = f"SELECT *, max(high) OVER w AS high_limit, min(low) OVER w AS low_limit, CAST(trades = 1 AND volume < 10 AS INT) AS paused FROM ({bars_sql('day')}) WINDOW w AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING)"


def limited(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-4, 0)
    paused = ((F.col("trades") == 1) & (F.col("volume") < 10)).cast("int")
    return panels.bars(s, d, "day").withColumns({"high_limit": F.max("high").over(w), "low_limit": F.min("low").over(w), "paused": paused})


simple("limit_flags", f"SELECT date, code, CAST(close = high_limit AS INT) AS at_high, CAST(close = low_limit AS INT) AS at_low, paused FROM ({LIMITS_SQL})", lambda s, d: limited(s, d).withColumns(universe.at_limit()).select("date", "code", "at_high", "at_low", "paused"))
simple("bars_at_close", f"SELECT CAST(date AS TIMESTAMP) + INTERVAL 15 HOUR AS date, code, close, high_limit, low_limit, paused FROM ({LIMITS_SQL}) WHERE date >= DATE '1996-01-01'", lambda s, d: panels.at_close(panels.between(limited(s, d), "1996-01-01", columns=["date", "code", "close", "high_limit", "low_limit", "paused"])))
simple(
    "one_price_limits",
    f"SELECT date, code, high = low AND close = high_limit AS at_high, high = low AND close = low_limit AS at_low, high = low AND (close = high_limit OR close = low_limit) AS either FROM ({LIMITS_SQL})",
    lambda s, d: limited(s, d).select("date", "code", universe.one_price("high").alias("at_high"), universe.one_price("low").alias("at_low"), universe.one_price().alias("either")),
)
_TRADE = "paused <> 1 AND NOT (CASE WHEN high = low THEN high = {0} ELSE {1} END)"
simple(
    "tradable",
    f"SELECT date, code, {_TRADE.format('high_limit', 'close = high_limit')} AS buy_close, {_TRADE.format('low_limit', 'close = low_limit')} AS sell_close, {_TRADE.format('high_limit', 'false')} AS buy_open, {_TRADE.format('low_limit', 'false')} AS sell_open FROM ({LIMITS_SQL})",
    lambda s, d: limited(s, d).select("date", "code", *[universe.can_trade(b, c).alias(n) for n, b, c in (("buy_close", True, True), ("sell_close", False, True), ("buy_open", True, False), ("sell_open", False, False))]),
)
simple(
    "null_where_untradable",
    f"SELECT date, code, CASE WHEN paused = 0 AND close <> high_limit AND close <> low_limit THEN volume END AS value FROM ({LIMITS_SQL})",
    lambda s, d: universe.null_where_untradable(panels.bars(s, d, "day").select("date", "code", F.col("volume").alias("value")), limited(s, d)),
)
simple("paused_selector", f"SELECT date, code, close * CASE WHEN count(paused) OVER w = 3 AND sum(paused) OVER w <= 1 THEN 1 ELSE 0 END AS value FROM ({LIMITS_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date ROWS 2 PRECEDING)", lambda s, d: universe.zero_unless_traded(limited(s, d).withColumn("value", F.col("close")), 3, 2).select("date", "code", "value"))
simple("not_flagged", f"SELECT date, code, close FROM ({bars_sql('day')}) WHERE trades > 1", lambda s, d: (lambda b: universe.not_flagged(b.select("date", "code", "close"), b.select("date", "code", (F.col("trades") == 1).alias("flag")), "flag"))(panels.bars(s, d, "day")))
simple("price_selector", f"SELECT date, code, close FROM ({BARE}) WHERE close BETWEEN 20000 AND 50000", lambda s, d: universe.price_between(dense(s, d), 20000.0, 50000.0).select("date", "code", "close"))
simple("black_list", f"SELECT date, code, close FROM ({BARE}) WHERE code NOT IN (1, 7, 9, 40)", lambda s, d: universe.listed_codes(dense(s, d), (1, 7, 9, 40), keep=False).select("date", "code", "close"))
simple("white_list", f"SELECT date, code, close FROM ({BARE}) WHERE code IN (1, 7, 9, 40)", lambda s, d: universe.listed_codes(dense(s, d), (1, 7, 9, 40)).select("date", "code", "close"))
simple(
    "listed_for",
    f"SELECT date, b.code, close FROM ({bars_sql()}) b JOIN (SELECT l_suppkey AS code, CAST(min(l_shipdate) AS DATE) AS start FROM lineitem GROUP BY 1) USING (code) WHERE date - start > 180",
    lambda s, d: select.listed_for(panels.bars(s, d), panels.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.to_date(F.min("l_shipdate")).alias("start_date")), 180).select("date", "code", "close"),
)
simple(
    "rolling_volume_selector",
    f"SELECT date, code, close FROM (SELECT *, quantile_cont(s, 0.7) OVER (PARTITION BY date) AS e FROM (SELECT *, CASE WHEN count(volume) OVER w = 3 THEN sum(volume) OVER w END AS s FROM ({DENSE_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date ROWS 2 PRECEDING))) WHERE s >= e",
    lambda s, d: universe.rolling_above_quantile(dense(s, d), "volume", 3, 0.7).select("date", "code", "close"),
)
_MONEY = f"SELECT date, code, close, CASE WHEN count(money) OVER w = 6 THEN round(avg(money) OVER w, 2) END AS m FROM ({DENSE_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date ROWS 5 PRECEDING)"
simple("traded_value_raw", f"SELECT date, code FROM ({_MONEY}) WHERE m >= 250000", lambda s, d: universe.traded_value_members(dense(s, d), 6, least=250000.0))
simple("traded_value_quantile", f"SELECT date, code FROM (SELECT *, quantile_cont(m, 0.6) OVER (PARTITION BY date) AS e FROM ({_MONEY})) WHERE m >= e", lambda s, d: universe.traded_value_members(dense(s, d), 6, q=0.6))
SNAPSHOT_SQL = f"SELECT date, code FROM ({bars_sql()}) WHERE month(date) IN (1, 7) AND volume > 100"


def snapshots(s: SparkSession, d: str) -> DataFrame:
    return panels.bars(s, d).filter(F.month("date").isin(1, 7) & (F.col("volume") > 100)).select("date", "code")


simple(
    "snapshot_universe",
    f"WITH m AS ({SNAPSHOT_SQL}), t AS (SELECT DISTINCT date AS at FROM m) SELECT b.date, b.code, b.close FROM (SELECT x.*, t.at FROM ({BARE}) x ASOF JOIN t ON x.date >= t.at) b JOIN m ON m.date = b.at AND m.code = b.code",
    lambda s, d: universe.in_snapshot(dense(s, d), snapshots(s, d)).select("date", "code", "close"),
)
simple(
    "pipeline_selector",
    f"SELECT date, code, close FROM (SELECT *, quantile_cont(close, 0.5) OVER (PARTITION BY date) AS e FROM ({BARE}) WHERE close BETWEEN 10000 AND 60000 AND code NOT IN (1, 2, 3)) WHERE close >= e",
    lambda s, d: universe.pipeline(dense(s, d), lambda k: universe.price_between(k, 10000.0, 60000.0), lambda k: universe.listed_codes(k, (1, 2, 3), keep=False), lambda k: select.above_quantile(k, 0.5, "close", strict=False)).select("date", "code", "close"),
)
simple(
    "code_suffix",
    "SELECT c AS code, CASE WHEN ends_with(c, '.HK') THEN c WHEN starts_with(c, '6') THEN split_part(c, '.', 1) || '.SH' WHEN starts_with(c, '3') OR starts_with(c, '0') THEN split_part(c, '.', 1) || '.SZ' END AS with_exchange FROM (SELECT CAST(s_suppkey % 10 AS VARCHAR) || '000' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 7 = 0 THEN '.HK' ELSE '.XSHG' END AS c FROM supplier)",
    lambda s, d: panels.table(s, d, "supplier").select(F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit("000"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 7 == 0, ".HK").otherwise(".XSHG")).alias("code")).withColumn("with_exchange", universe.with_exchange()),
)

# Statements: an order is a statement of its quarter; finished ones are of type 0.
STATEMENT_SQL = "SELECT o_custkey AS code, o_orderkey AS id, o_orderdate AS pub_date, CAST(date_trunc('year', o_orderdate) AS DATE) AS start_date, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS end_date, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) ELSE last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) END AS report_date, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS report_type, o_totalprice AS item FROM orders"


def statement_table(s: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", at)), 2))
    return panels.table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"), at.alias("pub_date"), F.to_date(F.date_trunc("year", at)).alias("start_date"), end.alias("end_date"), F.when(F.col("o_orderkey") % 5 == 0, F.to_date(at)).otherwise(end).alias("report_date"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("report_type"), F.col("o_totalprice").alias("item"))


simple(
    "statement_reader",
    f"SELECT code, id, pub_date, end_date, item FROM ({STATEMENT_SQL}) WHERE pub_date >= TIMESTAMP '1995-02-01' AND pub_date < TIMESTAMP '1996-08-01' AND year(end_date) = 1995 AND month(end_date) IN (6, 12) AND report_type = 0",
    lambda s, d: panels.read_statements(statement_table(s, d), "1995-02-01", "1996-08-01", 1995, (6, 12), 0, ["code", "id", "pub_date", "end_date", "item"]),
)
simple(
    "report_kinds",
    f"SELECT id, code, CASE WHEN end_date = report_date AND report_type = 0 THEN CASE month(end_date) WHEN 12 THEN 'annual' WHEN 3 THEN 'first' WHEN 6 THEN 'half' WHEN 9 THEN 'third' END END AS kind FROM ({STATEMENT_SQL})",
    lambda s, d: statement_table(s, d).select("id", "code", universe.report_kind().alias("kind")),
)

# Membership.
simple("index_membership", "SELECT DISTINCT CAST(date_trunc('year', l_shipdate) AS DATE) AS date, l_suppkey AS code FROM lineitem WHERE l_shipdate IS NOT NULL", lambda s, d: panels.explode_membership(panels.table(s, d, "lineitem").filter("l_shipdate is not null").groupBy(F.trunc("l_shipdate", "year").alias("date")).agg(F.create_map("date", F.collect_set("l_suppkey")).alias("members"))))


def industry_maps(s: SparkSession, d: str) -> DataFrame:
    """A row for each industry, as kept by a store of nested maps."""
    dated = panels.table(s, d, "lineitem").filter("l_shipdate is not null").select(F.trunc("l_shipdate", "year").alias("date"), F.col("l_suppkey").alias("code")).distinct()
    per = dated.join(panels.industries(s, d), "code").groupBy("industry", "date").agg(F.collect_set("code").alias("codes"))
    return per.groupBy("industry").agg(F.map_from_entries(F.collect_list(F.struct("date", "codes"))).alias("members")).select(F.create_map("industry", "members").alias("industries"))


simple("industry_membership", "SELECT DISTINCT CAST(date_trunc('year', l_shipdate) AS DATE) AS date, l_suppkey AS code, n_name AS industry FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate IS NOT NULL", lambda s, d: panels.explode_industries(industry_maps(s, d)))
CONNECT_SQL = "SELECT o_custkey AS code, o_orderdate AS date, o_orderkey AS key, o_orderpriority < '3' AS adds FROM orders"


def connect_events(s: SparkSession, d: str) -> DataFrame:
    return panels.table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("date"), F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderpriority") < "3").alias("adds"))


simple(
    "connect_membership",
    f"""SELECT DISTINCT CAST(unnest(generate_series(CAST(CASE WHEN date_trunc('month', a) < a THEN date_trunc('month', a) + INTERVAL 1 MONTH ELSE a END AS DATE), CAST(coalesce(CAST(b AS DATE) - INTERVAL 1 DAY, DATE '1998-12-01') AS DATE), INTERVAL 1 MONTH)) AS DATE) AS date, code
 FROM (SELECT code, adds, CAST(date AS DATE) AS a, lead(date) OVER (PARTITION BY code ORDER BY date, key) AS b FROM (SELECT *, lag(adds) OVER (PARTITION BY code ORDER BY date, key) AS p FROM ({CONNECT_SQL})) WHERE p IS NULL OR p <> adds) WHERE adds""",
    lambda s, d: joins.on_calendar(joins.membership_intervals(connect_events(s, d), "at"), "month", "1998-12-01"),
)
simple("trading_offset", f"SELECT date, lead(date, 3) OVER (ORDER BY date) AS shifted FROM (SELECT DISTINCT date FROM ({bars_sql('day')}))", lambda s, d: panels.shift_dates(panels.bars(s, d, "day"), 3))

# Joins of facts and market.
FACT_SQL = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS code, round(sum(o_totalprice), 2) AS {1} FROM orders WHERE {0} GROUP BY 1, 2"


def facts(s: SparkSession, d: str, where: str, name: str) -> DataFrame:
    t = panels.table(s, d, "orders").filter(where)
    return t.groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("o_custkey").alias("code")).agg(F.round(F.sum("o_totalprice"), 2).alias(name))


_F, _O, _P = ("o_orderstatus = 'F'", "done"), ("o_orderstatus = 'O'", "open"), ("o_orderstatus = 'P'", "part")
simple(
    "outer_concat",
    f"SELECT * FROM ({FACT_SQL.format(*_F)}) FULL JOIN ({FACT_SQL.format(*_O)}) USING (date, code) FULL JOIN ({FACT_SQL.format(*_P)}) USING (date, code)",
    lambda s, d: joins.outer_concat([facts(s, d, *f) for f in (_F, _O, _P)]),
)
simple(
    "market_with_fundamentals",
    f"SELECT date, code, close, last_value(done IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS done FROM ({BARE}) LEFT JOIN ({FACT_SQL.format(*_F)}) USING (date, code)",
    lambda s, d: joins.with_fundamentals(dense(s, d).select("date", "code", "close"), facts(s, d, *_F), ["done"], 4),
)
_CARRY = "SELECT date, code, {1} FROM (SELECT greatest(date, DATE '1995-06-01') AS date, code, {1}, row_number() OVER (PARTITION BY code, greatest(date, DATE '1995-06-01') ORDER BY date DESC) AS n FROM ({0})) WHERE n = 1"
simple("carried_in", _CARRY.format(FACT_SQL.format(*_F), "done"), lambda s, d: joins.carried_in(facts(s, d, *_F), "1995-06-01"))
_TWO = [f"SELECT * FROM ({_CARRY.format(FACT_SQL.format(*f), f[1])}) WHERE date <= DATE '1997-06-01' AND code IN (SELECT s_suppkey FROM supplier)" for f in (_F, _O)]
simple(
    "fundamentals_together",
    f"SELECT date, code, last_value(done IGNORE NULLS) OVER w AS done, last_value(open IGNORE NULLS) OVER w AS open FROM (({_TWO[0]}) FULL JOIN ({_TWO[1]}) USING (date, code)) WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)",
    lambda s, d: joins.fundamentals_together(facts(s, d, *_F), facts(s, d, *_O), "1995-06-01", "1997-06-01", panels.table(s, d, "supplier").select(F.col("s_suppkey").alias("code"))),
)
simple(
    "mixed_resolution",
    f"SELECT m.date, m.code, m.close, b.close AS day_close FROM ({bars_sql()}) m LEFT JOIN ({bars_sql('day')}) b ON m.date = b.date AND m.code = b.code",
    lambda s, d: panels.bars(s, d).select("date", "code", "close").join(panels.bars(s, d, "day").select("date", "code", F.col("close").alias("day_close")), ["date", "code"], "left"),
)
simple(
    "industry_benchmark",
    f"SELECT date, code, round(close - i.b + 3e-8, 3) + 0.0 AS excess FROM ({DENSE_SQL}) JOIN (SELECT date, industry, avg(close) AS b FROM ({DENSE_SQL}) GROUP BY 1, 2) i USING (date, industry) WHERE close IS NOT NULL",
    lambda s, d: (lambda b: b.filter("close is not null").join(b.groupBy("date", "industry").agg(F.avg("close").alias("b")), ["date", "industry"]).select("date", "code", (F.round(F.col("close") - F.col("b") + 3e-8, 3) + 0.0).alias("excess")))(dense(s, d)),
)
