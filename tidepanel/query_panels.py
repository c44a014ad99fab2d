"""Handwritten queries: sources, joins, selection, labels, evaluation, portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import duck
from .functions import expr as x
from .operators import evaluate, joins, select, statements, transform
from .plans import library
from .queries import DENSE_SQL, bars_sql, dense, expressions, register
from .sources import panels
from .streaming.bars import event_bars

c = x.col("close")
REV = {"value": -x.returns(c)}
REV_SQL = f"({duck.sql(DENSE_SQL, REV, ('date', 'code', 'close', 'sector', 'cap'))})"
BARE = "SELECT date, code, close, sector, cap FROM (" + DENSE_SQL + ")"


def reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = x.with_factors(dense(spark, sf_dir), REV).select("date", "code", "close", "sector", "cap", x.rounded("value", 6).alias("value"))
    return df


def simple(name: str, sql: str, make) -> None:
    register(name, sql)(lambda spark, sf_dir: make(spark, sf_dir))


BAR_COLUMNS = "date, code, open, high, low, close, volume, money, trades"
simple("bars_month", f"SELECT {BAR_COLUMNS} FROM ({bars_sql()})", lambda s, d: panels.bars(s, d).drop("vwap"))
simple("bars_day", f"SELECT {BAR_COLUMNS} FROM ({bars_sql('day')})", lambda s, d: panels.bars(s, d, "day").drop("vwap"))
simple("bars_day_part", f"SELECT {BAR_COLUMNS} FROM ({bars_sql('day', 'l_partkey')})", lambda s, d: panels.bars(s, d, "day", "l_partkey").drop("vwap"))
simple("densify", f"SELECT date, code, close FROM ({DENSE_SQL})", lambda s, d: panels.densify(panels.bars(s, d)).select("date", "code", "close"))
simple(
    "scan_pushdown",
    f"SELECT date, code, close FROM ({bars_sql()}) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-01' AND code IN (1, 2, 3)",
    lambda s, d: panels.between(panels.bars(s, d), "1996-01-01", "1997-06-01", [1, 2, 3], ["date", "code", "close"]),
)
simple("price_forms", f"SELECT date, code, (open+high+low+close)/4 AS ohlc4, (open+high+low)/3 AS ohl3, (open+high+close)/3 AS ohc3, (high+low)/2 AS hl2, (open+close)/2 AS oc2 FROM ({bars_sql()})", lambda s, d: panels.with_price_forms(panels.bars(s, d)).select("date", "code", "ohlc4", "ohl3", "ohc3", "hl2", "oc2"))

# Joins.


def _orders(s, d):
    return panels.table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("pub_date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))


def _quarter_ends(s, d):
    return panels.table(s, d, "customer").select(F.col("c_custkey").alias("code"), F.explode(F.sequence(F.lit("1995-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"), F.expr("interval 3 months"))).alias("date"))


QUERY_TIMES_SQL = """SELECT q.code, CAST(q.date AS DATE) AS date, r.price FROM (SELECT c_custkey AS code, unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01', INTERVAL 3 MONTH)) AS date FROM customer) q
 ASOF LEFT JOIN (SELECT o_custkey AS code, o_orderdate AS pub, max(o_totalprice) AS price FROM orders GROUP BY 1, 2) r ON q.code = r.code AND q.date >= r.pub"""
simple(
    "asof_join",
    QUERY_TIMES_SQL,
    lambda s, d: joins.asof(_quarter_ends(s, d), _orders(s, d), ["price"], "date", "pub_date").select("code", F.to_date("date").alias("date"), "price"),
)
simple(
    "latest_vintage",
    "SELECT code, quarter, price FROM (SELECT o_custkey AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate) ORDER BY o_orderdate DESC, o_totalprice DESC) AS n FROM orders) WHERE n = 1",
    lambda s, d: joins.latest_vintage(_orders(s, d).select("code", F.to_date(F.date_trunc("quarter", "pub_date")).alias("quarter"), "pub_date", "price"), ["code", "quarter"], "pub_date").select("code", "quarter", "price"),
)
simple("forward_fill", f"SELECT date, code, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close FROM ({DENSE_SQL})", lambda s, d: joins.forward_fill(dense(s, d), ["close"], 2).select("date", "code", "close"))
simple(
    "expand_intervals",
    "SELECT DISTINCT CAST(unnest(generate_series(CAST(lo AS DATE), CAST(hi AS DATE) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date, code FROM (SELECT c_custkey AS code, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) WHERE CAST(lo AS DATE) < CAST(hi AS DATE)",
    lambda s, d: joins.expand_intervals(_orders(s, d).join(panels.table(s, d, "customer"), F.col("code") == F.col("c_custkey"), "left_semi").groupBy("code").agg(F.min("pub_date").alias("start_date"), F.max("pub_date").alias("end_date"))),
)
simple("resample_year", f"SELECT CAST(date_trunc('year', date) AS DATE) AS period, code, arg_max(close, date) AS close FROM ({bars_sql()}) GROUP BY 1, 2", lambda s, d: joins.resample_last(panels.bars(s, d), "year", ["close"]))
simple("semi_universe", f"SELECT date, code, close FROM ({BARE}) WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", lambda s, d: select.in_universe(dense(s, d), panels.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code")), ("code",)).select("date", "code", "close"))
simple("anti_universe", f"SELECT date, code, close FROM ({BARE}) WHERE code NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", lambda s, d: select.out_of_universe(dense(s, d), panels.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code")), ("code",)).select("date", "code", "close"))
simple("benchmark_join", f"SELECT date, code, round(value - avg(value) OVER (PARTITION BY date), 5) AS excess FROM {REV_SQL}", lambda s, d: (lambda r: r.join(r.groupBy("date").agg(F.avg("value").alias("b")), "date").select("date", "code", F.round(F.col("value") - F.col("b"), 5).alias("excess")))(reversal(s, d)))
simple("set_operations", "SELECT l_suppkey AS code FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey < 5", lambda s, d: (lambda t: t.filter("l_quantity > 49").select(F.col("l_suppkey").alias("code")).intersect(t.filter("l_discount > 0.09").select("l_suppkey")).subtract(panels.table(s, d, "supplier").filter("s_nationkey < 5").select("s_suppkey")))(panels.table(s, d, "lineitem")))

# Selection and weights.
PICK = "SELECT date, code, value FROM"
simple("top_n", f"{PICK} (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS n FROM {REV_SQL} WHERE value IS NOT NULL) WHERE n <= 5", lambda s, d: select.top_n(reversal(s, d), 5).select("date", "code", "value"))
simple("bottom_n", f"{PICK} (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, code) AS n FROM {REV_SQL} WHERE value IS NOT NULL) WHERE n <= 5", lambda s, d: select.bottom_n(reversal(s, d), 5).select("date", "code", "value"))
simple("sector_top_n", f"{PICK} (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY value DESC, code) AS n FROM {REV_SQL} WHERE value IS NOT NULL) WHERE n <= 2", lambda s, d: select.top_n(reversal(s, d), 2, by=("sector",)).select("date", "code", "value"))
simple("top_quantile", f"{PICK} (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY date) AS e FROM {REV_SQL}) WHERE value > e", lambda s, d: select.above_quantile(reversal(s, d), 0.8).select("date", "code", "value"))
simple("bottom_quantile", f"{PICK} (SELECT *, quantile_cont(value, 0.2) OVER (PARTITION BY date) AS e FROM {REV_SQL}) WHERE value < e", lambda s, d: select.below_quantile(reversal(s, d), 0.2).select("date", "code", "value"))
simple("equal_weight", f"SELECT date, code, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM {REV_SQL} WHERE value > 0", lambda s, d: select.equal_weight(reversal(s, d).filter("value > 0")).select("date", "code", F.round("weight", 6).alias("weight")))
simple("cap_weight", f"SELECT date, code, round(cap / sum(cap) OVER (PARTITION BY date), 6) AS weight FROM {REV_SQL} WHERE value > 0", lambda s, d: select.proportional_weight(reversal(s, d).filter("value > 0"), "cap").select("date", "code", F.round("weight", 6).alias("weight")))
simple("long_short_weight", f"SELECT date, code, round(x / nullif(sum(abs(x)) OVER (PARTITION BY date), 0), 5) AS weight FROM (SELECT *, value - avg(value) OVER (PARTITION BY date) AS x FROM {REV_SQL} WHERE value IS NOT NULL)", lambda s, d: select.long_short_weight(reversal(s, d).filter("value is not null")).select("date", "code", F.round("weight", 5).alias("weight")))

# Transforms.
simple(
    "winsorize",
    f"""SELECT date, code, CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END AS value FROM (SELECT *, max(k) OVER (PARTITION BY date) AS hi, min(k) OVER (PARTITION BY date) AS lo FROM
 (SELECT *, CASE WHEN value IS NOT NULL AND r > floor(n * 0.05) AND r <= n - floor(n * 0.05) THEN value END AS k FROM (SELECT *, row_number() OVER (PARTITION BY date, value IS NULL ORDER BY value) AS r, count(value) OVER (PARTITION BY date) AS n FROM {REV_SQL})))""",
    lambda s, d: transform.winsorize(reversal(s, d), 0.05).select("date", "code", "value"),
)
simple("quantize_5", f"SELECT date, code, 1 + CAST(value > a AS INT) + CAST(value > b AS INT) + CAST(value > c AS INT) + CAST(value > d AS INT) AS quantile FROM (SELECT *, quantile_cont(value, 0.2) OVER w AS a, quantile_cont(value, 0.4) OVER w AS b, quantile_cont(value, 0.6) OVER w AS c, quantile_cont(value, 0.8) OVER w AS d FROM (SELECT date, code, close AS value FROM ({BARE})) WINDOW w AS (PARTITION BY date))", lambda s, d: transform.quantize(dense(s, d).withColumn("value", F.col("close")), 5).select("date", "code", "quantile"))
simple(
    "industry_neutralize",
    f"""WITH b AS (SELECT * FROM ({BARE})), n AS (SELECT date, count(close) AS n FROM b GROUP BY 1), g AS (SELECT date, list(struct_pack(s := s, k := k) ORDER BY sector) AS g FROM (SELECT date, sector, sum(close) AS s, count(close) AS k FROM b WHERE close IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
 SELECT b.date, b.code, round(close - list_reduce(list_prepend(0.0, list_transform(range(0, len(g)), lambda i: CAST(i AS DOUBLE))), lambda c, i: c + (g[CAST(i AS INT) + 1].s - g[CAST(i AS INT) + 1].k * c) / n), 3) AS value FROM b JOIN n USING (date) JOIN g USING (date)""",
    lambda s, d: transform.industry_neutralize(dense(s, d).withColumn("value", F.col("close")), "sector").select("date", "code", F.round("value", 3).alias("value")),
)
simple(
    "size_industry_residual",
    f"""SELECT date, code, round(y - coalesce(sum(x * y) OVER (PARTITION BY date) / nullif(sum(x * x) OVER (PARTITION BY date), 0), 0) * x, 3) AS value FROM
 (SELECT date, code, close - avg(close) OVER (PARTITION BY date, sector) AS y, CASE WHEN close IS NOT NULL THEN ln(cap) END - avg(CASE WHEN close IS NOT NULL THEN ln(cap) END) OVER (PARTITION BY date, sector) AS x FROM ({BARE}))""",
    lambda s, d: transform.size_industry_residual(dense(s, d).withColumns({"value": F.col("close"), "size": F.ln("cap")}), "sector", "size").select("date", "code", F.round("value", 3).alias("value")),
)
simple("decay_fill", f"SELECT date, code, round(last_value(close IGNORE NULLS) OVER w * pow(0.5, (r - last_value(CASE WHEN close IS NOT NULL THEN r END IGNORE NULLS) OVER w) / 3.0), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS r FROM ({BARE})) WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)", lambda s, d: transform.decay_fill(dense(s, d).withColumn("value", F.col("close")), 3.0).select("date", "code", F.round("value", 4).alias("value")))

# Labels and evaluation.
FWD_SQL = f"SELECT date, code, round(lead(close, 1) OVER w / close - 1, 4) AS forward_1, round(lead(close, 3) OVER w / close - 1, 4) AS forward_3, CAST(lead(date, 1) OVER w AS DATE) AS end_1, CAST(lead(date, 3) OVER w AS DATE) AS end_3 FROM ({BARE}) WINDOW w AS (PARTITION BY code ORDER BY date)"
simple("forward_returns", FWD_SQL, lambda s, d: evaluate.forward_returns(dense(s, d), (1, 3)))


def labelled(s: SparkSession, d: str) -> DataFrame:
    f = REV | {"label": x.lead(c, 1) / c - 1.0}
    return x.with_factors(dense(s, d), f).select("date", "code", "close", "cap", F.round("value", 6).alias("value"), F.round("label", 4).alias("label"))


LAB_SQL = f"(SELECT date, code, close, cap, round(-1.0 * (close / nullif(p, 0) - 1), 6) AS value, round(n / nullif(close, 0) - 1, 4) AS label FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS p, lead(close) OVER (PARTITION BY code ORDER BY date) AS n FROM ({BARE})))"
IC_SQL = f"SELECT date, corr(a, b) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS b FROM {LAB_SQL} WHERE value IS NOT NULL AND label IS NOT NULL) GROUP BY date"
simple("rank_ic", f"SELECT date, round(ic, 6) AS ic FROM ({IC_SQL})", lambda s, d: evaluate.information_coefficient(labelled(s, d)).select("date", F.round("ic", 6).alias("ic")))
simple("ic_summary", f"SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 5) AS ir, round(avg(CASE WHEN abs(ic) >= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS ability, count(ic) AS n FROM ({IC_SQL})", lambda s, d: evaluate.ic_summary(evaluate.information_coefficient(labelled(s, d))).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("ir", 5).alias("ir"), F.round("ability", 6).alias("ability"), "n"))
simple(
    "quantile_returns",
    f"SELECT date, 1 + CAST(value > a AS INT) + CAST(value > b AS INT) + CAST(value > c AS INT) + CAST(value > d AS INT) AS quantile, round(avg(label), 6) AS mean_return, count(*) AS n FROM (SELECT *, quantile_cont(value, 0.2) OVER w AS a, quantile_cont(value, 0.4) OVER w AS b, quantile_cont(value, 0.6) OVER w AS c, quantile_cont(value, 0.8) OVER w AS d FROM {LAB_SQL} WHERE value IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY date)) GROUP BY 1, 2",
    lambda s, d: evaluate.quantile_returns(labelled(s, d), 5).select("date", "quantile", F.round("mean_return", 6).alias("mean_return"), "n"),
)
HELD_SQL = f"SELECT date, sum(label / k) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS r FROM {LAB_SQL} WHERE value IS NOT NULL) WHERE r <= 10) WHERE label IS NOT NULL GROUP BY date"


def held(s: SparkSession, d: str) -> DataFrame:
    df = labelled(s, d)
    picked = select.equal_weight(select.top_n(df, 10)).select("date", "code", "weight")
    return evaluate.portfolio_value(picked, df.filter("label is not null").select("date", "code", F.col("label").alias("ret")))


simple("portfolio_value", f"SELECT date, round(ret, 5) AS ret, round(ln(nav), 6) AS log_nav, round(nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 4) AS drawdown FROM (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM ({HELD_SQL}))", lambda s, d: held(s, d).select("date", F.round("ret", 5).alias("ret"), F.round(F.ln("nav"), 6).alias("log_nav"), F.round("drawdown", 4).alias("drawdown")))
simple("portfolio_metrics", f"SELECT round(avg(ret), 5) AS mean, round(stddev_samp(ret), 5) AS std, round(avg(ret) / stddev_samp(ret) * sqrt(12), 4) AS sharpe, round(max(ret), 5) AS best, round(min(ret), 5) AS worst, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate FROM ({HELD_SQL})", lambda s, d: evaluate.metrics(held(s, d)).select(*[F.round(k, n).alias(k) for k, n in (("mean", 5), ("std", 5), ("sharpe", 4), ("best", 5), ("worst", 5), ("win_rate", 5))]))
simple("event_bars", "SELECT date_trunc('day', ts) AS ts, event_type AS code, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", lambda s, d: event_bars(panels.table(s, d, "events")))

# Families of factors.
for _family, _factors in library.groups().items():
    expressions(f"factors_{_family}", _factors, 4)

# Statements: a customer's orders add up within a year, quarter by quarter.
YTD_SQL = "SELECT code, period, sum(total) OVER (PARTITION BY code, year(period) ORDER BY period) AS ytd, pub FROM (SELECT o_custkey AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS pub FROM orders GROUP BY 1, 2)"
Q_SQL = f"SELECT a.code, a.period, CASE WHEN quarter(a.period) = 1 THEN a.ytd ELSE a.ytd - b.ytd END AS single, a.ytd, a.pub FROM ({YTD_SQL}) a LEFT JOIN ({YTD_SQL}) b ON a.code = b.code AND b.period = a.period - INTERVAL 3 MONTH"


def year_to_date(s: SparkSession, d: str) -> DataFrame:
    per = _orders(s, d).groupBy("code", F.to_date(F.date_trunc("quarter", "pub_date")).alias("period")).agg(F.round(F.sum("price"), 2).alias("total"), F.max("pub_date").alias("pub"))
    w = Window.partitionBy("code", F.year("period")).orderBy("period")
    return per.select("code", "period", F.sum("total").over(w).alias("ytd"), "pub")


def quarters(s: SparkSession, d: str) -> DataFrame:
    return statements.single_quarter(year_to_date(s, d), "ytd", "single")


simple("single_quarter", f"SELECT code, period, round(single, 2) AS single FROM ({Q_SQL})", lambda s, d: quarters(s, d).select("code", "period", F.round("single", 2).alias("single")))
simple(
    "trailing_year",
    f"SELECT a.code, a.period, round(CASE WHEN count(b.single) = 4 THEN sum(b.single) END + 3e-8, 1) AS ttm, round(avg(b.single) + 3e-8, 1) AS mean_4 FROM ({Q_SQL}) a LEFT JOIN ({Q_SQL}) b ON a.code = b.code AND b.period <= a.period AND b.period >= a.period - INTERVAL 9 MONTH GROUP BY 1, 2",
    lambda s, d: statements.average_of_last(statements.trailing_year(quarters(s, d), "single", "ttm"), "single", "mean_4").select("code", "period", x.rounded("ttm", 1).alias("ttm"), x.rounded("mean_4", 1).alias("mean_4")),
)
simple("year_over_year", f"SELECT a.code, a.period, round((a.ytd - b.ytd) / nullif(abs(b.ytd), 0) + 3e-8, 4) + 0.0 AS growth FROM ({YTD_SQL}) a LEFT JOIN ({YTD_SQL}) b ON a.code = b.code AND b.period = a.period - INTERVAL 1 YEAR", lambda s, d: statements.year_over_year(year_to_date(s, d), "ytd", "growth").select("code", "period", x.rounded("growth", 4).alias("growth")))
simple(
    "statement_surprise",
    f"WITH g AS (SELECT a.code, a.period, a.ytd - b.ytd AS g FROM ({YTD_SQL}) a LEFT JOIN ({YTD_SQL}) b ON a.code = b.code AND b.period = a.period - INTERVAL 1 YEAR) SELECT a.code, a.period, round((a.g - avg(b.g)) / nullif(stddev_samp(b.g), 0) + 3e-8, 3) + 0.0 AS surprise FROM g a LEFT JOIN g b ON a.code = b.code AND b.period < a.period AND b.period >= a.period - INTERVAL 24 MONTH GROUP BY a.code, a.period, a.g",
    lambda s, d: statements.surprise(year_to_date(s, d), "ytd", "surprise").select("code", "period", x.rounded("surprise", 3).alias("surprise")),
)
simple(
    "known_statements",
    f"SELECT q.code, CAST(q.date AS DATE) AS date, r.ytd FROM (SELECT c_custkey AS code, unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01', INTERVAL 3 MONTH)) AS date FROM customer) q ASOF LEFT JOIN ({YTD_SQL}) r ON q.code = r.code AND q.date >= r.pub",
    lambda s, d: statements.as_known(_quarter_ends(s, d), year_to_date(s, d), ["ytd"], "pub").select("code", F.to_date("date").alias("date"), "ytd"),
)

# More of evaluation.
SPREAD_SQL = f"SELECT date, avg(CASE WHEN quantile = 5 THEN label END) - avg(CASE WHEN quantile = 1 THEN label END) AS spread FROM (SELECT date, label, 1 + CAST(value > a AS INT) + CAST(value > b AS INT) + CAST(value > c AS INT) + CAST(value > d AS INT) AS quantile FROM (SELECT *, quantile_cont(value, 0.2) OVER w AS a, quantile_cont(value, 0.4) OVER w AS b, quantile_cont(value, 0.6) OVER w AS c, quantile_cont(value, 0.8) OVER w AS d FROM {LAB_SQL} WHERE value IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY date))) GROUP BY 1"
RET_SQL = f"SELECT date, sum(y / nullif(t, 0) * label) AS ret FROM (SELECT *, sum(abs(y)) OVER (PARTITION BY date) AS t FROM (SELECT *, value - avg(value) OVER (PARTITION BY date) AS y FROM {LAB_SQL} WHERE value IS NOT NULL)) GROUP BY 1"
MONTH_SQL = f"SELECT date, nav, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret FROM (SELECT date, round(sum(money), 2) AS nav FROM ({bars_sql()}) GROUP BY 1)"


def months(s: SparkSession, d: str) -> DataFrame:
    """(date, nav, ret) of the money traded in each month, as a value that rises and falls."""
    total = panels.bars(s, d).groupBy("date").agg(F.round(F.sum("money"), 2).alias("nav"))
    return total.withColumn("ret", F.col("nav") / F.lag("nav").over(Window.orderBy("date")) - 1)


simple("information_analysis", f"SELECT round(avg(ic), 5) AS mean, round(stddev_samp(ic), 5) AS std, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 4) AS t, round(avg(pow(ic - m, 3)) / pow(var_pop(ic), 1.5), 4) AS skew, round(avg(pow(ic - m, 4)) / pow(var_pop(ic), 2) - 3, 4) AS kurt FROM (SELECT ic, avg(ic) OVER () AS m FROM ({IC_SQL}))", lambda s, d: evaluate.information_analysis(evaluate.information_coefficient(labelled(s, d))).select(*[F.round(k, n).alias(k) for k, n in (("mean", 5), ("std", 5), ("t", 4), ("skew", 4), ("kurt", 4))]))
simple("factor_returns", f"SELECT date, round(ret, 5) + 0.0 AS ret FROM ({RET_SQL})", lambda s, d: evaluate.factor_returns(labelled(s, d)).select("date", F.round("ret", 5).alias("ret")))
simple("quantile_spread", f"SELECT date, round(spread + 3e-8, 5) + 0.0 AS spread FROM ({SPREAD_SQL})", lambda s, d: evaluate.quantile_spread(evaluate.quantile_returns(labelled(s, d), 5), 5).select("date", x.rounded("spread", 5).alias("spread")))
simple("factor_correlations", f"SELECT 'close' AS a, 'cap' AS b, round(corr(close, cap), 5) AS pearson FROM {LAB_SQL} UNION ALL SELECT 'close', 'value', round(corr(close, value), 5) FROM {LAB_SQL} UNION ALL SELECT 'cap', 'value', round(corr(cap, value), 5) FROM {LAB_SQL}", lambda s, d: evaluate.factor_correlations(labelled(s, d), ["close", "cap", "value"]).withColumn("pearson", F.round("pearson", 5)))
simple(
    "drawdown_episodes",
    f'SELECT min(date) AS start, arg_min(date, (dd, date)) AS valley, max(date) AS "end", count(*) AS "rows", round(min(dd), 4) AS depth FROM (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT date, nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ({MONTH_SQL}))) WHERE dd < 0 GROUP BY e',
    lambda s, d: evaluate.drawdown_episodes(months(s, d)).withColumn("depth", F.round("depth", 4)),
)
simple("trade_stats", f"SELECT round(w, 5) AS win_rate, round(a, 5) AS avg_win, round(b, 5) AS avg_loss, round(w - (1 - w) / (a / abs(b)), 4) AS kelly, round(v, 5) AS value_at_risk FROM (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN ret > 0 THEN ret END) AS a, avg(CASE WHEN ret < 0 THEN ret END) AS b, avg(ret) - stddev_samp(ret) * 1.6448536269514722 AS v FROM ({MONTH_SQL}) WHERE ret IS NOT NULL)", lambda s, d: evaluate.trade_stats(months(s, d)).select(F.round("win_rate", 5).alias("win_rate"), F.round("avg_win", 5).alias("avg_win"), F.round("avg_loss", 5).alias("avg_loss"), F.round("kelly", 4).alias("kelly"), F.round("value_at_risk", 5).alias("value_at_risk")))
simple(
    "newey_west",
    f"WITH e AS (SELECT date, ret, ret - avg(ret) OVER () AS e FROM ({MONTH_SQL}) WHERE ret IS NOT NULL), p AS (SELECT *, lag(e, 1) OVER (ORDER BY date) AS l1, lag(e, 2) OVER (ORDER BY date) AS l2 FROM e) SELECT round(avg(ret), 5) AS mean, round(avg(ret) / (sqrt(sum(e * e) + 2 * (2.0 / 3) * sum(e * l1) + 2 * (1.0 / 3) * sum(e * l2)) / count(*)), 3) AS t FROM p",
    lambda s, d: evaluate.newey_west(months(s, d), "ret", 2).select(F.round("mean", 5).alias("mean"), F.round("t", 3).alias("t")),
)
simple(
    "triple_barrier",
    f"SELECT date, code, CASE WHEN n < 3 THEN NULL WHEN hit >= 0.5 THEN 2 WHEN hit <= -0.4 THEN 0 ELSE 1 END AS label FROM (SELECT *, list_filter(list_transform(p, lambda q: q / close - 1), lambda q: q >= 0.5 OR q <= -0.4)[1] AS hit, coalesce(len(p), 0) AS n FROM (SELECT date, code, close, list(close) FILTER (close IS NOT NULL) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS p FROM ({BARE}))) WHERE close IS NOT NULL",
    lambda s, d: evaluate.triple_barrier(dense(s, d), 0.5, 0.4, 3),
)
CELL_SQL = f"SELECT date, 1 + CAST(cap > m AS INT) AS a, 1 + CAST(k > (total - 1) // 3 AS INT) + CAST(k > (total - 1) * 2 // 3 AS INT) AS b, sum(label * cap) / sum(cap) AS ret, count(*) AS n FROM (SELECT *, quantile_cont(cap, 0.5) OVER w AS m, rank() OVER (PARTITION BY date ORDER BY value) - 1 AS k, count(*) OVER w AS total FROM {LAB_SQL} WHERE value IS NOT NULL AND cap IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY date)) GROUP BY 1, 2, 3"


def cells(s: SparkSession, d: str) -> DataFrame:
    return evaluate.sorted_portfolios(labelled(s, d), "cap", "value", (2, 3), weight="cap")


simple("sorted_portfolios", f"SELECT date, a, b, round(ret + 3e-8, 4) + 0.0 AS ret, n FROM ({CELL_SQL})", lambda s, d: cells(s, d).select("date", "a", "b", x.rounded("ret", 4).alias("ret"), "n"))
simple("size_value_spreads", f"SELECT date, round(avg(CASE WHEN a = 1 THEN ret END) - avg(CASE WHEN a = 2 THEN ret END) + 3e-8, 4) + 0.0 AS smb, round(avg(CASE WHEN b = 3 THEN ret END) - avg(CASE WHEN b = 1 THEN ret END) + 3e-8, 4) + 0.0 AS hml FROM ({CELL_SQL}) GROUP BY date", lambda s, d: evaluate.size_value_spreads(cells(s, d), (2, 3)).select("date", x.rounded("smb", 4).alias("smb"), x.rounded("hml", 4).alias("hml")))
