"""Handwritten queries: intraday features, order flow, accounts, forecasts, models, bounded weights, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import duck
from .functions import expr as x
from .operators import bounded, evaluate, forecasts, intraday, joins, models, select, transform
from .operators.backtest import backtest
from .plans import candles, flows
from .queries import DENSE_SQL, bars_sql, dense, expressions, register
from .query_panels import BARE, LAB_SQL, labelled, simple
from .sources import panels

for _part, _groups in (("candles", candles.patterns()), ("indicators", candles.averages()), ("channels", candles.channels())):
    for _family, _factors in _groups.items():
        expressions(f"{_part}_{_family}", _factors, 4)


def family(name: str, panel_sql: str, panel, factors: dict[str, x.Expr], digits: int = 4) -> None:
    """A query of expressions over a panel of its own."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = x.with_factors(panel(spark, sf_dir), factors)
        return df.select("date", "code", *[x.rounded(k, digits).alias(k) for k in factors])

    register(name, duck.sql(panel_sql, factors, digits=digits))(query)


# Money flow: the line status stands for the side of a trade, the quantity for its size.
_SUMS = ", ".join(f"round(sum(CASE WHEN kind = '{k}' AND side = {s} THEN money ELSE 0.0 END), 2) AS {n}_{k}" for s, n in ((1, "buy"), (-1, "sell")) for k in ("sm", "md", "lg"))
FLOW_SQL = f"SELECT date, code, {_SUMS} FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS code, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, CASE WHEN l_quantity < 17 THEN 'sm' WHEN l_quantity > 34 THEN 'lg' ELSE 'md' END AS kind, l_extendedprice AS money FROM lineitem) GROUP BY 1, 2"
FLOW_PANEL_SQL = f"SELECT d.*, f.* EXCLUDE (date, code) FROM ({DENSE_SQL}) d LEFT JOIN ({FLOW_SQL}) f ON d.date = f.date AND d.code = f.code"


def order_flow(s: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    trades = panels.table(s, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("code"), side.alias("side"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("money"))
    return intraday.order_flow(trades, 17, 34)


simple("order_flow", FLOW_SQL, order_flow)
for _family, _factors in flows.money_flow().items():
    family(f"money_flow_{_family}", FLOW_PANEL_SQL, lambda s, d: dense(s, d).join(order_flow(s, d), ["date", "code"], "left"), _factors)

# Accounts: a customer's quarters, from orders.
ACCOUNT_SQL = """SELECT date, code, revenue, cost, cash, round(revenue - cash, 2) AS receivable, round(c_acctbal + 5000 + revenue, 2) AS assets, round(c_acctbal + 5000 + cash / 2, 4) AS equity
 FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, o_custkey AS code, round(sum(o_totalprice), 2) AS revenue, round(sum(o_totalprice * (5 + o_orderkey % 6) / 10), 4) AS cost, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END), 2) AS cash FROM orders GROUP BY 1, 2)
 JOIN customer ON code = c_custkey"""


def accounts(s: SparkSession, d: str) -> DataFrame:
    total = F.col("o_totalprice")
    q = panels.table(s, d, "orders").groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date"), F.col("o_custkey").alias("code"))
    q = q.agg(F.round(F.sum(total), 2).alias("revenue"), F.round(F.sum(total * (5 + F.col("o_orderkey") % 6) / 10), 4).alias("cost"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", total).otherwise(0.0)), 2).alias("cash"))
    q = q.join(panels.table(s, d, "customer").select(F.col("c_custkey").alias("code"), (F.col("c_acctbal") + 5000).alias("own")), "code")
    return q.select("date", "code", "revenue", "cost", "cash", F.round(F.col("revenue") - F.col("cash"), 2).alias("receivable"), F.round(F.col("own") + F.col("revenue"), 2).alias("assets"), F.round(F.col("own") + F.col("cash") / 2, 4).alias("equity"))


for _family, _factors in flows.accounts().items():
    family(f"accounts_{_family}", ACCOUNT_SQL, accounts, _factors)

# Forecasts: an order is a report, its priority the institution.
CONSENSUS_SQL = """SELECT CAST(m AS DATE) AS date, code, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM (SELECT code, inst, m, arg_max(v, (pub, v)) AS v FROM
 (SELECT o_custkey AS code, o_orderpriority AS inst, o_orderdate AS pub, o_totalprice AS v, unnest(generate_series(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, date_trunc('month', o_orderdate) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS m FROM orders) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def consensus(s: SparkSession, d: str) -> DataFrame:
    reports = panels.table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("institution"), F.col("o_orderdate").alias("pub_date"), F.col("o_totalprice").alias("value"))
    return forecasts.consensus(reports, 12)


simple("consensus", f"SELECT date, code, round(mean + 3e-8, 3) AS mean, round(std + 3e-8, 2) AS std, n FROM ({CONSENSUS_SQL})", lambda s, d: consensus(s, d).select("date", "code", x.rounded("mean", 3).alias("mean"), x.rounded("std", 2).alias("std"), "n"))
simple(
    "consensus_revisions",
    f"SELECT a.date, a.code, round(a.mean / b.mean - 1 + 3e-8, 5) + 0.0 AS change, round(a.std / a.mean + 3e-8, 5) AS dispersion FROM ({CONSENSUS_SQL}) a LEFT JOIN ({CONSENSUS_SQL}) b ON a.code = b.code AND b.date = a.date - INTERVAL 3 MONTH",
    lambda s, d: forecasts.revisions(consensus(s, d), 3).select("date", "code", x.rounded("change", 5).alias("change"), x.rounded("dispersion", 5).alias("dispersion")),
)
# Unchanged reports shall compare as equal, whatever the order of their sum.
_EVEN_SQL = f"SELECT date, code, round(mean, 6) AS mean, round(std, 6) AS std, n FROM ({CONSENSUS_SQL})"
for _family, _factors in flows.forecasts().items():
    family(f"forecasts_{_family}", _EVEN_SQL, lambda s, d: consensus(s, d).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)}), _factors)

# Intraday: events are ticks.
SLOT_SQL = "SELECT CAST(ts AS DATE) AS date, event_type AS code, date_trunc('hour', ts) AS slot, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(sum(k) AS DOUBLE) AS volume, sum(value * k) AS money FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) + 1 AS k FROM events) GROUP BY 1, 2, 3"


def slots(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") + 1
    return intraday.slots(panels.table(s, d, "events").select("ts", F.col("event_type").alias("code"), F.col("value").alias("price"), k.alias("volume"), F.col("event_id").alias("key")))


REALIZED = ("variance", "skew", "kurt", "up_share", "morning_share", "entropy", "peak_share", "vwap_ratio", "efficiency", "jump_share")
simple(
    "intraday_realized",
    f"""SELECT date, code, {", ".join(f"round({k} + 3e-8, 4) + 0.0 AS {k}" for k in REALIZED)} FROM (SELECT *, greatest(0.0, 1 - bipower / nullif(variance, 0)) AS jump_share FROM (SELECT date, code, sum(r * r) AS variance, sqrt(count(r)) * sum(r * r * r) / nullif(pow(sum(r * r), 1.5), 0) AS skew,
 count(r) * sum(r * r * r * r) / nullif(pow(sum(r * r), 2), 0) AS kurt, sum(CASE WHEN r > 0 THEN r * r ELSE 0.0 END) / nullif(sum(r * r), 0) AS up_share, sum(abs(r * r1)) * pi() / 2 AS bipower, sum(CASE WHEN hour(slot) < 12 THEN sh ELSE 0.0 END) AS morning_share,
 sum(CASE WHEN sh > 0 THEN -sh * ln(sh) ELSE 0.0 END) AS entropy, max(sh) AS peak_share, sum(money) / sum(volume) / arg_max(close, slot) AS vwap_ratio, sum(r) / nullif(sum(abs(r)), 0) AS efficiency
 FROM (SELECT *, lag(r) OVER w AS r1 FROM (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS r, volume / nullif(sum(volume) OVER (PARTITION BY date, code), 0) AS sh FROM ({SLOT_SQL}) WINDOW w AS (PARTITION BY date, code ORDER BY slot)) WINDOW w AS (PARTITION BY date, code ORDER BY slot)) GROUP BY 1, 2))""",
    lambda s, d: intraday.realized(slots(s, d)).select("date", "code", *[x.rounded(k, 4).alias(k) for k in REALIZED]),
)
simple(
    "smart_money",
    f"""SELECT date, code, round(sum(CASE WHEN smart THEN money END) / nullif(sum(CASE WHEN smart THEN volume END), 0) / (sum(money) / sum(volume)) + 3e-8, 5) AS q FROM (SELECT *, sum(volume) OVER (PARTITION BY date, code ORDER BY s DESC, slot ROWS UNBOUNDED PRECEDING) <= sum(volume) OVER (PARTITION BY date, code) * 0.2 AS smart
 FROM (SELECT *, round(abs(close / open - 1) / pow(volume, 0.5), 12) AS s FROM ({SLOT_SQL}) WHERE volume > 0)) GROUP BY 1, 2""",
    lambda s, d: intraday.smart_money(slots(s, d)).select("date", "code", x.rounded("q", 5).alias("q")),
)
simple(
    "mean_shift",
    f"""SELECT date, code, CASE WHEN sd > 0 THEN 12 - list_position(dev, list_max(dev)) END AS age, round(list_max(dev) / nullif(sd * sqrt(12.0), 0) + 3e-8, 4) AS strength FROM (SELECT *, CASE WHEN len(p) = 12 THEN list_transform(range(1, 12), lambda k: round(abs(list_sum(p[:k]) - k * t / 12), 4)) END AS dev
 FROM (SELECT date, code, list(close) OVER w AS p, stddev_pop(close) OVER w AS sd, sum(close) OVER w AS t FROM ({bars_sql()}) WHERE close IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)))""",
    lambda s, d: transform.mean_shift(panels.bars(s, d), 12, "close").select("date", "code", F.col("age").cast("long").alias("age"), x.rounded("strength", 4).alias("strength")),
)

# Models.
THREE = ["value", "cap", "close"]


def _avg_rank(f: str, more: str = "") -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY date, {f} IS NULL ORDER BY {f}) + (count(*) OVER (PARTITION BY date, {f}) - 1) / 2.0 END"


simple("rank_model", f"SELECT date, code, round(({' + '.join(f'({_avg_rank(f)}) / nullif(count({f}) OVER (PARTITION BY date), 0)' for f in THREE)}) / 3 + 3e-8, 5) AS score FROM {LAB_SQL}", lambda s, d: models.rank_score(labelled(s, d), THREE).select("date", "code", x.rounded("score", 5).alias("score")))
_ICS = " UNION ALL ".join(
    f"SELECT date, '{f}' AS factor, corr(a, b) AS ic FROM (SELECT date, {_avg_rank(f)} AS a, {_avg_rank('label')} AS b FROM (SELECT * FROM {LAB_SQL} WHERE {f} IS NOT NULL AND label IS NOT NULL)) GROUP BY date" for f in THREE
)
WEIGHT_SQL = f"SELECT date, factor, m / nullif(sum(abs(m)) OVER (PARTITION BY date), 0) AS weight FROM (SELECT date, factor, avg(ic) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({_ICS})) WHERE m IS NOT NULL"
simple("forward_ic_weights", f"SELECT date, factor, round(weight + 3e-8, 5) + 0.0 AS weight FROM ({WEIGHT_SQL})", lambda s, d: models.forward_ic_weights(labelled(s, d), THREE, "label").select("date", "factor", x.rounded("weight", 5).alias("weight")))
_Z = ", ".join(f"({f} - avg({f}) OVER (PARTITION BY date)) / nullif(stddev_pop({f}) OVER (PARTITION BY date), 0) AS z_{f}" for f in THREE)
simple(
    "ic_weight_model",
    f"SELECT l.date, code, round({' + '.join(f'w_{f} * z_{f}' for f in THREE)} + 3e-8, 4) + 0.0 AS score FROM (SELECT date, code, {_Z} FROM {LAB_SQL}) l JOIN (SELECT date, {', '.join(f'''max(CASE WHEN factor = '{f}' THEN weight END) AS w_{f}''' for f in THREE)} FROM ({WEIGHT_SQL}) GROUP BY date) w ON l.date = w.date",
    lambda s, d: models.ic_weighted_score(labelled(s, d), THREE, "label").select("date", "code", x.rounded("score", 4).alias("score")),
)
FIT_SQL = f"""SELECT date, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n > 2 THEN (sy - b * sx) / n END AS a, CASE WHEN n > 2 THEN b END AS b FROM (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS b FROM
 (SELECT date, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM (SELECT date, count(CASE WHEN ok THEN 1 END) AS n, sum(CASE WHEN ok THEN value END) AS sx, sum(CASE WHEN ok THEN label END) AS sy, sum(CASE WHEN ok THEN value * value END) AS sxx, sum(CASE WHEN ok THEN value * label END) AS sxy
 FROM (SELECT *, value IS NOT NULL AND label IS NOT NULL AS ok FROM {LAB_SQL}) GROUP BY 1) WINDOW w AS (ORDER BY date ROWS BETWEEN {{before}} AND 1 PRECEDING)))"""
simple("walk_forward_fit", f"SELECT date, n, round(a, 4) AS intercept, round(b, 4) AS slope FROM ({FIT_SQL.format(before='UNBOUNDED PRECEDING')})", lambda s, d: models.walk_forward_fit(labelled(s, d), ["value"], "label").select("date", "n", F.round(F.get("beta", F.lit(0)), 4).alias("intercept"), F.round(F.get("beta", F.lit(1)), 4).alias("slope")))
simple(
    "walk_forward_prediction",
    f"SELECT l.date, code, round(a + b * value + 3e-8, 3) + 0.0 AS prediction FROM {LAB_SQL} l JOIN ({FIT_SQL.format(before='24 PRECEDING')}) f ON l.date = f.date",
    lambda s, d: models.walk_forward_predict(labelled(s, d), ["value"], "label", dates=24).select("date", "code", x.rounded("prediction", 3).alias("prediction")),
)
simple("regression_report", f"SELECT regr_count(label, value) AS n, round(regr_slope(label, value), 5) AS slope, round(regr_intercept(label, value), 5) AS intercept, round(regr_r2(label, value), 6) AS r2, round(sign(regr_slope(label, value)) * sqrt(regr_r2(label, value) * (regr_count(label, value) - 2) / (1 - regr_r2(label, value))), 2) AS t FROM {LAB_SQL}", lambda s, d: models.regression_report(labelled(s, d), "value", "label").select(F.col("n").cast("long").alias("n"), F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("t", 2).alias("t")))

# Weights.


def _enhanced_sql(by: str) -> str:
    return f"""SELECT date, code, round(lo + greatest(0.0, least(total - coalesce(used, 0.0), room)) + 3e-8, 5) AS weight FROM (SELECT *, sum(b - lo) OVER (PARTITION BY {by}) AS total, sum(room) OVER (PARTITION BY {by} ORDER BY value DESC NULLS LAST, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used
 FROM (SELECT *, greatest(0.0, b - 0.01) AS lo, b + 0.01 - greatest(0.0, b - 0.01) AS room FROM (SELECT date, code, sector, value, cap / sum(cap) OVER (PARTITION BY date) AS b FROM (SELECT l.*, n_regionkey AS sector FROM {LAB_SQL} l JOIN supplier ON code = s_suppkey JOIN nation ON s_nationkey = n_nationkey))))"""


def _with_benchmark(s: SparkSession, d: str) -> DataFrame:
    df = labelled(s, d).join(panels.industries(s, d).select("code", "sector"), "code")
    return select.proportional_weight(df, "cap").withColumnRenamed("weight", "b")


simple("enhanced_weights", _enhanced_sql("date"), lambda s, d: bounded.enhanced_weights(_with_benchmark(s, d), "value", "b", 0.01).select("date", "code", x.rounded("weight", 5).alias("weight")))
simple("enhanced_sector_weights", _enhanced_sql("date, sector"), lambda s, d: bounded.enhanced_weights(_with_benchmark(s, d), "value", "b", 0.01, ("sector",)).select("date", "code", x.rounded("weight", 5).alias("weight")))
simple(
    "sector_budget_top",
    f"SELECT date, code, value FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY value DESC, code) AS n, count(*) OVER (PARTITION BY date, sector) AS k FROM (SELECT l.*, n_regionkey AS sector FROM {LAB_SQL} l JOIN supplier ON code = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE value IS NOT NULL)) WHERE n <= floor(k * 0.25)",
    lambda s, d: (lambda df: bounded.sector_budget_top(df, df.groupBy("date", "sector").agg(F.count("value").alias("score")), 0.25).select("date", "code", "value"))(_with_benchmark(s, d)),
)
simple(
    "index_weights",
    f"SELECT date, code, round(w / nullif(sum(w) OVER (PARTITION BY date), 0) + 3e-8, 5) AS weight FROM (SELECT a.date, a.code, CASE WHEN a.date - b.date <= 40 THEN b.w END AS w FROM ({BARE}) a ASOF LEFT JOIN (SELECT date, code, cap * close AS w FROM ({BARE}) WHERE close IS NOT NULL AND month(date) % 3 = 1) b ON a.code = b.code AND a.date >= b.date)",
    lambda s, d: (lambda df: bounded.index_weights(df.select("date", "code"), df.filter("close is not null and month(date) % 3 = 1").select("date", "code", (F.col("cap") * F.col("close")).alias("weight")), 40).select("date", "code", x.rounded("weight", 5).alias("weight")))(dense(s, d)),
)


@register("backtest")
def backtest_both_ends(s: SparkSession, d: str) -> DataFrame:
    """Two strategies, the ten highest and the ten lowest values, held by the month."""
    df = labelled(s, d)
    ends = ((select.top_n, "highest"), (select.bottom_n, "lowest"))
    targets = [select.equal_weight(pick(df, 10)).select(F.lit(name).alias("strategy"), "date", "code", "weight") for pick, name in ends]
    return backtest(targets[0].unionByName(targets[1]), dense(s, d).withColumn("tradable", F.col("trades") >= 3), stop=0.5)


simple(
    "forward_path",
    f"""SELECT date, code, round(ret + 3e-8, 5) + 0.0 AS ret, round(dd + 3e-8, 5) + 0.0 AS drawdown, round(ret / nullif(abs(dd), 0) + 3e-8, 3) + 0.0 AS calmar FROM (SELECT date, code, CASE WHEN len(p) = 7 THEN p[7] / nullif(p[1], 0) - 1 END AS ret, CASE WHEN len(p) = 7 THEN list_min(list_transform(range(1, 8), lambda k: p[k] / list_max(p[:k]) - 1)) END AS dd
 FROM (SELECT date, code, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS p FROM ({bars_sql()}) WHERE close IS NOT NULL))""",
    lambda s, d: evaluate.forward_path(panels.bars(s, d), 6).select("date", "code", x.rounded("ret", 5).alias("ret"), x.rounded("drawdown", 5).alias("drawdown"), x.rounded("calmar", 3).alias("calmar")),
)
simple(
    "trade_rounds",
    """SELECT code, CAST(r AS BIGINT) AS round, count(*) AS trades, round(sum(CASE WHEN paid > 0 THEN paid ELSE 0.0 END), 2) AS bought, CAST(sum(n) AS BIGINT) AS "position", CASE WHEN sum(n) = 0 THEN round(-sum(paid), 2) + 0.0 END AS profit FROM (SELECT *, sum(CASE WHEN after - n = 0 THEN 1 ELSE 0 END) OVER w AS r FROM
 (SELECT *, n * price AS paid, sum(n) OVER w AS after FROM (SELECT o_custkey AS code, o_orderdate AS ts, o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS n, o_totalprice AS price FROM orders) WINDOW w AS (PARTITION BY code ORDER BY ts, key)) WINDOW w AS (PARTITION BY code ORDER BY ts, key)) GROUP BY 1, 2""",
    lambda s, d: evaluate.trade_rounds(panels.table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("shares"), F.col("o_totalprice").alias("price"))).select("code", "round", "trades", F.round("bought", 2).alias("bought"), "position", F.round("profit", 2).alias("profit")),
)
simple(
    "calendar_features",
    "SELECT event_id, CAST(hour(ts) // 8 AS INT) AS session, CAST(isodow(ts) - 1 AS INT) AS weekday, round(month_share, 6) AS month_share FROM events JOIN (SELECT d, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) / count(*) OVER (PARTITION BY date_trunc('month', d)) AS month_share FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)) ON CAST(ts AS DATE) = d",
    lambda s, d: transform.with_calendar(panels.table(s, d, "events")).select("event_id", "session", "weekday", F.round("month_share", 6).alias("month_share")),
)
simple(
    "rebased_prices",
    f"SELECT date, code, round(close * f / last_value(f) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 3e-8, 4) AS close FROM (SELECT a.date, a.code, a.close, coalesce(b.f, 1.0) AS f FROM ({BARE}) a ASOF LEFT JOIN (SELECT code, date, 1 + (year(date) - 1990) * 0.1 + code % 5 AS f FROM ({BARE}) WHERE month(date) = 6) b ON a.code = b.code AND a.date >= b.date)",
    lambda s, d: (lambda df: joins.rebased(df.select("date", "code", "close"), df.filter("month(date) = 6").select("code", "date", (1 + (F.year("date") - 1990) * 0.1 + F.col("code") % 5).alias("factor")), ["close"]).select("date", "code", x.rounded("close", 4).alias("close")))(dense(s, d)),
)
