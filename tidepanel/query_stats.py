"""Handwritten queries: moments, slices, turnover, labels, bounds, unions of factors, dates and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates
from .operators import bounded, evaluate, joins, labels, report, select, transform
from .queries import DENSE_SQL, bars_sql, dense
from .query_market import LIMITS_SQL, limited
from .query_panels import BARE, FWD_SQL, IC_SQL, LAB_SQL, MONTH_SQL, labelled, months, simple
from .sources import panels

N = 3e-8  # as in functions.expr: exact halves round alike in both engines


def r(name: str, digits: int):
    return (F.round(F.col(name) + N, digits) + 0.0).alias(name)


def rs(sql: str, digits: int, name: str) -> str:
    return f"round({sql} + {N}, {digits}) + 0.0 AS {name}"


def _moments(v: str) -> str:
    return ", ".join([rs(f"avg({v})", 2, "mean"), rs(f"quantile_cont({v}, 0.5)", 2, "median"), rs(f"stddev_samp({v})", 2, "std"), rs(f"CASE WHEN count({v}) > 2 THEN skewness({v}) END", 5, "skew"), rs(f"CASE WHEN count({v}) > 3 THEN kurtosis({v}) END", 5, "kurt")])


ROUNDED = [("mean", 2), ("median", 2), ("std", 2), ("skew", 5), ("kurt", 5)]
simple("date_moments", f"SELECT b.date, b.code, CASE WHEN close IS NOT NULL THEN m.mean END AS mean, CASE WHEN close IS NOT NULL THEN m.median END AS median, CASE WHEN close IS NOT NULL THEN m.std END AS std, CASE WHEN close IS NOT NULL THEN m.skew END AS skew, CASE WHEN close IS NOT NULL THEN m.kurt END AS kurt FROM ({BARE}) b JOIN (SELECT date, {_moments('close')} FROM ({BARE}) GROUP BY 1) m USING (date)", lambda s, d: report.with_date_moments(dense(s, d).select("date", "code", F.col("close").alias("value"))).select("date", "code", *[r(*k) for k in ROUNDED]))
simple("industry_moments", f"SELECT date, sector, {_moments('close')}, {rs('sum(close * cap) / nullif(sum(CASE WHEN close IS NOT NULL THEN cap END), 0)', 2, 'weighted')} FROM ({BARE}) GROUP BY 1, 2", lambda s, d: report.group_moments(dense(s, d), ["date", "sector"], "close", "cap").select("date", "sector", *[r(*k) for k in [*ROUNDED, ("weighted", 2)]]))
simple(
    "industry_shares",
    f"SELECT date, sector, {rs('total', 1, 'total')}, {rs('total / sum(total) OVER (PARTITION BY date)', 5, 'share')}, {rs('total / lag(total) OVER (PARTITION BY sector ORDER BY date) - 1', 4, 'growth')} FROM (SELECT date, sector, sum(money) AS total FROM ({DENSE_SQL}) GROUP BY 1, 2)",
    lambda s, d: report.group_shares(dense(s, d), "sector", "money").select("date", "sector", r("total", 1), r("share", 5), r("growth", 4)),
)
_EVENTS = "SELECT CAST(date_trunc('day', ts) AS DATE) AS date, event_type AS code, value, user_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY date_trunc('day', ts), event_type) AS n, quantile_cont(value, 0.5) OVER (PARTITION BY date_trunc('day', ts), event_type) AS m FROM events WINDOW w AS (PARTITION BY date_trunc('day', ts), event_type ORDER BY ts, event_id)"
_SLICES = {"all": "true", "open": "r <= 10", "intra": "r > 10 AND r <= n - 10", "close": "r > n - 10", "high": "value >= m", "low": "value < m"}
_SLICE_SQL = ", ".join(rs(f"CASE WHEN count(*) FILTER ({c}) > {least} THEN {f} FILTER ({c}) END", 4, f"{name}_{k}") for k, c in _SLICES.items() for name, f, least in (("avg", "avg(value)", 0), ("std", "stddev_samp(value)", 1), ("skew", "skewness(value)", 2), ("kurt", "kurtosis(value)", 3)))


def days_of_events(s: SparkSession, d: str) -> DataFrame:
    return panels.table(s, d, "events").withColumnsRenamed({"event_type": "code"}).withColumn("date", F.to_date("ts"))


simple("intraday_slices", f"SELECT date, code, {_SLICE_SQL} FROM ({_EVENTS}) GROUP BY 1, 2", lambda s, d: (lambda m: m.select("date", "code", *[r(c, 4) for c in m.columns[2:]]))(report.slice_moments(days_of_events(s, d), ["date", "code"], ["ts", "event_id"], "value", 10)))
simple(
    "row_correlations",
    f"SELECT date, code, {rs('CASE WHEN stddev_pop(value) > 0 AND stddev_pop(user_id) > 0 THEN corr(value, user_id) END', 5, 'pearson')}, {rs('CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END', 5, 'spearman')}, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY date, code ORDER BY value) + (count(*) OVER (PARTITION BY date, code, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, code ORDER BY user_id) + (count(*) OVER (PARTITION BY date, code, user_id) - 1) / 2.0 AS b FROM ({_EVENTS}) WHERE value IS NOT NULL AND user_id IS NOT NULL) GROUP BY 1, 2",
    lambda s, d: report.group_correlations(days_of_events(s, d), ["date", "code"], "value", "user_id").select("date", "code", r("pearson", 5), r("spearman", 5), "n"),
)
simple(
    "factor_summary",
    f"SELECT date, min(value) AS min, max(value) AS max, {rs('avg(value)', 5, 'mean')}, {rs('stddev_samp(value)', 5, 'std')}, count(value) AS count, {rs('CASE WHEN count(value) > 2 THEN skewness(value) END', 4, 'skew')}, {rs('count(value) / count(*)', 5, 'cover_rate')}, {rs('count(*) FILTER (value > 0) / nullif(count(value), 0)', 5, 'positive_rate')} FROM {LAB_SQL} GROUP BY 1",
    lambda s, d: report.factor_summary(labelled(s, d)).select("date", "min", "max", r("mean", 5), r("std", 5), "count", r("skew", 4), r("cover_rate", 5), r("positive_rate", 5)),
)
Q5 = "CASE WHEN {0} IS NOT NULL THEN 1 + CAST({0} > quantile_cont({0}, 0.2) OVER (PARTITION BY date) AS INT) + CAST({0} > quantile_cont({0}, 0.4) OVER (PARTITION BY date) AS INT) + CAST({0} > quantile_cont({0}, 0.6) OVER (PARTITION BY date) AS INT) + CAST({0} > quantile_cont({0}, 0.8) OVER (PARTITION BY date) AS INT) END"
_HOLD = "CASE WHEN g = 0 THEN CAST({0} = 5 AS INT) - CAST({0} = 1 AS INT) ELSE CAST({0} = g AS INT) END"
simple(
    "group_turnover",
    f'SELECT date, g AS "group", {rs(f"sum(coalesce(abs({_HOLD.format("q")} - {_HOLD.format("p")}), 0)) / nullif(sum(abs({_HOLD.format("q")})), 0)", 5, "turnover")} FROM (SELECT *, lag(q) OVER (PARTITION BY code ORDER BY date) AS p FROM (SELECT date, code, {Q5.format("close")} AS q FROM ({BARE}))), (SELECT CAST(unnest(range(6)) AS INT) AS g) WHERE q IS NOT NULL GROUP BY 1, 2',
    lambda s, d: report.group_turnover(dense(s, d).withColumn("value", F.col("close")), 5).select("date", "group", r("turnover", 5)),
)
for _unit in ("quarter", "year"):
    simple(f"returns_by_{_unit}", f"SELECT CAST(date_trunc('{_unit}', date) AS DATE) AS period, {rs('exp(sum(ln(1 + ret))) - 1', 4, 'ret')}, {rs('sum(ret)', 4, 'added')} FROM ({MONTH_SQL}) WHERE ret IS NOT NULL GROUP BY 1", lambda s, d, u=_unit: (lambda m: report.period_returns(m, u).join(report.period_returns(m, u, False).withColumnRenamed("ret", "added"), "period").select("period", r("ret", 4), r("added", 4)))(months(s, d).filter("ret is not null")))
simple(
    "growth_metrics",
    f"SELECT {rs('c', 4, 'cagr')}, {rs('m', 4, 'mean')}, {rs('v', 4, 'vol')}, {rs('k3', 4, 'skew')}, {rs('k4', 4, 'kurt')}, {rs('dd', 4, 'max_drawdown')}, {rs('c / abs(dd)', 3, 'calmar')} FROM (SELECT pow(abs(arg_max(nav, date) / arg_min(nav, date)), 365.0 / date_diff('day', min(date), max(date))) - 1 AS c, avg(ret) * 12 AS m, stddev_samp(ret) * sqrt(12) AS v, skewness(ret) AS k3, kurtosis(ret) AS k4, min(dd) AS dd FROM (SELECT *, nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ({MONTH_SQL})))",
    lambda s, d: report.growth_metrics(months(s, d)).select(r("cagr", 4), r("mean", 4), r("vol", 4), r("skew", 4), r("kurt", 4), r("max_drawdown", 4), r("calmar", 3)),
)
simple("without_outliers", f"SELECT date, {rs('ret', 6, 'ret')} FROM ({MONTH_SQL}) WHERE ret < (SELECT quantile_cont(ret, 0.95) FROM ({MONTH_SQL}))", lambda s, d: report.without_outliers(months(s, d), 0.95).select("date", r("ret", 6)))
simple(
    "quantile_errors",
    f"SELECT quantile, {rs('avg(m)', 5, 'mean_return')}, {rs('stddev_samp(m) / sqrt(count(m))', 5, 'std_error')}, count(m) AS n FROM (SELECT date, quantile, avg(l) AS m FROM (SELECT date, {Q5.format('value')} AS quantile, label - avg(label) OVER (PARTITION BY date) AS l FROM {LAB_SQL} WHERE value IS NOT NULL AND label IS NOT NULL) GROUP BY 1, 2) GROUP BY 1",
    lambda s, d: report.quantile_errors(labelled(s, d), 5).select("quantile", r("mean_return", 5), r("std_error", 5), "n"),
)
simple("cumulative_ic", f"SELECT date, {rs('sum(ic) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', 5, 'cumulative_ic')} FROM ({IC_SQL})", lambda s, d: report.cumulative(evaluate.information_coefficient(labelled(s, d)), "ic", "cumulative_ic").select("date", r("cumulative_ic", 5)))
_RANKED = f"SELECT close, cap, value, rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2.0 AS a, rank() OVER (ORDER BY cap) + (count(*) OVER (PARTITION BY cap) - 1) / 2.0 AS b, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS c FROM {LAB_SQL} WHERE close IS NOT NULL AND cap IS NOT NULL AND value IS NOT NULL"
simple("rank_correlations", f"WITH t AS ({_RANKED}) SELECT 'close' AS a, 'cap' AS b, {rs('corr(a, b)', 5, 'spearman')} FROM t UNION ALL SELECT 'close', 'value', {rs('corr(a, c)', 5, 'spearman')} FROM t UNION ALL SELECT 'cap', 'value', {rs('corr(b, c)', 5, 'spearman')} FROM t", lambda s, d: report.rank_correlations(labelled(s, d), ["close", "cap", "value"]).select("a", "b", r("spearman", 5)))


def _grid(s: SparkSession, d: str) -> DataFrame:
    df = labelled(s, d)
    return report.evaluation_grid(df, ["value", "cap"], ["label"], {"all": df, "large": df.filter("cap > 4000")})


_GRID_PART = "SELECT '{f}' AS factor, 'label' AS label, '{u}' AS universe, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, count(ic) AS n FROM (SELECT date, corr(a, b) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY {f}) + (count(*) OVER (PARTITION BY date, {f}) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS b FROM " + LAB_SQL + " WHERE {f} IS NOT NULL AND label IS NOT NULL AND {w}) GROUP BY date)"
simple("evaluation_grid", " UNION ALL ".join(_GRID_PART.format(f=f, u=u, w=w) for u, w in (("all", "true"), ("large", "cap > 4000")) for f in ("value", "cap")), lambda s, d: _grid(s, d).select("factor", "label", "universe", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n"))
simple(
    "winners_losers",
    "WITH t AS (SELECT l_suppkey AS code, round(sum(l_extendedprice * (l_discount - l_tax)), 2) AS profit FROM lineitem GROUP BY 1) SELECT 'winner' AS side, CAST(row_number() OVER (ORDER BY profit DESC, code) AS INT) AS place, code, profit FROM t QUALIFY place <= 5 UNION ALL SELECT 'loser', CAST(row_number() OVER (ORDER BY profit, code) AS INT) AS place, code, profit FROM t QUALIFY place <= 5",
    lambda s, d: report.winners_and_losers(panels.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))), 2).alias("profit")), 5),
)

# Transforms.
_WINS = f"SELECT date, code, sector, CASE WHEN close IS NOT NULL THEN greatest(least(close, max(k) OVER g), min(k) OVER g) END AS value FROM (SELECT *, CASE WHEN close IS NOT NULL AND r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN close END AS k FROM (SELECT *, row_number() OVER (PARTITION BY date, sector, close IS NULL ORDER BY close) AS r, count(close) OVER (PARTITION BY date, sector) AS n FROM ({BARE}))) WINDOW g AS (PARTITION BY date, sector)"
simple("winsorize_within", f"SELECT date, code, value FROM ({_WINS})", lambda s, d: transform.winsorize_within(dense(s, d).withColumn("value", F.col("close")), 0.1, "sector").select("date", "code", "value"))
simple("winsorize_standard", f"SELECT date, code, {rs('(value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0)', 5, 'value')} FROM ({_WINS}) WINDOW g AS (PARTITION BY date, sector)", lambda s, d: transform.winsorize_within(dense(s, d).withColumn("value", F.col("close")), 0.1, "sector", standard=True).select("date", "code", r("value", 5)))
simple("category_codes", "SELECT s_suppkey AS code, n_name, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INT) AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey", lambda s, d: transform.category_codes(panels.industries(s, d).select("code", F.col("industry").alias("n_name")), "n_name").select("code", "n_name", "category"))
simple("padded_quarters", f"SELECT CAST(date_trunc('quarter', date) AS DATE) AS period, code, close FROM ({BARE}) WHERE close IS NOT NULL AND date IN (SELECT max(date) FROM ({BARE}) GROUP BY date_trunc('quarter', date))", lambda s, d: transform.padded_to(dense(s, d).select("date", "code", "close"), "quarter", ["close"]))


def _zscore(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("date")
    return df.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def _rank_share(df: DataFrame) -> DataFrame:
    known = df.filter("value is not null")
    w = Window.partitionBy("date")
    return known.withColumn("value", F.rank().over(w.orderBy("value")) / F.count("*").over(w))


def _union(s: SparkSession, d: str) -> DataFrame:
    df = dense(s, d)
    of = lambda c: df.select("date", "code", F.col(c).alias("value"))
    return transform.factor_union({"close": of("close"), "cap": of("cap"), "volume": of("volume")}, {"close": [[_zscore], [_rank_share]], "cap": [_zscore]}, lambda u: u.filter("volume > 20"))


simple(
    "factor_union",
    f"SELECT date, code, {rs('a', 5, 'close_0')}, {rs('b', 5, 'close_1')}, {rs('c', 5, 'cap')}, volume FROM (SELECT date, code, (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) AS a, CASE WHEN close IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY close NULLS LAST) / count(close) OVER w END AS b, (cap - avg(cap) OVER w) / nullif(stddev_pop(cap) OVER w, 0) AS c, volume FROM ({DENSE_SQL}) WINDOW w AS (PARTITION BY date)) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND volume > 20",
    lambda s, d: _union(s, d).select("date", "code", r("close_0", 5), r("close_1", 5), r("cap", 5), "volume"),
)

# Bounds and portfolios.
simple("norm_score", f"SELECT date, code, {rs('value / nullif(sum(abs(value)) OVER (PARTITION BY date) * 0.5, 0)', 6, 'value')} FROM {LAB_SQL}", lambda s, d: bounded.norm_score(labelled(s, d), 0.5).select("date", "code", r("value", 6)))
_EDGES = "quantile_cont({0}, 0.0) OVER w AS e0, quantile_cont({0}, 0.3) OVER w AS e1, quantile_cont({0}, 0.7) OVER w AS e2, quantile_cont({0}, 1.0) OVER w AS e3"
for _grouped in (True, False):
    _outer = "" if _grouped else "WHEN close <= e1 OR close > e2 THEN close "
    simple(
        "score_bounds" if _grouped else "score_bounds_own",
        f"SELECT date, code, {rs(f'CASE {_outer}WHEN close <= e1 THEN e0 - 0.001 WHEN close <= e2 THEN e1 ELSE e2 END', 3, 'lower')}, {rs(f'CASE {_outer}WHEN close <= e1 THEN e1 WHEN close <= e2 THEN e2 ELSE e3 END', 3, 'upper')} FROM (SELECT *, {_EDGES.format('close')} FROM ({BARE}) WHERE close IS NOT NULL WINDOW w AS (PARTITION BY date))",
        lambda s, d, g=_grouped: bounded.score_bounds(dense(s, d).filter("close is not null").withColumn("value", F.col("close")), [0.0, 0.3, 0.7, 1.0], g).select("date", "code", r("lower", 3), r("upper", 3)),
    )
simple(
    "sector_score",
    f"SELECT b.date, b.code, {rs('close + 0.5 * m', 3, 'value')} FROM ({BARE}) b JOIN (SELECT date, sector, avg(close) AS m FROM ({BARE}) GROUP BY 1, 2) USING (date, sector)",
    lambda s, d: (lambda b: bounded.add_sector_score(b, b.groupBy("date", "sector").agg(F.avg("value").alias("score")), 0.5).select("date", "code", r("value", 3)))(dense(s, d).withColumn("value", F.col("close"))),
)
simple(
    "tilt_bounds",
    f"SELECT date, code, [-0.02, -0.01, 0.01][q] AS lower, [-0.01, 0.01, 0.02][q] AS upper FROM (SELECT date, code, CASE WHEN close IS NOT NULL THEN 1 + CAST(rank() OVER (PARTITION BY date, close IS NULL ORDER BY close) - 1 > (count(close) OVER (PARTITION BY date) - 1) * 1 // 3 AS INT) + CAST(rank() OVER (PARTITION BY date, close IS NULL ORDER BY close) - 1 > (count(close) OVER (PARTITION BY date) - 1) * 2 // 3 AS INT) END AS q FROM ({BARE}))",
    lambda s, d: bounded.tilt_bounds(dense(s, d).withColumn("value", F.col("close")), 0.02, 3).select("date", "code", "lower", "upper"),
)
simple("append_rows", f"SELECT date, code, close FROM ({BARE}) UNION ALL SELECT date, code + 1000, volume FROM ({bars_sql()})", lambda s, d: select.append_rows(dense(s, d).select("date", "code", "close"), panels.bars(s, d).select("date", (F.col("code") + 1000).alias("code"), F.col("volume").alias("close"))))
simple(
    "held_portfolios",
    f"WITH t AS (SELECT *, date_trunc('quarter', date) AS p FROM {LAB_SQL}), s AS (SELECT p, code, 1 + CAST(rank() OVER (PARTITION BY date, value IS NULL ORDER BY value) - 1 > (count(value) OVER (PARTITION BY date) - 1) * 1 // 3 AS INT) + CAST(rank() OVER (PARTITION BY date, value IS NULL ORDER BY value) - 1 > (count(value) OVER (PARTITION BY date) - 1) * 2 // 3 AS INT) AS bucket FROM t WHERE value IS NOT NULL AND (p, date) IN (SELECT (p, min(date)) FROM t GROUP BY p)) SELECT date, bucket, {rs('sum(label * cap) / sum(cap)', 4, 'ret')}, count(*) AS n FROM t JOIN s USING (p, code) WHERE label IS NOT NULL GROUP BY 1, 2",
    lambda s, d: evaluate.held_portfolios(labelled(s, d), "value", 3, "quarter", weight="cap").select("date", "bucket", r("ret", 4), "n"),
)

# Labels.
simple(
    "next_open_returns",
    f"SELECT date, code, {rs('lead(v, 1) OVER w', 4, 'label')}, lead(date, 4) OVER w AS label_end FROM (SELECT *, CASE WHEN open <> low_limit AND open <> high_limit THEN lead(open, 3) OVER (PARTITION BY code ORDER BY date) / open - 1 END AS v FROM ({LIMITS_SQL})) WINDOW w AS (PARTITION BY code ORDER BY date)",
    lambda s, d: labels.next_open_returns(limited(s, d), 3).select("date", "code", (F.col("label") + 0.0).alias("label"), "label_end"),
)
_DEM = f"SELECT date, code, {rs('forward_3 - avg(forward_3) OVER (PARTITION BY date)', 4, 'label')} FROM ({FWD_SQL})"


def _forward(s: SparkSession, d: str) -> DataFrame:
    return evaluate.forward_returns(dense(s, d), (1, 3)).select("date", "code", F.col("forward_3").alias("label"))


simple("demeaned_labels", _DEM, lambda s, d: labels.demeaned(_forward(s, d)).withColumn("label", F.col("label") + 0.0))
_CLIP = "CASE WHEN label IS NOT NULL THEN greatest(least(label, (SELECT quantile_cont(label, 0.9) FROM t)), (SELECT quantile_cont(label, 0.1) FROM t)) END"
simple("clipped_labels", f"WITH t AS ({_DEM}) SELECT date, code, {rs(_CLIP, 4, 'label')} FROM t", lambda s, d: labels.demeaned(_forward(s, d), clip=0.1).select("date", "code", r("label", 4)))
simple(
    "excess_labels",
    f"SELECT date, code, {rs('forward_3 - b', 4, 'label')} FROM ({FWD_SQL}) LEFT JOIN (SELECT date, lead(c, 3) OVER (ORDER BY date) / c - 1 AS b FROM (SELECT date, round(avg(close), 2) AS c FROM ({bars_sql()}) GROUP BY 1)) USING (date)",
    lambda s, d: labels.excess(_forward(s, d), panels.bars(s, d).groupBy("date").agg(F.round(F.avg("close"), 2).alias("close")), 3).withColumn("label", F.col("label") + 0.0),
)
_AHEAD = "SELECT date, code, close, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING) AS p FROM ({1}) WHERE close IS NOT NULL"
simple(
    "forward_sharpe",
    f"SELECT date, code, CASE WHEN len(p) > 4 THEN {rs('list_avg(m) / nullif(list_stddev_samp(m), 0) * sqrt(12)', 4, 'label')[:-9]} END AS label FROM (SELECT *, list_transform(range(1, len(p)), lambda i: p[i + 1] / p[i] - 1) AS m FROM ({_AHEAD.format(6, BARE)}))",
    lambda s, d: labels.forward_sharpe(dense(s, d), 6, 4, 12).select("date", "code", r("label", 4)),
)
simple(
    "barrier_returns",
    f"SELECT date, code, CASE WHEN len(p) = 5 THEN {rs('CASE WHEN hi >= close * 1.5 AND (top_at <= low_at OR lo > close * 0.6) THEN 0.5 WHEN lo <= close * 0.6 THEN -0.4 ELSE p[5] / close - 1 END', 4, 'label')[:-9]} END AS label FROM (SELECT *, list_max(p) AS hi, list_min(p) AS lo, list_position(p, list_max(p)) AS top_at, list_position(p, list_min(p)) AS low_at FROM ({_AHEAD.format(4, BARE)}))",
    lambda s, d: labels.barrier_returns(dense(s, d), 0.5, 0.4, 4).select("date", "code", r("label", 4)),
)
simple(
    "path_labels",
    f"SELECT date, code, CASE WHEN n = 4 THEN {rs('l / open - 1', 4, 'hold')[:-8]} END AS hold, CASE WHEN n = 4 AND paused <> 1 AND open <> high_limit AND open <> low_limit THEN {rs('l / open - 1', 4, 'free')[:-8]} END AS free FROM (SELECT *, count(*) OVER w AS n, last_value(close) OVER w AS l FROM ({LIMITS_SQL}) WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))",
    lambda s, d: _paths(s, d),
)


def _paths(s: SparkSession, d: str) -> DataFrame:
    columns = ("open", "close", "high_limit", "low_limit", "paused")
    hold = labels.path_labels(limited(s, d), 3, columns, lambda p: F.struct(labels.buy_and_hold(p).alias("hold"), labels.hold_unless_stuck(p).alias("free")))
    return hold.select("date", "code", F.col("label.hold").alias("hold"), F.col("label.free").alias("free")).select("date", "code", r("hold", 4), r("free", 4))


simple("sign_classes", f"SELECT date, code, CAST(forward_3 > 0 AS INT) AS label FROM ({FWD_SQL})", lambda s, d: labels.sign_class(_forward(s, d)))
simple("group_classes", f"SELECT date, code, {Q5.format('forward_3')} AS label FROM ({FWD_SQL})", lambda s, d: labels.group_class(_forward(s, d), 5))

# Windows of the calendar, functions, dates.
simple(
    "calendar_windows",
    f"SELECT date, code, {rs('avg(close) OVER w', 2, 'mean_90')}, count(*) OVER w AS n FROM ({bars_sql('day')}) WINDOW w AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)",
    lambda s, d: (lambda w: panels.bars(s, d, "day").select("date", "code", F.avg("close").over(w).alias("mean_90"), F.count("*").over(w).alias("n")).select("date", "code", r("mean_90", 2), "n"))(Window.partitionBy("code").orderBy(F.unix_date("date")).rangeBetween(-89, 0)),
)
_CDF = dates.NORMAL_SQL.format("(x)")
simple("more_functions", f"SELECT date, code, {rs('sin(close / 1000)', 6, 'sine')}, {rs('cos(close / 1000)', 6, 'cosine')}, {rs(_CDF, 5, 'cdf')} FROM (SELECT *, (close - 40000) / 20000 AS x FROM ({BARE})) WHERE close IS NOT NULL", lambda s, d: dense(s, d).filter("close is not null").select("date", "code", F.sin(F.col("close") / 1000).alias("sine"), F.cos(F.col("close") / 1000).alias("cosine"), dates.normal_cdf((F.col("close") - 40000) / 20000).alias("cdf")).select("date", "code", r("sine", 6), r("cosine", 6), r("cdf", 5)))
simple(
    "quarter_strings",
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') || 'S' || quarter(o_orderdate) AS at, strftime(o_orderdate - INTERVAL 9 MONTH, '%Y') || 'S' || quarter(o_orderdate - INTERVAL 9 MONTH) AS before, month(o_orderdate) = 12 AND day(o_orderdate) = 31 AS year_end, CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) AND month(o_orderdate) % 3 = 0 AS quarter_end FROM orders",
    lambda s, d: panels.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), dates.quarter_name("o_orderdate").alias("at"), dates.shift_quarter(dates.quarter_name("o_orderdate"), -3).alias("before"), dates.is_end("o_orderdate", "year").alias("year_end"), dates.is_end("o_orderdate", "month").alias("month_end"), dates.is_end("o_orderdate", "quarter").alias("quarter_end")),
)
simple("joined_panels", f"SELECT a.date, a.code, a.close, b.done FROM ({BARE}) a LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS code, count(*) AS done FROM orders GROUP BY 1, 2) b USING (date, code)", lambda s, d: joins.left_panels(dense(s, d).select("date", "code", "close"), panels.table(s, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("o_custkey").alias("code")).agg(F.count("*").alias("done"))))
