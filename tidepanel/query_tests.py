"""Queries of significance, of labels of rules within a unit, and of running means of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as x
from .operators import evaluate, labels, models, report
from .queries import bars_sql, expressions
from .query_panels import IC_SQL, LAB_SQL, labelled, simple
from .sources import panels
from .streaming.running import running_means


def _two_sided(t: str, v: str) -> str:
    """The p value of t with v degrees of freedom, by the finite series for whole degrees."""
    angle = f"atan(abs({t}) / sqrt({v}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, CAST({v} AS BIGINT) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + 2 * j * ln(cos({angle})))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (CAST({v} AS BIGINT) - 1) // 2), lambda j: exp(0.5 * ln(pi()) + lgamma(j + 1) - ln(2) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos({angle}))))), 0))"
    return f"(1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)"


simple(
    "ic_significance",
    f"SELECT n, round(t + 3e-8, 4) AS t, round({_two_sided('t', '(n - 1)')} + 3e-8, 6) AS p FROM (SELECT count(ic) AS n, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t FROM ({IC_SQL}))",
    lambda s, d: evaluate.information_analysis(evaluate.information_coefficient(labelled(s, d))).select("n", x.rounded("t", 4).alias("t"), x.rounded("p", 6).alias("p")),
)
_T = "sign(regr_slope(label, value)) * sqrt(regr_r2(label, value) * (regr_count(label, value) - 2) / (1 - regr_r2(label, value)))"
simple(
    "regression_significance",
    f"SELECT CAST(n AS BIGINT) AS n, round(t + 3e-8, 4) AS t, round({_two_sided('t', '(n - 2)')} + 3e-8, 6) AS p FROM (SELECT regr_count(label, value) AS n, {_T} AS t FROM {LAB_SQL} WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))",
    lambda s, d: models.regression_report(labelled(s, d).join(panels.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code")), "code", "left_semi"), "value", "label").select(F.col("n").cast("long").alias("n"), x.rounded("t", 4).alias("t"), x.rounded("p", 6).alias("p")),
)

ROUNDS = 25


def _absolute_regression(q: float = 0.5) -> str:
    """The rounds of weighted least squares, one table a round, and the error by the quantiles of the residuals."""
    parts = [f"v AS MATERIALIZED (SELECT CAST(label AS DOUBLE) AS y, value AS x FROM {LAB_SQL} WHERE label IS NOT NULL AND value IS NOT NULL)", "f0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, CAST(NULL AS DOUBLE) AS least)"]
    for k in range(ROUNDS):
        w = f"CASE WHEN least IS NULL THEN 1.0 ELSE (CASE WHEN y - a - b * x >= 0 THEN {q} ELSE {1 - q} END) / greatest(abs(y - a - b * x), least) END"
        sums = f"SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, avg(abs(r)) AS size FROM (SELECT x, y, y - a - b * x AS r, {w} AS w FROM v, f{k})"
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT (sy - b * sx) / n AS a, b, greatest(1e-12, {max(1e-6, 0.5**k)!r} * size) AS least FROM (SELECT *, (n * sxy - sx * sy) / greatest(n * sxx - sx * sx, 1e-9) AS b FROM ({sums})))")
    parts.append(f"e AS (SELECT count(*) AS n, var_pop(x) * count(*) AS sxx, any_value(a) AS a, any_value(b) AS b, list(y - a - b * x ORDER BY y - a - b * x) AS r FROM v, f{ROUNDS})")
    # The median's bandwidth: 1.96 ** (2/3) * (1.5 / (2 pi)) ** (1/3) * n ** (-1/3).
    parts.append("h AS (SELECT *, pow(1.959963984540054, 2.0 / 3) * pow(1.5 / (2 * pi()), 1.0 / 3) * pow(n, -1.0 / 3) AS h FROM e)")
    at = lambda side: f"(r[CAST(floor((n - 1) * (0.5 {side} h)) AS BIGINT) + 1] + ((n - 1) * (0.5 {side} h) - floor((n - 1) * (0.5 {side} h))) * (r[CAST(ceil((n - 1) * (0.5 {side} h)) AS BIGINT) + 1] - r[CAST(floor((n - 1) * (0.5 {side} h)) AS BIGINT) + 1]))"
    return "WITH " + ",\n".join(parts) + f"\nSELECT n, round(a + 3e-8, 3) + 0.0 AS intercept, round(b + 3e-8, 3) + 0.0 AS slope, round(0.5 / sqrt(sxx) * ({at('+')} - {at('-')}) / (2 * h) + 3e-8, 4) AS std_error FROM h"


simple("median_regression", _absolute_regression(), lambda s, d: report.quantile_regression_report(labelled(s, d), "label", "value", 0.5, ROUNDS).select("n", *[(x.rounded(k, n) + 0.0).alias(k) for k, n in (("intercept", 3), ("slope", 3), ("std_error", 4))]))

_BARS = bars_sql("day")
simple(
    "double_mean_labels",
    f"""WITH r AS (SELECT date, code, close / lag(close) OVER w - 1 AS ret, count(close) OVER (w ROWS 2 PRECEDING) AS n3, avg(close) OVER (w ROWS 2 PRECEDING) AS m3, count(close) OVER (w ROWS 6 PRECEDING) AS n7, avg(close) OVER (w ROWS 6 PRECEDING) AS m7 FROM ({_BARS}) WINDOW w AS (PARTITION BY code ORDER BY date)),
e AS (SELECT *, CASE WHEN coalesce(lag(n3 = 3 AND n7 = 7 AND m3 >= m7) OVER (PARTITION BY code ORDER BY date), false) THEN ret ELSE 0 END AS earned FROM r),
d AS MATERIALIZED (SELECT CAST(date_trunc('month', date) AS DATE) AS date, code, coalesce(sum(earned), 0) AS earned FROM e GROUP BY 1, 2),
t AS (SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date, 3) OVER (ORDER BY date) AS label_end FROM (SELECT DISTINCT date FROM d WHERE earned <> 0))
SELECT a.date, a.code, round(CASE WHEN count(b.earned) = 3 THEN sum(b.earned) END + 3e-8, 4) + 0.0 AS label, a.label_end FROM (SELECT * FROM d JOIN t USING (date)) a LEFT JOIN (SELECT * FROM d JOIN t USING (date)) b ON a.code = b.code AND b.i BETWEEN a.i + 1 AND a.i + 3 GROUP BY a.date, a.code, a.label_end""",
    lambda s, d: labels.double_mean_returns(panels.bars(s, d, "day"), 3, 7, 3, "month").select("date", "code", (x.rounded("label", 4) + 0.0).alias("label"), "label_end"),
)
simple(
    "intraday_sharpe_labels",
    f"""WITH r AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM ({_BARS})),
s AS (SELECT date, code, CASE WHEN count(ret) OVER w = 5 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) END AS s FROM r WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
d AS MATERIALIZED (SELECT CAST(date_trunc('month', date) AS DATE) AS date, code, arg_max(s, date) AS s FROM s WHERE s IS NOT NULL GROUP BY 1, 2),
t AS (SELECT date, lead(date, 2) OVER (ORDER BY date) AS label_end FROM (SELECT DISTINCT date FROM d))
SELECT * FROM (SELECT date, code, round((s - avg(s) OVER (PARTITION BY date)) / nullif(stddev_samp(s) OVER (PARTITION BY date), 0) + 3e-8, 4) + 0.0 AS label, label_end FROM d JOIN t USING (date)) WHERE label IS NOT NULL""",
    lambda s, d: labels.intraday_sharpe(panels.bars(s, d, "day"), 5, 2, "month").withColumn("label", F.col("label") + 0.0),
)
_returns = x.returns(x.col("close"))
expressions("signed_variances", {"up": x.positive_variance(_returns, 12), "down": x.negative_variance(_returns, 12)}, 4, days=True)

_EVENT_MEANS = {"m_5": 5, "m_20": 20}
simple(
    "running_event_means",
    """WITH RECURSIVE v AS MATERIALIZED (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY k ROWS 4 PRECEDING) AS s5, avg(value) OVER (PARTITION BY event_type ORDER BY k ROWS 19 PRECEDING) AS s20 FROM (SELECT event_id, ts, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)),
r(event_type, k, m5, m20) AS (SELECT event_type, k, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM v WHERE k = 1 UNION ALL
 SELECT v.event_type, v.k, CASE WHEN v.k = 5 THEN s5 WHEN v.k > 5 THEN r.m5 + (value - r.m5) / 3 END, CASE WHEN v.k = 20 THEN s20 WHEN v.k > 20 THEN r.m20 + (value - r.m20) * 2 / 21 END FROM r JOIN v ON v.event_type = r.event_type AND v.k = r.k + 1)
SELECT event_id, event_type, round(m5 + 3e-8, 4) AS m_5, round(m20 + 3e-8, 4) AS m_20 FROM r JOIN v USING (event_type, k)""",
    lambda s, d: running_means(panels.table(s, d, "events"), _EVENT_MEANS).select("event_id", "event_type", *[x.rounded(k, 4).alias(k) for k in _EVENT_MEANS]),
)
simple(
    "adjusted_bars",
    f"SELECT date, code, {', '.join(f'round({k} * (1 + month(date) / 100.0::DOUBLE) + 3e-8, 4) AS adj_{k}' for k in ('open', 'high', 'low', 'close'))} FROM ({bars_sql()})",
    lambda s, d: panels.adjusted(panels.bars(s, d).withColumn("factor", 1 + F.month("date") / F.lit(100.0))).select("date", "code", *[x.rounded(f"adj_{k}", 4).alias(f"adj_{k}") for k in ("open", "high", "low", "close")]),
)
