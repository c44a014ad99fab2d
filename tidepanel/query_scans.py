"""Queries of recurrences, checked by recursive SQL, and of the as-of join by buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as x
from .operators import joins, scan
from .queries import DENSE_SQL, dense
from .query_panels import BARE, QUERY_TIMES_SQL, _orders, _quarter_ends, simple

simple("asof_bucketed", QUERY_TIMES_SQL, lambda s, d: joins.asof_bucketed(_quarter_ends(s, d), _orders(s, d), ["price"], "year", "date", "pub_date").select("code", F.to_date("date").alias("date"), "price"))


def _mean(name: str, n: int, alpha: float, value: str = "v", index: str = "k") -> str:
    return f"CASE WHEN o.{index} = {n} THEN o.{name} WHEN o.{index} > {n} THEN r.{name} * {1 - alpha!r} + o.{value} * {alpha!r} END"


def _seed(n: int, name: str, value: str = "v", index: str = "k") -> str:
    return f"CASE WHEN {index} = {n} THEN avg({value}) OVER (PARTITION BY code ORDER BY {index} ROWS {n - 1} PRECEDING) END AS {name}"


def _recursion(name: str, rows: str, index: str, kept: dict[str, str]) -> str:
    """A recursive table (code, index, means) over ``rows``, which hold seeds under the names of the means."""
    first = ", ".join(f"CASE WHEN {index} = 1 THEN {k} END" for k in kept)
    return f"{name}(code, {index}, {', '.join(kept)}) AS (SELECT code, {index}, {first} FROM {rows} WHERE {index} = 1 UNION ALL SELECT o.code, o.{index}, {', '.join(kept.values())} FROM {name} r JOIN {rows} o ON o.code = r.code AND o.{index} = r.{index} + 1)"


INDICATORS_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT date, code, close FROM ({BARE})),
v AS MATERIALIZED (SELECT date, code, v, k, {_seed(6, "ema_6")}, {_seed(5, "sma_6_2")}, {_seed(12, "fast")}, {_seed(26, "slow")} FROM (SELECT date, code, close AS v, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM b WHERE close IS NOT NULL)),
s AS MATERIALIZED (SELECT date, code, k, greatest(v, 0.0) AS u, greatest(-v, 0.0) AS w, {_seed(6, "up", "greatest(v, 0.0)")}, {_seed(6, "down", "greatest(-v, 0.0)")} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM (SELECT date, code, close - lag(close) OVER (PARTITION BY code ORDER BY date) AS v FROM b) WHERE v IS NOT NULL)),
{_recursion("means", "v", "k", {"ema_6": _mean("ema_6", 6, 2 / 7), "sma_6_2": _mean("sma_6_2", 5, 2 / 6), "fast": _mean("fast", 12, 2 / 13), "slow": _mean("slow", 26, 2 / 27)})},
{_recursion("moves", "s", "k", {"up": _mean("up", 6, 1 / 6, "u"), "down": _mean("down", 6, 1 / 6, "w")})},
m AS MATERIALIZED (SELECT code, k, j, v, {_seed(9, "signal", "v", "j")} FROM (SELECT code, k, k - 25 AS j, fast - slow AS v FROM means WHERE k >= 26)),
{_recursion("signals", "m", "j", {"signal": _mean("signal", 9, 0.2, "v", "j")})}
SELECT b.date, b.code, round(means.ema_6 + 3e-8, 4) AS ema_6, round(means.sma_6_2 + 3e-8, 4) AS sma_6_2, round(100 * moves.up / nullif(moves.up + moves.down, 0) + 3e-8, 4) AS rsi_6, round(means.fast - means.slow + 3e-8, 4) + 0.0 AS macd, round(signals.signal + 3e-8, 4) + 0.0 AS macd_signal
FROM b LEFT JOIN v ON b.date = v.date AND b.code = v.code LEFT JOIN means ON means.code = v.code AND means.k = v.k LEFT JOIN s ON b.date = s.date AND b.code = s.code LEFT JOIN moves ON moves.code = s.code AND moves.k = s.k LEFT JOIN signals ON signals.code = v.code AND signals.j = v.k - 25"""

simple(
    "recursive_indicators",
    INDICATORS_SQL,
    lambda s, d: scan.indicators(dense(s, d)).select("date", "code", *[x.rounded(k, 4).alias(k) for k in ("ema_6", "sma_6_2", "rsi_6", "macd", "macd_signal")]),
)

_PACE = f"{2 / 3 - 2 / 31!r}"
LEVELS_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT date, code, high, low, close FROM ({DENSE_SQL})),
v AS MATERIALIZED (SELECT *, pow(coalesce(abs(v - far) / nullif(path, 0), 0) * {_PACE} + {2 / 31!r}, 2) AS w FROM (SELECT *, lag(v, 6) OVER (PARTITION BY code ORDER BY k) AS far, sum(abs(v - near)) OVER (PARTITION BY code ORDER BY k ROWS 5 PRECEDING) AS path FROM (SELECT date, code, close AS v, row_number() OVER (PARTITION BY code ORDER BY date) AS k, lag(close) OVER (PARTITION BY code ORDER BY date) AS near FROM b WHERE close IS NOT NULL))),
a(code, k, y) AS (SELECT code, k, v FROM v WHERE k = 6 UNION ALL SELECT v.code, v.k, a.y + v.w * (v.v - a.y) FROM a JOIN v ON v.code = a.code AND v.k = a.k + 1),
t AS MATERIALIZED (SELECT date, code, high AS h, low AS l, row_number() OVER w AS k, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM b WHERE high IS NOT NULL AND low IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY date)),
p(code, k, up, out, stop, extreme, pace) AS (
 SELECT code, k, NOT (l1 - l > greatest(h - h1, 0.0)), CAST(NULL AS DOUBLE), CASE WHEN NOT (l1 - l > greatest(h - h1, 0.0)) THEN l1 ELSE h1 END, CASE WHEN NOT (l1 - l > greatest(h - h1, 0.0)) THEN h ELSE l END, CAST(0.02 AS DOUBLE) FROM (SELECT * REPLACE (1 AS k) FROM t WHERE k = 2)
 UNION ALL
 SELECT code, k, up, out, CASE WHEN up THEN least(out + pace * (extreme - out), l, l1) ELSE greatest(out + pace * (extreme - out), h, h1) END, extreme, pace FROM (
  SELECT t.code, t.k, t.h, t.l, t.h1, t.l1, p.up <> passed AS up, CASE WHEN NOT passed THEN stop WHEN p.up THEN greatest(extreme, t.h, t.h1) ELSE least(extreme, t.l, t.l1) END AS out,
   CASE WHEN passed THEN (CASE WHEN p.up THEN t.l ELSE t.h END) WHEN p.up THEN greatest(extreme, t.h) ELSE least(extreme, t.l) END AS extreme,
   CASE WHEN passed THEN 0.02 WHEN (p.up AND t.h > extreme) OR (NOT p.up AND t.l < extreme) THEN least(0.2, pace + 0.02) ELSE pace END AS pace
  FROM (SELECT p.*, CASE WHEN p.up THEN n.l <= p.stop ELSE n.h >= p.stop END AS passed FROM p JOIN t n ON n.code = p.code AND n.k = p.k + 1) p JOIN t ON t.code = p.code AND t.k = p.k + 1))
SELECT b.date, b.code, round(a.y + 3e-8, 4) AS adaptive, round(p.out + 3e-8, 4) AS stop FROM b LEFT JOIN v ON v.date = b.date AND v.code = b.code LEFT JOIN a ON a.code = v.code AND a.k = v.k AND a.k > 6 LEFT JOIN t ON t.date = b.date AND t.code = b.code LEFT JOIN p ON p.code = t.code AND p.k = t.k"""

simple("trailing_levels", LEVELS_SQL, lambda s, d: scan.trailing_levels(dense(s, d)).select("date", "code", x.rounded("adaptive", 4).alias("adaptive"), x.rounded("stop", 4).alias("stop")))
