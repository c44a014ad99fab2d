"""Queries of weights under bands and turnover, and of principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as x
from .operators import optimise, principal
from .query_models import _with_benchmark
from .query_panels import LAB_SQL, simple
from .query_walk import SCORED_SQL, scored

TILT, BAND, LIMIT = 0.01, 0.02, 0.3


def _held(s: SparkSession, d: str) -> DataFrame:
    """Scores, benchmark weights by cap, sectors, and as previous weights those by cap among the codes with an even number."""
    df = _with_benchmark(s, d)
    even = F.sum(F.when(F.col("code") % 2 == 0, F.col("b"))).over(x.Window.partitionBy("date"))
    return df.withColumn("previous", F.when(F.col("code") % 2 == 0, F.try_divide(F.col("b"), even)))


HELD_SQL = f"""held AS MATERIALIZED (SELECT *, CASE WHEN code % 2 = 0 THEN b / sum(CASE WHEN code % 2 = 0 THEN b END) OVER (PARTITION BY date) END AS previous FROM (SELECT date, code, value, n_regionkey AS g, cap / nullif(sum(cap) OVER (PARTITION BY date), 0) AS b FROM {LAB_SQL} JOIN supplier ON code = s_suppkey JOIN nation ON s_nationkey = n_nationkey)),
m AS MATERIALIZED (SELECT *, greatest(base, held - {BAND}) AS l, least(room, held + {BAND}) AS u FROM (SELECT *, sum(lo) OVER (PARTITION BY date, g) AS base, sum(b) OVER (PARTITION BY date, g) AS held, sum(hi) OVER (PARTITION BY date, g) AS room, sum(b) OVER (PARTITION BY date) AS total, sum(lo) OVER (PARTITION BY date) AS low
 FROM (SELECT date, code, g, coalesce(value, min(value) OVER (PARTITION BY date) - coalesce(stddev_samp(value) OVER (PARTITION BY date), 0), 0) AS s, coalesce(b, 0) AS b, greatest(0.0, coalesce(b, 0) - {TILT}) AS lo, coalesce(b, 0) + {TILT} AS hi, coalesce(previous, 0) AS p FROM held)))"""


def _greedy(points: str) -> str:
    """The greedy optimum at each point (date, t): rows (date, t, code, p, weight)."""
    mid = "greatest(lo, least(p, hi))"
    pieces = f"SELECT m.*, t, 0 AS k, s + t AS gain, {mid} - lo AS r FROM m JOIN {points} USING (date) UNION ALL SELECT m.*, t, 1 AS k, s - t AS gain, hi - {mid} AS r FROM m JOIN {points} USING (date)"
    placed = f"SELECT *, coalesce(sum(r) OVER (PARTITION BY date, t, g ORDER BY gain DESC, code, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ({pieces})"
    parts = f"SELECT *, greatest(0.0, least(l - base - ahead, r)) AS own, greatest(0.0, least(ahead + r, u - base) - greatest(ahead, l - base)) AS more FROM ({placed})"
    taken = f"SELECT *, coalesce(sum(more) OVER (PARTITION BY date, t ORDER BY gain DESC, code, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(own) OVER (PARTITION BY date, t) AS owned FROM ({parts})"
    return f"(SELECT date, t, code, any_value(p) AS p, any_value(lo) + sum(own + greatest(0.0, least(total - owned - low - before, more))) AS weight FROM ({taken}) GROUP BY date, t, code)"


def _turnover_sql() -> str:
    steps = [HELD_SQL, "r0 AS (SELECT date, 0.0::DOUBLE AS a, (max(s) - min(s)) * 1.001 + 1e-12 AS b FROM m GROUP BY date)"]
    for i in range(optimise.ROUNDS):
        steps.append(f"p{i} AS MATERIALIZED (SELECT DISTINCT date, a + (b - a) * k / {optimise.GRID} AS t FROM r{i}, range({optimise.GRID + 1}) q(k))")
        steps.append(f"t{i} AS MATERIALIZED (SELECT date, t, sum(abs(weight - p)) AS turnover FROM {_greedy(f'p{i}')} GROUP BY date, t)")
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT date, CASE WHEN f IS NULL THEN z ELSE coalesce(max(CASE WHEN turnover > {LIMIT} AND t < f THEN t END), f) END AS a, coalesce(f, z) AS b FROM (SELECT *, min(CASE WHEN turnover <= {LIMIT} THEN t END) OVER (PARTITION BY date) AS f, max(t) OVER (PARTITION BY date) AS z FROM t{i}) GROUP BY date, f, z)"
        )
    last = f"r{optimise.ROUNDS}"
    steps.append(f"ends AS MATERIALIZED (SELECT DISTINCT date, t FROM (SELECT date, a AS t FROM {last} UNION ALL SELECT date, b AS t FROM {last}))")
    steps.append(f"pair AS MATERIALIZED (SELECT date, code, any_value(p) AS p, arg_min(weight, t) AS more, arg_max(weight, t) AS less FROM {_greedy('ends')} GROUP BY date, code)")
    steps.append("far AS (SELECT *, sum(abs(more - p)) OVER (PARTITION BY date) AS a, sum(abs(less - p)) OVER (PARTITION BY date) AS z FROM pair)")
    share = f"CASE WHEN a > {LIMIT} AND z <= {LIMIT} THEN ({LIMIT} - z) / (a - z) WHEN a <= {LIMIT} THEN 1 ELSE 0 END"
    return "WITH " + ",\n".join(steps) + f"\nSELECT date, code, round(more * ({share}) + less * (1 - ({share})) + 3e-8, 4) + 0.0 AS weight FROM far"


simple(
    "banded_weights",
    f"WITH {HELD_SQL}, zero AS (SELECT DISTINCT date, 0.0::DOUBLE AS t FROM m), z AS MATERIALIZED (SELECT * REPLACE (0.0::DOUBLE AS p) FROM m) SELECT date, code, round(weight + 3e-8, 5) + 0.0 AS weight FROM {_greedy('zero').replace('FROM m JOIN', 'FROM z AS m JOIN')}",
    lambda s, d: optimise.banded_weights(_held(s, d), "value", "b", TILT, "sector", BAND).select("date", "code", x.rounded("weight", 5).alias("weight")),
)
simple("turnover_weights", _turnover_sql(), lambda s, d: optimise.turnover_weights(_held(s, d), "value", "b", TILT, "sector", BAND, "previous", LIMIT).select("date", "code", x.rounded("weight", 4).alias("weight")))

PAIR_SQL = f"""f AS (SELECT date, code, a, b FROM {SCORED_SQL}),
c AS (SELECT date, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, var_samp(b) AS sbb, covar_samp(a, b) AS sab FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY date HAVING count(*) > 1),
e AS (SELECT *, (saa + sbb) / 2 + sqrt(pow((saa - sbb) / 2, 2) + sab * sab) AS l1, (saa + sbb) / 2 - sqrt(pow((saa - sbb) / 2, 2) + sab * sab) AS l2 FROM c),
v AS (SELECT *, CASE WHEN saa >= sbb THEN l1 - sbb ELSE sab END AS xa, CASE WHEN saa >= sbb THEN sab ELSE l1 - saa END AS xb FROM e)"""
# The second loading is across the first; its largest part is positive as well.
simple(
    "principal_pair",
    f"""WITH {PAIR_SQL} SELECT f.date, f.code, round(sign(CASE WHEN abs(xa) >= abs(xb) THEN xa ELSE xb END) * ((a - ma) * xa + (b - mb) * xb) / sqrt(xa * xa + xb * xb) + 3e-8, 5) + 0.0 AS pc_1,
 round(sign(CASE WHEN abs(xb) >= abs(xa) THEN -xb ELSE xa END) * ((b - mb) * xa - (a - ma) * xb) / sqrt(xa * xa + xb * xb) + 3e-8, 5) + 0.0 AS pc_2 FROM f LEFT JOIN v ON f.date = v.date""",
    lambda s, d: principal.principal_components(scored(s, d), ["a", "b"], 2).select("date", "code", *[(x.rounded(k, 5) + 0.0).alias(k) for k in ("pc_1", "pc_2")]),
)
simple(
    "principal_share",
    f"""WITH {PAIR_SQL} SELECT f.date, f.code, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND l1 IS NOT NULL THEN CASE WHEN l1 > 0.98 * (l1 + l2) THEN 1 ELSE 2 END ELSE 0 END AS n FROM f LEFT JOIN v ON f.date = v.date""",
    lambda s, d: principal.principal_components(scored(s, d), ["a", "b"], 0.98).select("date", "code", (F.col("pc_1").isNotNull().cast("int") + F.col("pc_2").isNotNull().cast("int")).alias("n")),
)
simple(
    "orthogonal_pair",
    f"""WITH {PAIR_SQL}, i AS (SELECT *, sbb / dt AS iaa, saa / dt AS ibb, -sab / dt AS iab, sqrt(1 / dt) AS rd FROM (SELECT *, saa * sbb - sab * sab AS dt FROM c) WHERE dt > 0), h AS (SELECT *, sqrt(iaa + ibb + 2 * rd) AS w FROM i)
 SELECT f.date, f.code, round(((a - ma) * (iaa + rd) + (b - mb) * iab) / w + 3e-8, 4) + 0.0 AS a_orth, round(((a - ma) * iab + (b - mb) * (ibb + rd)) / w + 3e-8, 4) + 0.0 AS b_orth FROM f LEFT JOIN h ON f.date = h.date""",
    lambda s, d: principal.orthogonal(scored(s, d), ["a", "b"]).select("date", "code", *[(x.rounded(k, 4) + 0.0).alias(k) for k in ("a_orth", "b_orth")]),
)
_Z = {"p": "a", "q": "b", "r": "clipped"}
_COV = {f"{i}{j}": f"covar_samp({_Z[i]}, {_Z[j]})" for i, j in ("pp", "pq", "pr", "qq", "qr", "rr")}
simple(
    "principal_values",
    f"""WITH c AS (SELECT date, {", ".join(f"{v} AS {k}" for k, v in _COV.items())} FROM (SELECT *, greatest(-1.0, least(1.0, label)) AS clipped FROM {SCORED_SQL}) WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL GROUP BY date HAVING count(*) > 1),
q AS (SELECT *, (pp + qq + rr) / 3 AS m, sqrt((pow(pp - (pp + qq + rr) / 3, 2) + pow(qq - (pp + qq + rr) / 3, 2) + pow(rr - (pp + qq + rr) / 3, 2) + 2 * (pq * pq + pr * pr + qr * qr)) / 6) AS s FROM c),
d AS (SELECT *, acos(greatest(-1.0, least(1.0, ((pp - m) * ((qq - m) * (rr - m) - qr * qr) - pq * (pq * (rr - m) - qr * pr) + pr * (pq * qr - (qq - m) * pr)) / nullif(2 * s * s * s, 0)))) / 3 AS phi FROM q)
SELECT date, round(m + 2 * s * cos(phi) + 3e-8, 5) AS first, round(m - 2 * s * cos(phi) - 2 * s * cos(phi + 2 * pi() / 3) + 3e-8, 5) AS second, round(m + 2 * s * cos(phi + 2 * pi() / 3) + 3e-8, 5) AS third FROM d""",
    lambda s, d: principal.components(scored(s, d).withColumn("clipped", F.when(F.col("label").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("label"))))), ["a", "b", "clipped"])
    .filter("n > 1")
    .select("date", *[F.get("pairs", F.lit(i))["value"].alias(k) for i, k in enumerate(("first", "second", "third"))])
    .select("date", *[x.rounded(k, 5).alias(k) for k in ("first", "second", "third")]),
)
