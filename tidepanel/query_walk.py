"""Queries of classifiers and penalised regressions fitted forward in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as x
from .operators import walk_forward as wf
from .query_panels import LAB_SQL, labelled, simple

POLICY = wf.Policy(every=24, first=24, embargo=1)
STEPS = 5
FACTORS = ["a", "b"]


def scored(s: SparkSession, d: str) -> DataFrame:
    """(date, code, a, b, label, up): two bounded factors, the next return and whether it is a gain."""
    df = labelled(s, d)
    return df.select("date", "code", "value", "label", (F.col("value") / (1 + F.abs("value"))).alias("a"), (F.ln("cap") / 10).alias("b"), F.when(F.col("label").isNotNull(), (F.col("label") > 0).cast("double")).alias("up"))


SCORED_SQL = f"(SELECT date, code, value, label, value / (1 + abs(value)) AS a, ln(cap) / 10 AS b, CASE WHEN label IS NOT NULL THEN CAST(label > 0 AS DOUBLE) END AS up FROM {LAB_SQL})"


def _newton(steps: int, weight: str = "1.0") -> str:
    """Newton steps for three coefficients, each a table ``s<step>`` (t, n, b0, b1, b2), solved by Cramer's rule."""
    d0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
    d1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
    d2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    parts = [
        f"dates AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {SCORED_SQL}))",
        f"p AS MATERIALIZED (SELECT q.*, i FROM {SCORED_SQL} q JOIN dates USING (date))",
        f"fits AS (SELECT date, i AS t, coalesce(lead(i) OVER (ORDER BY i) - 1, (SELECT max(i) FROM dates)) AS u FROM dates WHERE i >= {POLICY.first} AND (i - {POLICY.first}) % {POLICY.every} = 0)",
        f"r AS MATERIALIZED (SELECT t, a, b, up, {weight} AS w FROM p JOIN fits ON i <= t - {POLICY.embargo} WHERE a IS NOT NULL AND b IS NOT NULL AND up IS NOT NULL)",
        "s0 AS (SELECT t, 0 AS n, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM fits)",
    ]
    for k in range(steps):
        parts.append(
            f"s{k + 1} AS MATERIALIZED (SELECT t, n, b0 + {d0} / {det} AS b0, b1 + {d1} / {det} AS b1, b2 + {d2} / {det} AS b2 FROM (SELECT t, b0, b1, b2, count(*) AS n, sum(w * (up - q)) AS g0, sum(w * (up - q) * a) AS g1, sum(w * (up - q) * b) AS g2,"
            f" sum(w * q * (1 - q)) AS h00, sum(w * q * (1 - q) * a) AS h01, sum(w * q * (1 - q) * b) AS h02, sum(w * q * (1 - q) * a * a) AS h11, sum(w * q * (1 - q) * a * b) AS h12, sum(w * q * (1 - q) * b * b) AS h22"
            f" FROM (SELECT r.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS q FROM r JOIN s{k} USING (t)) GROUP BY t, b0, b1, b2))"
        )
    return "WITH " + ",\n".join(parts)


def _coefficients(df: DataFrame, names: tuple[str, ...] = ("b0", "b1", "b2"), digits: int = 4) -> DataFrame:
    got = df.withColumns({k: F.get("beta", F.lit(i)) for i, k in enumerate(names)})
    return got.withColumns({k: x.rounded(k, digits) + 0.0 for k in names}).drop("beta")


_ROUNDED = ", ".join(f"round(b{i} + 3e-8, 4) + 0.0 AS b{i}" for i in range(3))
simple(
    "walk_forward_logistic",
    f"{_newton(STEPS)} SELECT f.date, d.date AS until, CAST(n AS BIGINT) AS n, {_ROUNDED} FROM s{STEPS} JOIN fits f USING (t) JOIN dates d ON d.i = f.u",
    lambda s, d: _coefficients(wf.logistic_fits(scored(s, d), FACTORS, "up", POLICY, STEPS)),
)
simple(
    "walk_forward_weighted_logistic",
    f"{_newton(STEPS, '1 + abs(label)')} SELECT f.date, d.date AS until, CAST(n AS BIGINT) AS n, {_ROUNDED} FROM s{STEPS} JOIN fits f USING (t) JOIN dates d ON d.i = f.u",
    lambda s, d: _coefficients(wf.logistic_fits(scored(s, d).withColumn("w", 1 + F.abs("label")), FACTORS, "up", POLICY, STEPS, weight="w")),
)
simple(
    "walk_forward_probability",
    f"{_newton(STEPS)} SELECT date, code, round(1 / (1 + exp(-(b0 + b1 * a + b2 * b))) + 3e-8, 5) AS probability FROM p JOIN (SELECT t, u, b0, b1, b2 FROM s{STEPS} JOIN fits USING (t)) ON i BETWEEN t AND u",
    lambda s, d: (lambda df: wf.logistic_scores(df, FACTORS, wf.logistic_fits(df, FACTORS, "up", POLICY, STEPS)).select("date", "code", x.rounded("probability", 5).alias("probability")))(scored(s, d)),
)
simple(
    "score_votes",
    f"SELECT date, code, round((CASE WHEN value > 0.1 THEN 1 ELSE 0 END + CASE WHEN a > 0.1 THEN 1 ELSE 0 END + CASE WHEN b > 0.1 THEN 1 ELSE 0 END) / nullif((value IS NOT NULL)::INT + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 5) AS vote FROM {SCORED_SQL}",
    lambda s, d: wf.votes(scored(s, d), ["value", "a", "b"], threshold=0.1).select("date", "code", F.round("vote", 5).alias("vote")),
)
_GAIN = "(SELECT date, code, value AS s, greatest(label, 0.0) AS g FROM " + SCORED_SQL + " WHERE value IS NOT NULL AND label IS NOT NULL)"
simple(
    "ranking_ndcg",
    f"SELECT date, round(sum(CASE WHEN a <= 10 THEN g / log2(a + 1) END) / nullif(sum(CASE WHEN b <= 10 THEN g / log2(b + 1) END), 0) + 3e-8, 5) AS ndcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, code) AS a, row_number() OVER (PARTITION BY date ORDER BY g DESC, code) AS b FROM {_GAIN}) GROUP BY date",
    lambda s, d: wf.ndcg(scored(s, d).withColumn("gain", F.when(F.col("label").isNotNull(), F.greatest("label", F.lit(0.0)))), "value", "gain", 10).select("date", x.rounded("ndcg", 5).alias("ndcg"), "n"),
)

_SUMS = {"n": "1", "a": "a", "b": "b", "y": "label", "aa": "a * a", "ab": "a * b", "bb": "b * b", "ay": "a * label", "by": "b * label"}
GRAM_SQL = f"""d AS (SELECT DISTINCT date FROM {SCORED_SQL}), t AS (SELECT date, {", ".join(f"sum({v}) AS s_{k}" for k, v in _SUMS.items())} FROM {SCORED_SQL} WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL GROUP BY date),
w AS (SELECT date, {", ".join(f"sum(s_{k}) OVER (ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING) AS s_{k}" for k in _SUMS)} FROM d LEFT JOIN t USING (date)),
g AS MATERIALIZED (SELECT date, CAST(coalesce(s_n, 0) AS BIGINT) AS n, s_a / s_n AS ma, s_b / s_n AS mb, s_y / s_n AS my, s_aa / s_n - s_a / s_n * s_a / s_n AS gaa, s_ab / s_n - s_a / s_n * s_b / s_n AS gab, s_bb / s_n - s_b / s_n * s_b / s_n AS gbb, s_ay / s_n - s_a / s_n * s_y / s_n AS ca, s_by / s_n - s_b / s_n * s_y / s_n AS cb FROM w)"""


def _descent(penalty: float, mix: float, sweeps: int) -> str:
    soft = lambda v: f"(sign({v}) * greatest(abs({v}) - {penalty * mix!r}, 0.0))"
    return f"""WITH RECURSIVE {GRAM_SQL},
c(date, k, x, z) AS (SELECT date, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM g WHERE n > 0 UNION ALL
 SELECT date, k + 1, CASE WHEN k % 2 = 0 THEN CASE WHEN gaa > 0 THEN {soft("(ca - gab * z)")} / (gaa + {penalty * (1 - mix)!r}) ELSE 0 END ELSE x END, CASE WHEN k % 2 = 1 THEN CASE WHEN gbb > 0 THEN {soft("(cb - gab * x)")} / (gbb + {penalty * (1 - mix)!r}) ELSE 0 END ELSE z END FROM c JOIN g USING (date) WHERE k < {2 * sweeps})
SELECT g.date, n, round(my - ma * x - mb * z + 3e-8, 4) + 0.0 AS b0, round(x + 3e-8, 4) + 0.0 AS b1, round(z + 3e-8, 4) + 0.0 AS b2 FROM g LEFT JOIN c ON g.date = c.date AND c.k = {2 * sweeps}"""


def _path(s: SparkSession, d: str, penalty: float, mix: float, sweeps: int) -> DataFrame:
    return _coefficients(wf.elastic_net_path(scored(s, d), FACTORS, "label", penalty, mix, dates=36, sweeps=sweeps))


simple("walk_forward_lasso", _descent(0.02, 1.0, 20), lambda s, d: _path(s, d, 0.02, 1.0, 20))
simple("walk_forward_elastic_net", _descent(0.01, 0.5, 20), lambda s, d: _path(s, d, 0.01, 0.5, 20))
simple(
    "lasso_without_penalty",
    f"""WITH {GRAM_SQL} SELECT date, n, round(my - ma * x - mb * z + 3e-8, 4) + 0.0 AS b0, round(x + 3e-8, 4) + 0.0 AS b1, round(z + 3e-8, 4) + 0.0 AS b2
 FROM (SELECT *, (ca * gbb - cb * gab) / nullif(gaa * gbb - gab * gab, 0) AS x, (cb * gaa - ca * gab) / nullif(gaa * gbb - gab * gab, 0) AS z FROM g)""",
    lambda s, d: _path(s, d, 0.0, 1.0, 60),
)
