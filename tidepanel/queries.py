"""Queries over the driver's tables by name, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import duck
from .functions import expr as x
from .plans import alphas_industry, short_horizon
from .plans.alphas import formulas
from .sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEY = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"


def bars_sql(unit: str = "month", key: str = "l_suppkey") -> str:
    return f"""SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, {key} AS code, arg_min(l_extendedprice, {KEY}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 arg_max(l_extendedprice, {KEY}) AS close, round(sum(l_quantity), 2) AS volume, round(sum(l_extendedprice), 2) AS money, count(*) AS trades, round(sum(l_extendedprice), 2) / nullif(round(sum(l_quantity), 2), 0) AS vwap
 FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2"""


DENSE_SQL = f"""SELECT s.date, s.code, open, high, low, close, volume, money, trades, vwap, n_name AS industry, n_regionkey AS sector, s_acctbal + 2000 AS cap
 FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date, code
       FROM (SELECT DISTINCT l_suppkey AS code FROM lineitem), (SELECT date_trunc('month', min(l_shipdate)) AS lo, date_trunc('month', max(l_shipdate)) AS hi FROM lineitem)) s
 LEFT JOIN ({bars_sql()}) b ON s.date = b.date AND s.code = b.code
 LEFT JOIN supplier ON s.code = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of every supplier for every month, with industry, sector and cap."""
    cap = panels.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), (F.col("s_acctbal") + 2000).alias("cap"))
    full = panels.densify(panels.bars(spark, sf_dir))
    return full.join(panels.industries(spark, sf_dir).join(cap, "code"), "code", "left")


def register(name: str, sql: str | None = None):
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


DAILY_SQL = f"""SELECT b.*, n_name AS industry, n_regionkey AS sector, s_acctbal + 2000 AS cap
 FROM ({bars_sql("day")}) b LEFT JOIN supplier ON code = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the days on which a supplier traded, with industry, sector and cap: windows count a supplier's own days."""
    cap = panels.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), (F.col("s_acctbal") + 2000).alias("cap"))
    return panels.bars(spark, sf_dir, "day", by_code=True).join(panels.industries(spark, sf_dir).join(cap, "code"), "code", "left")


def expressions(name: str, factors: dict[str, x.Expr], digits: int = 6, days: bool = False) -> None:
    """A query of expressions over the dense panel of months, or that of days."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = x.with_factors((daily if days else dense)(spark, sf_dir), factors)
        return df.select("date", "code", *[x.rounded(c, digits).alias(c) for c in factors])

    register(name, duck.sql(DAILY_SQL if days else DENSE_SQL, factors, digits=digits))(query)


c, o, h, lo, v, m = (x.col(n) for n in ("close", "open", "high", "low", "volume", "money"))
expressions("ts_lags", {"delay_1": x.delay(c, 1), "lead_2": x.lead(c, 2), "delta_1": x.delta(c, 1), "delta_3": x.delta(c, 3), "paper_delta_3": x.delta(c, 3, order=False), "returns_1": x.returns(c)})
expressions("ts_moments", {"sum_5": x.ts_sum(c, 5), "mean_5": x.ts_mean(c, 5), "full_mean_5": x.ts_mean(c, 5, 5), "std_6": x.stddev(c, 6), "var_6": x.variance(v, 6), "median_5": x.ts_median(c, 5)}, 4)
expressions("ts_extremes", {"min_5": x.ts_min(lo, 5), "max_5": x.ts_max(h, 5), "argmax_6": x.ts_argmax(c, 6), "argmin_6": x.ts_argmin(c, 6), "rank_6": x.ts_rank(c, 6)})
expressions("ts_paired", {"corr_6": x.correlation(c, v, 6), "cov_6": x.covariance(c, v, 6) / 1000.0, "slope_6": x.regression_slope(c, v, 6), "alpha_6": x.regression_intercept(c, v, 6) / 1000.0}, 2)
expressions("ts_decay_product", {"decay_5": x.decay_linear(c, 5), "log_product_4": x.ts_sum(x.log(c), 4), "up_count_6": x.ts_count(c > x.delay(c, 1), 6), "adv_6": x.adv(m, 6)}, 4)
expressions("ts_norms", {"stable_6": x.ts_mean(c, 6, 6) / x.stddev(c, 6, 6), "min_max_6": (c - x.ts_min(c, 6)) / (x.ts_max(c, 6) - x.ts_min(c, 6)), "z_6": (c - x.ts_mean(c, 6, 6)) / x.stddev(c, 6, 6), "max_abs_6": (c - x.ts_min(c, 6)) / (x.ts_max(c, 6) - x.ts_min(c, 6)) * 2.0 - 1.0})
expressions("ts_cumulative", {"filled": x.forward_fill(c), "cum_volume": x.running_sum(v), "high_water": x.running_max(h), "drawdown": c / x.running_max(h) - 1.0}, 4)
expressions("cs_rank_scale", {"rank_c": x.rank(c), "rank_v": x.rank(v), "scale_c": x.scale(c), "z": x.zscore(c), "sample_z": x.zscore(c, sample=True), "min_max": x.min_max(c)})
expressions("cs_clip_median", {"mad_3": x.mad_clip(c, 3.0), "median": x.cs_median(c), "q80": x.cs_quantile(c, 0.8), "filled_median": x.coalesce(c, x.cs_median(c)), "filled_mean": x.coalesce(c, x.cs_mean(c))}, 4)
expressions("cs_groups", {"ind_demean": x.demean(c, ("sector",)), "ind_z": x.zscore(c, ("sector",), sample=True), "ind_rank": x.rank(c, ("sector",)), "ind_fill": x.coalesce(c, x.cs_median(c, ("sector",))), "cap_mean": x.cs_sum(c * x.col("cap"), ("sector",)) / x.cs_sum(x.where(c > 0, x.col("cap"), 0.0), ("sector",))}, 2)
expressions("elementwise", {"log_v": x.log(v), "sqrt_m": x.sqrt(m), "cube": x.cube_root(c - o), "spow": x.signed_power(c - o, 0.5), "sign": x.sign(c - o), "clip": x.clip(c, 20000.0, 60000.0), "where": x.where((c > o) & (v > 50), 1.0, -1.0), "max": x.maximum(c, o), "min": x.minimum(c, o)}, 4)
for _name, _e in formulas("sector").items():
    expressions(_name, {"value": _e}, 4)
for _name, _e in alphas_industry.formulas("sector", "sector").items():
    expressions(_name, {"value": _e}, 4, days=_name in alphas_industry.LONG)
for _name, _e in short_horizon.formulas().items():
    expressions(_name, {"value": _e}, 4, days=_name in short_horizon.LONG)

_decay = {"value": x.decay_linear(x.rank(x.returns(c)), 5)}


@register(
    "alpha_decay_top3",
    f"SELECT date, code, value FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS n FROM ({duck.sql(DENSE_SQL, _decay)}) WHERE value IS NOT NULL) WHERE n <= 3",
)
def alpha_decay_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.select import top_n

    return top_n(x.factor(dense(spark, sf_dir), _decay["value"], digits=6), 3)


from . import query_panels  # noqa: E402, F401  (registers the handwritten queries)
from . import query_models  # noqa: E402, F401
from . import query_market  # noqa: E402, F401
from . import query_stats  # noqa: E402, F401
from . import query_genetic  # noqa: E402, F401
from . import query_scans  # noqa: E402, F401
from . import query_walk  # noqa: E402, F401
from . import query_optimise  # noqa: E402, F401
from . import query_tests  # noqa: E402, F401
from . import query_cycles  # noqa: E402, F401
