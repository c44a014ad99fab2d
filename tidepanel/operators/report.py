"""Statistics of factors, groups and returns beyond ``evaluate``."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import student_p
from .evaluate import ic_summary, information_coefficient, information_coefficients
from .transform import quantize


def sample_skewness(x: str | Column) -> Column:
    """Skewness with the correction for small samples."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str | Column) -> Column:
    """Excess kurtosis with the correction for small samples."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def moments(x: str) -> dict[str, Column]:
    return {"mean": F.avg(x), "median": F.percentile(x, F.lit(0.5)), "std": F.stddev_samp(x), "skew": sample_skewness(x), "kurt": sample_kurtosis(x)}


def group_moments(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Mean, median, deviation, skewness and kurtosis of each group, and the mean by weight."""
    more = {"weighted": F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))} if weight else {}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in (moments(value) | more).items()])


def with_date_moments(df: DataFrame, value: str = "value") -> DataFrame:
    """Each row with the moments of its date, which are null where the value is."""
    return df.join(group_moments(df, ["date"], value), "date").withColumns({n: F.when(F.col(value).isNotNull(), F.col(n)) for n in moments(value)})


def group_shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """(date, group, total, share, growth): sum of a group, its share of the date, and its change from its date before."""
    per = df.groupBy("date", group).agg(F.sum(value).alias("total"))
    before = F.lag("total").over(Window.partitionBy(group).orderBy("date"))
    return per.withColumns({"share": F.try_divide("total", F.sum("total").over(Window.partitionBy("date"))), "growth": F.try_divide("total", before) - 1})


def slice_moments(rows: DataFrame, keys: list[str], order: list[str], value: str, edge: int) -> DataFrame:
    """Moments of the values of a group's slices: all, the first and last ``edge`` rows, those between, and those at or above its median and below."""
    w = Window.partitionBy(*keys)
    df = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w), "_m": F.percentile(value, F.lit(0.5)).over(w)})
    v, r, n = F.col(value), F.col("_r"), F.col("_n")
    slices = {"all": F.lit(True), "open": r <= edge, "intra": (r > edge) & (r <= n - edge), "close": r > n - edge, "high": v >= F.col("_m"), "low": v < F.col("_m")}
    return df.withColumns({f"_{k}": F.when(c, v) for k, c in slices.items()}).groupBy(*keys).agg(*[c.alias(f"{name}_{k}") for k in slices for name, c in (("avg", F.avg(f"_{k}")), ("std", F.stddev_samp(f"_{k}")), ("skew", sample_skewness(f"_{k}")), ("kurt", sample_kurtosis(f"_{k}")))])


def slice_features(rows: DataFrame, keys: list[str], order: list[str], by: str, edge: int, features: dict[str, tuple[str, str]]) -> DataFrame:
    """Means and sample deviations of columns over slices of a group: all rows, the first and last ``edge`` in order, those between, and those where ``by`` is at or above its median and below.

    ``features`` maps a name, which ends in avg or std, to (slice, column).  One window and one aggregation serve them all.
    """
    w = Window.partitionBy(*keys)
    df = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w), "_m": F.percentile(by, F.lit(0.5)).over(w)})
    r, n, level = F.col("_r"), F.col("_n"), F.col(by)
    inside = {"all": F.lit(True), "open": r <= edge, "intra": (r > edge) & (r <= n - edge), "close": r > n - edge, "high": level >= F.col("_m"), "low": level < F.col("_m")}
    made = [(F.stddev_samp if name.endswith("std") else F.avg)(F.when(inside[part], F.col(column))).alias(name) for name, (part, column) in features.items()]
    return df.groupBy(*keys).agg(*made)


def average_rank(column: str, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def group_correlations(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns within each group."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": average_rank(a, *keys), "_b": average_rank(b, *keys)})
    corr = lambda p, q: F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q))
    return both.groupBy(*keys).agg(corr(a, b).alias("pearson"), corr("_a", "_b").alias("spearman"), F.count("*").alias("n"))


def factor_summary(df: DataFrame, value: str = "value") -> DataFrame:
    """Of each date: least, greatest, mean, deviation, count, skewness, share of rows with a value, and share of those above zero."""
    n = F.count(value)
    return df.groupBy("date").agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), n.alias("count"), sample_skewness(value).alias("skew"), (n / F.count("*")).alias("cover_rate"), F.try_divide(F.sum((F.col(value) > 0).cast("int")), n).alias("positive_rate"))


def group_turnover(panel: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """(date, group, turnover) on a dense panel: changes of membership among codes known on both dates, over the members now; group 0 is the top less the bottom."""
    q = quantize(panel, bins, value, "_q").withColumn("_p", F.lag("_q").over(Window.partitionBy("code").orderBy("date")))
    held = lambda c, g: (F.col(c) == g).cast("int") if g else (F.col(c) == bins).cast("int") - (F.col(c) == 1).cast("int")
    one = [F.struct(F.lit(g).alias("group"), F.coalesce(F.abs(held("_q", g) - held("_p", g)), F.lit(0)).alias("moved"), F.abs(held("_q", g)).alias("held")) for g in range(bins + 1)]
    each = q.filter("_q is not null").select("date", F.inline(F.array(*one)))
    return each.groupBy("date", "group").agg(F.try_divide(F.sum("moved"), F.sum("held")).alias("turnover"))


def period_returns(returns: DataFrame, unit: str, compounded: bool = True, ret: str = "ret") -> DataFrame:
    """(period, ret) of (date, ret) over calendar units."""
    total = F.exp(F.sum(F.log1p(ret))) - 1 if compounded else F.sum(ret)
    return returns.groupBy(F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(total.alias("ret"))


def growth_metrics(value: DataFrame, periods: int = 12) -> DataFrame:
    """One row: yearly compound growth, mean and volatility, corrected skewness and kurtosis, deepest drawdown and growth over it, of (date, nav, ret)."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = value.withColumn("_d", F.col("nav") / F.max("nav").over(upto) - 1)
    years = F.datediff(F.max("date"), F.min("date")) / 365.0
    growth = F.pow(F.abs(F.max_by("nav", "date") / F.min_by("nav", "date")), 1 / years) - 1
    out = df.agg(growth.alias("cagr"), (F.avg("ret") * periods).alias("mean"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("vol"), sample_skewness("ret").alias("skew"), sample_kurtosis("ret").alias("kurt"), F.min("_d").alias("max_drawdown"))
    return out.withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown")))


def without_outliers(df: DataFrame, q: float, value: str = "ret") -> DataFrame:
    """Rows below the quantile of all values."""
    edge = df.agg(F.percentile(value, F.lit(q)).alias("_e"))
    return df.join(F.broadcast(edge), how="inner").filter(F.col(value) < F.col("_e")).drop("_e")  # one row


def quantile_errors(df: DataFrame, bins: int, value: str = "value", label: str = "label") -> DataFrame:
    """(quantile, mean_return, std_error, n): over dates, of the mean label of each bucket less the date's mean."""
    both = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    away = quantize(both, bins, value).withColumn("_l", F.col(label) - F.avg(label).over(Window.partitionBy("date")))
    dated = away.groupBy("date", "quantile").agg(F.avg("_l").alias("m"))
    return dated.groupBy("quantile").agg(F.avg("m").alias("mean_return"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("std_error"), F.count("m").alias("n"))


def cumulative(series: DataFrame, value: str, out: str) -> DataFrame:
    """A running sum over dates, of which a calendar has few."""
    return series.withColumn(out, F.sum(value).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def rank_correlations(df: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, spearman) of every pair of columns over the rows that have all; ranks come from a distributed sort."""
    spark = df.sparkSession
    rows = df.select(*[F.col(f).cast("double") for f in factors]).na.drop()
    vectors = VectorAssembler(inputCols=factors, outputCol="v").transform(rows).select("v")
    m = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
    pairs = [(a, b, float(m[i][j])) for i, a in enumerate(factors) for j, b in enumerate(factors) if i < j]
    return spark.createDataFrame(pairs, "a string, b string, spearman double")


def quantile_regression(df: DataFrame, y: str, x: str, q: float = 0.5, rounds: int = 60, ridge: float = 1e-9) -> tuple[float, float]:
    """(intercept, slope) that minimise the q-weighted absolute residuals: least squares, weighted again each round by one aggregation."""
    known = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).na.drop().persist()  # read once for all rounds
    a, b, floor = 0.0, 0.0, None
    for k in range(rounds):
        r = F.col("y") - a - b * F.col("x")
        w = F.lit(1.0) if floor is None else F.when(r >= 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(floor))
        s = known.agg(*[F.sum(w * t).alias(n) for n, t in (("n", F.lit(1.0)), ("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")))], F.avg(F.abs(r)).alias("size")).first()
        if not s.n:
            a = b = float("nan")
            break
        new_b = (s.n * s.xy - s.x * s.y) / max(s.n * s.xx - s.x * s.x, ridge)
        new_a = (s.y - new_b * s.x) / s.n
        done = floor is not None and np.hypot(new_a - a, new_b - b) < 1e-10 * (1 + np.hypot(a, b))
        a, b = new_a, new_b
        if done:
            break
        floor = max(1e-12, max(1e-6, 0.5**k) * s.size)  # smooth at first, so that the rounds settle
    known.unpersist()
    return a, b


def quantile_regression_report(df: DataFrame, y: str, x: str, q: float = 0.5, rounds: int = 60) -> DataFrame:
    """(n, intercept, slope, std_error, t, p) of the regression on the q-quantile.

    The error takes residuals as alike everywhere: their density at the quantile comes from the spread of residuals within a
    bandwidth of it (Hall and Sheather, at 5 percent), which is that of interpolated quantiles.
    """
    a, b = quantile_regression(df, y, x, q, rounds)
    known = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).na.drop()
    normal = NormalDist()
    z = normal.inv_cdf(q)
    width = normal.inv_cdf(0.975) ** (2 / 3) * (1.5 * normal.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
    sums = known.agg(F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("sxx"))
    h = F.least(F.lit(width) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3)), F.lit(min(q, 1 - q) * 0.999))
    n = sums.first().n
    share = min(width * n ** (-1 / 3), min(q, 1 - q) * 0.999) if n else 0.25
    residual = F.col("y") - a - b * F.col("x")
    edges = known.agg(F.percentile(residual, F.array(F.lit(q - share), F.lit(q + share))).alias("e"))
    found = sums.join(F.broadcast(edges), how="inner")  # a row on each side
    error = F.sqrt(F.lit(q * (1 - q)) / F.col("sxx")) * (F.col("e")[1] - F.col("e")[0]) / (2 * h)
    found = found.select("n", F.lit(a).alias("intercept"), F.lit(b).alias("slope"), error.alias("std_error"))
    found = found.withColumn("t", F.try_divide("slope", "std_error"))
    return found.withColumn("p", student_p(F.col("t"), F.col("n") - 2))


def evaluation_grid(df: DataFrame, factors: list[str], labels: list[str], universes: dict[str, DataFrame]) -> DataFrame:
    """(factor, label, universe, mean, std, ir, ability, n): the summary of rank correlations for each choice, from one reading of the panel."""
    members = None
    for name, rows in universes.items():
        one = rows.select("date", "code").distinct().withColumn("universe", F.lit(name))
        members = one if members is None else members.unionByName(one)
    inside = df.join(members, ["date", "code"])
    summary = ic_summary(information_coefficients(inside, factors, labels, ("universe",)), "factor", "label", "universe")
    return summary.select("factor", "label", "universe", "mean", "std", "ir", "ability", "n")


def single_factor_report(df: DataFrame, bins: int, value: str = "value", label: str = "label") -> dict[str, DataFrame]:
    """The tables of a factor's report by name, none of them evaluated yet."""
    ic = information_coefficient(df, value, label)
    return {"summary": factor_summary(df, value), "ic": cumulative(ic, "ic", "cumulative_ic"), "ic_summary": ic_summary(ic), "quantiles": quantile_errors(df, bins, value, label), "turnover": group_turnover(df, bins, value)}


def winners_and_losers(trades: DataFrame, n: int, profit: str = "profit") -> DataFrame:
    """(side, place, code, profit): the n codes of greatest and of least profit."""
    total = trades.groupBy("code").agg(F.sum(profit).alias("profit")).filter("profit is not null")
    tops = []
    for side, order in (("winner", F.desc("profit")), ("loser", F.asc("profit"))):
        best = total.orderBy(order, "code").limit(n)
        tops.append(best.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "code")).alias("place"), "code", "profit"))  # n rows
    return tops[0].unionByName(tops[1])
