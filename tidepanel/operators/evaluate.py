"""Labels, factor evaluation and portfolio value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.statistics import student_p
from .select import long_short_weight
from .transform import quantize


def forward_returns(panel: DataFrame, windows: tuple[int, ...], price: str = "close", digits: int = 4) -> DataFrame:
    """(date, code, forward_n, end_n): return from this row's price to that n rows ahead, and the date it is known."""
    p, d = x.col(price), x.col("date")
    f = {f"forward_{n}": x.lead(p, n) / p - 1.0 for n in windows} | {f"end_{n}": x.lead(d, n) for n in windows}
    df = x.with_factors(panel, f).select("date", "code", *f)
    return df.withColumns({f"forward_{n}": F.round(f"forward_{n}", digits) for n in windows})


def information_coefficient(df: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """(date, ic): Spearman correlation of value and label over the codes that have both."""
    both = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    ranked = x.with_factors(both, {"_a": x.average_rank(x.col(value)), "_b": x.average_rank(x.col(label))})
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return ranked.groupBy("date").agg(F.try_divide(F.covar_pop("_a", "_b"), spread).alias("ic"))


def information_coefficients(df: DataFrame, factors: list[str], labels: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(date, by, factor, label, ic): the Spearman correlation for each pair of a factor and a label, and each value of ``by``.

    Rows are melted once, so the source is read once and all pairs share one exchange, whatever their number.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(k).alias("label"), F.col(f"`{f}`").cast("double").alias("_x"), F.col(f"`{k}`").cast("double").alias("_y")) for f in factors for k in labels]))
    melted = df.select("date", *by, pairs.alias("_p")).select("date", *by, "_p.*").filter("_x is not null and _y is not null")
    group = (*by, "factor", "label")
    ranked = x.with_factors(melted, {"_a": x.average_rank(x.col("_x"), group), "_b": x.average_rank(x.col("_y"), group)})
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return ranked.groupBy("date", *group).agg(F.try_divide(F.covar_pop("_a", "_b"), spread).alias("ic"))


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return ic.groupBy(*by).agg(mean.alias("mean"), std.alias("std"), F.try_divide(mean, std).alias("ir"), F.avg((F.abs("ic") >= 0.02).cast("double")).alias("ability"), F.count("ic").alias("n"))


def quantile_returns(df: DataFrame, bins: int, value: str = "value", label: str = "label") -> DataFrame:
    """(date, quantile, mean_return, n): mean label of each bucket of the value."""
    q = quantize(df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()), bins, value)
    return q.groupBy("date", "quantile").agg(F.avg(label).alias("mean_return"), F.count("*").alias("n"))


def portfolio_value(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, ret, nav, drawdown) of weights held over the return of the same row's label; dates without a position return nothing.

    The running product is over dates only, whose number a calendar bounds.
    """
    daily = weights.join(returns, ["date", "code"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w)))
    return nav.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def metrics(value: DataFrame, periods: int = 12) -> DataFrame:
    """Return, risk and their ratios of (date, ret, nav, drawdown)."""
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    mean, std = F.avg("ret"), F.stddev_samp("ret")
    return value.agg(mean.alias("mean"), std.alias("std"), (F.try_divide(mean, std) * F.sqrt(F.lit(periods))).alias("sharpe"), (F.try_divide(mean, down) * F.sqrt(F.lit(periods))).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def ic_weights(df: DataFrame, factors: list[str], label: str) -> DataFrame:
    """(factor, ic, weight): pooled Spearman IC of each factor over the sum of absolute ICs."""
    every = information_coefficients(df, factors, [label]).groupBy("factor").agg(F.avg("ic").alias("ic"))
    total = every.agg(F.sum(F.abs("ic")).alias("t"))
    return every.join(F.broadcast(total), how="inner").select("factor", "ic", F.try_divide("ic", "t").alias("weight"))  # one row


def information_analysis(ic: DataFrame) -> DataFrame:
    """Mean, deviation, ratio, t statistic and its two-sided p value, skew and excess kurtosis of a series of coefficients."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    found = ic.agg(mean.alias("mean"), std.alias("std"), F.try_divide(mean, std).alias("ir"), (F.try_divide(mean, std) * F.sqrt(n)).alias("t"), F.skewness("ic").alias("skew"), F.kurtosis("ic").alias("kurt"), n.alias("n"))
    return found.withColumn("p", student_p(F.col("t"), F.col("n") - 1))


def factor_returns(df: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """(date, ret) of demeaned weights over the label."""
    weighted = long_short_weight(df.filter(F.col(value).isNotNull()), value)
    return weighted.groupBy("date").agg(F.sum(F.col("weight") * F.col(label)).alias("ret"))


def quantile_spread(by_quantile: DataFrame, bins: int) -> DataFrame:
    """(date, spread): mean return of the top bucket less that of the bottom one."""
    of = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_return")))
    return by_quantile.groupBy("date").agg((of(bins) - of(1)).alias("spread"))


def factor_correlations(df: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, pearson) of every pair of the named columns, pooled over rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("pearson")) for i, (a, b) in enumerate(pairs)])))


def drawdown_episodes(value: DataFrame) -> DataFrame:
    """(start, valley, end, rows, depth) of each stretch below the high water mark of (date, nav); dates are bounded by a calendar."""
    w = Window.orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    below = value.withColumn("dd", F.col("nav") / F.max("nav").over(upto) - 1)
    marked = below.withColumn("_e", F.sum(F.when(F.col("dd") < 0, 0).otherwise(1)).over(upto)).filter("dd < 0")
    return marked.groupBy("_e").agg(F.min("date").alias("start"), F.min_by("date", F.struct("dd", "date")).alias("valley"), F.max("date").alias("end"), F.count("*").alias("rows"), F.min("dd").alias("depth")).drop("_e")


def trade_stats(value: DataFrame) -> DataFrame:
    """Win rate, mean win and loss, payoff ratio, Kelly share and normal value at risk of (date, ret)."""
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    rate, payoff = F.avg((F.col("ret") > 0).cast("double")), F.try_divide(win, F.abs(loss))
    return value.agg(rate.alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), payoff.alias("payoff"), (rate - F.try_divide(1 - rate, payoff)).alias("kelly"), (F.avg("ret") - F.stddev_samp("ret") * 1.6448536269514722).alias("value_at_risk"))


def newey_west(series: DataFrame, column: str, lags: int) -> DataFrame:
    """(mean, se, t) of a dated series, its variance with Bartlett weights on ``lags`` autocovariances."""
    w = Window.orderBy("date")
    centred = series.filter(F.col(column).isNotNull()).select("date", F.col(column).alias("x"))
    centred = centred.withColumn("m", F.avg("x").over(Window.partitionBy(F.lit(1)))).withColumn("e", F.col("x") - F.col("m"))
    centred = centred.withColumns({f"p{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, lags + 1)})
    n = F.count("*")
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        total = total + F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1)))
    return centred.agg(F.avg("x").alias("mean"), (F.sqrt(F.greatest(total, F.lit(0.0))) / n).alias("se")).withColumn("t", F.try_divide("mean", "se"))


def triple_barrier(panel: DataFrame, up: float, down: float, rows: int, price: str = "close") -> DataFrame:
    """(date, code, label): 2 if the price first rises by ``up`` within so many rows, 0 if it first falls by ``down``, else 1; null where the window is not full."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(1, rows)
    moves = F.transform("_ahead", lambda p: F.try_divide(p, F.col(price)) - 1)
    df = panel.withColumn("_ahead", F.collect_list(price).over(w)).withColumn("_first", F.get(F.filter(moves, lambda q: (q >= up) | (q <= -down)), F.lit(0)))
    hit = F.col("_first")
    label = F.when(F.size("_ahead") < rows, F.lit(None).cast("int")).when(hit >= up, 2).when(hit <= -down, 0).otherwise(1)
    return df.filter(F.col(price).isNotNull()).select("date", "code", label.alias("label"))


def sorted_portfolios(df: DataFrame, first: str, second: str, bins: tuple[int, int], label: str = "label", weight: str | None = None) -> DataFrame:
    """(date, a, b, ret, n): return of each cell of two independent sorts, weighted by a column or equally."""
    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(label).isNotNull())
    cells = quantize(quantize(both, bins[0], first, "a"), bins[1], second, "b")
    w = F.col(weight) if weight else F.lit(1.0)
    return cells.groupBy("date", "a", "b").agg(F.try_divide(F.sum(F.col(label) * w), F.sum(w)).alias("ret"), F.count("*").alias("n"))


def size_value_spreads(cells: DataFrame, bins: tuple[int, int]) -> DataFrame:
    """(date, smb, hml): small less big and high less low, each over the mean of the other sort's cells."""
    of = lambda k, q: F.avg(F.when(F.col(k) == q, F.col("ret")))
    return cells.groupBy("date").agg((of("a", 1) - of("a", bins[0])).alias("smb"), (of("b", bins[1]) - of("b", 1)).alias("hml"))


def forward_path(panel: DataFrame, rows: int, price: str = "close") -> DataFrame:
    """(date, code, ret, drawdown, calmar) of the path from this price over the next ``rows`` known ones; null where they are not all there."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(0, rows)
    known = panel.filter(F.col(price).isNotNull()).withColumn("_p", F.collect_list(F.col(price).cast("double")).over(w))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def fold(t, p):
        peak = F.greatest(t["peak"], p)
        return F.struct(peak.alias("peak"), F.least(t["dd"], F.coalesce(F.try_divide(p, peak) - 1, F.lit(0.0))).alias("dd"))

    full = F.size("_p") == rows + 1
    df = known.withColumn("ret", F.when(full, F.try_divide(F.element_at("_p", -1), F.element_at("_p", 1)) - 1))
    df = df.withColumn("drawdown", F.when(full, F.aggregate("_p", start, fold, lambda t: t["dd"])))
    return df.select("date", "code", "ret", "drawdown", F.try_divide("ret", F.abs("drawdown")).alias("calmar"))


def trade_rounds(trades: DataFrame) -> DataFrame:
    """(code, round, start, end, trades, bought, sold, position, profit) of trades (code, ts, key, shares, price), shares negative for sales.

    A round begins with the first trade from no position and ends when the position is back at zero; only then it has a profit.
    """
    order = Window.partitionBy("code").orderBy("ts", "key")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumn("_after", F.sum("shares").over(upto)).withColumn("_before", F.coalesce(F.lag("_after").over(order), F.lit(0)))
    df = df.withColumn("round", F.sum((F.col("_before") == 0).cast("long")).over(upto))
    paid = F.col("shares") * F.col("price")
    rounds = df.groupBy("code", "round").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count("*").alias("trades"),
        F.sum(F.when(paid > 0, paid).otherwise(0.0)).alias("bought"),
        F.sum(F.when(paid < 0, -paid).otherwise(0.0)).alias("sold"),
        F.sum("shares").alias("position"),
    )
    return rounds.withColumn("profit", F.when(F.col("position") == 0, F.col("sold") - F.col("bought")))


def held_portfolios(df: DataFrame, sort: str, bins: int, unit: str, label: str = "label", weight: str | None = None) -> DataFrame:
    """(date, bucket, ret, n): a code's bucket is that of the first date of its period, and holds till the period ends."""
    period = F.to_date(F.date_trunc(unit, "date"))
    df = df.withColumn("_p", period)
    first = df.groupBy("_p").agg(F.min("date").alias("date"))
    start = df.join(first, ["_p", "date"], "left_semi").filter(F.col(sort).isNotNull())
    buckets = quantize(start, bins, sort, "bucket").select("_p", "code", "bucket")
    held = df.filter(F.col(label).isNotNull()).join(buckets, ["_p", "code"])
    w = F.col(weight) if weight else F.lit(1.0)
    return held.groupBy("date", "bucket").agg(F.try_divide(F.sum(F.col(label) * w), F.sum(w)).alias("ret"), F.count("*").alias("n"))
