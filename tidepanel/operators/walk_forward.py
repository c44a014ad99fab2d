"""Classifiers and penalised regressions fitted forward in time, for all dates of fitting at once.

A fit at a date uses rows of dates ``embargo`` or more before it, as a label is known only then, and is used from its date
up to the next fit.  Dates are numbered in order; their number is bounded by the calendar, as is that of the fits.

Logistic fits are Newton steps: a step scans the rows once, adds up gradient and curvature for each fit
by one grouped aggregation, and brings a few sums a fit to the driver, which solves them.  Penalised
regressions need sums of products only, which are taken for each date once and added up over dates; coordinate descent runs on
those sums as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """When to fit: at every ``every``-th date from the ``first`` on (from 0), on the last ``dates`` known dates or on all."""

    every: int = 12
    first: int = 12
    embargo: int = 1
    dates: int | None = None

    def fits(self, n: int) -> list[tuple[int, int, int]]:
        """(number of the date, first and last date that it learns from) of each fit among ``n`` dates."""
        at = range(self.first, n, self.every)
        return [(t, 0 if self.dates is None else max(0, t - self.embargo - self.dates + 1), t - self.embargo) for t in at if t >= self.embargo]


def calendar(df: DataFrame) -> list:
    """The dates in order; as many as the calendar has."""
    return [r.date for r in df.select("date").filter("date is not null").distinct().orderBy("date").collect()]


def _used(df: DataFrame, dates: list, policy: Policy) -> DataFrame:
    """``df`` with ``_fits``, the numbers of the fits that a row's date teaches."""
    fits = policy.fits(len(dates))
    rows = [(d, [k for k, (_, lo, hi) in enumerate(fits) if lo <= i <= hi]) for i, d in enumerate(dates)]
    lookup = df.sparkSession.createDataFrame([r for r in rows if r[1]], f"date {df.schema['date'].dataType.simpleString()}, _fits array<int>")
    return df.join(F.broadcast(lookup), "date")  # one row a date


def _dot(beta: Column, x: list[Column]) -> Column:
    total = F.get(beta, F.lit(0)) * x[0]
    for i, c in enumerate(x[1:], 1):
        total = total + F.get(beta, F.lit(i)) * c
    return total


def _probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic_fits(df: DataFrame, factors: list[str], label: str, policy: Policy, steps: int = 6, ridge: float = 0.0, weight: str | None = None) -> DataFrame:
    """(date, until, n, beta): intercept and slopes of the logistic regression of the label (0 or 1), after ``steps`` Newton steps from 0.

    ``ridge`` is half the penalty on the squares of the slopes, ``weight`` a column of sample weights.  Rows with a null in factors, label
    or weight teach nothing.  ``beta`` is null where a fit has fewer rows than coefficients or its curvature is singular; ``until`` is the
    last date on which the fit is used.
    """
    spark, k = df.sparkSession, len(factors) + 1
    dates = calendar(df)
    fits = policy.fits(len(dates))
    kind = df.schema["date"].dataType.simpleString()
    schema = f"date {kind}, until {kind}, n long, beta array<double>"
    if not fits:
        return spark.createDataFrame([], schema)
    needed = [*factors, label, *([weight] if weight else [])]
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in factors]]
    s = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = _used(df.select("date", *dict.fromkeys(needed)).filter(" and ".join(f"`{c}` is not null" for c in needed)), dates, policy)
    rows = rows.select("_fits", F.col(label).cast("double").alias("_y"), s.alias("_s"), *[c.alias(f"_x{i}") for i, c in enumerate(x)]).select("*", F.explode("_fits").alias("_fit")).drop("_fits").persist()  # read once for all steps
    x = [F.col(f"_x{i}") for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    beta, counts = np.zeros((len(fits), k)), np.zeros(len(fits), np.int64)
    alive = np.ones(len(fits), bool)
    for _ in range(steps):
        # The coefficients travel as a constant: a few numbers a fit.
        b = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in beta]), F.col("_fit") + 1)
        p = _probability(_dot(b, x))
        curve = F.col("_s") * F.col("_p") * (1 - F.col("_p"))
        slope = F.col("_s") * (F.col("_y") - F.col("_p"))
        sums = rows.withColumn("_p", p).groupBy("_fit").agg(F.count("*").alias("n"), F.array(*[F.sum(slope * c) for c in x]).alias("g"), F.array(*[F.sum(curve * x[i] * x[j]) for i, j in upper]).alias("h"))
        seen = np.zeros(len(fits), bool)
        for fit, n, g, h in sums.collect():  # one row a fit
            seen[fit], counts[fit] = True, n
            hessian = np.zeros((k, k))
            for (i, j), v in zip(upper, h, strict=True):
                hessian[i, j] = hessian[j, i] = v
            penalty = 2 * ridge * np.diag([0.0] + [1.0] * (k - 1))
            hessian, gradient = hessian + penalty, np.array(g) - penalty @ beta[fit]
            if n < k or not np.isfinite(hessian).all() or np.linalg.matrix_rank(hessian) < k:
                alive[fit] = False
            else:
                beta[fit] += np.linalg.solve(hessian, gradient)
        alive &= seen
        beta[~alive] = 0.0
    rows.unpersist()
    until = [fits[i + 1][0] - 1 if i + 1 < len(fits) else len(dates) - 1 for i in range(len(fits))]
    out = [(dates[t], dates[u], int(n), row.tolist() if ok else None) for (t, _, _), u, n, row, ok in zip(fits, until, counts, beta, alive, strict=True)]
    return spark.createDataFrame(out, schema)


def in_force(df: DataFrame, fits: DataFrame) -> DataFrame:
    """``df`` with ``beta`` of the fit that is used at the row's date; rows before the first fit go."""
    dates = calendar(df)
    kind = df.schema["date"].dataType.simpleString()
    rows = [(d, r.beta) for r in fits.collect() for d in dates if r.date <= d <= r.until]  # one row a date
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"date {kind}, beta array<double>")), "date")


def logistic_scores(df: DataFrame, factors: list[str], fits: DataFrame, out: str = "probability") -> DataFrame:
    """``df`` with the probability of label 1 by the fit used at the row's date; null where a factor or the fit is."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in factors]]
    return in_force(df, fits).withColumn(out, _probability(_dot(F.col("beta"), x))).drop("beta")


def votes(df: DataFrame, scores: list[str], out: str = "vote", threshold: float = 0.5) -> DataFrame:
    """``df`` with the share of the scores that are known which exceed the threshold; null where none is known."""
    known = sum((F.col(s).isNotNull().cast("double") for s in scores), F.lit(0.0))
    yes = sum((F.when(F.col(s) > threshold, 1.0).otherwise(0.0) for s in scores), F.lit(0.0))
    return df.withColumn(out, F.try_divide(yes, known))


def ndcg(df: DataFrame, score: str, gain: str, top: int | None = None) -> DataFrame:
    """(date, ndcg, n): discounted gain of each date in the order of the score over that in the order of the gain, of the first ``top`` places.

    Rows with a null in either are left out; ties of the score go to the lesser code; null where the best is 0.
    """
    both = df.filter(F.col(score).isNotNull() & F.col(gain).isNotNull()).select("date", "code", F.col(score).alias("_s"), F.col(gain).cast("double").alias("_g"))
    place = lambda *order: F.row_number().over(Window.partitionBy("date").orderBy(*order))
    placed = both.withColumns({"_a": place(F.desc("_s"), "code"), "_b": place(F.desc("_g"), "code")})
    discounted = lambda p: F.sum(F.when(F.col(p) <= (top or (1 << 30)), F.col("_g") / F.log2(F.col(p) + 1.0)))
    return placed.groupBy("date").agg(F.try_divide(discounted("_a"), discounted("_b")).alias("ndcg"), F.count("*").alias("n"))


def elastic_net_path(df: DataFrame, factors: list[str], label: str, penalty: float, mix: float = 1.0, embargo: int = 1, dates: int | None = None, sweeps: int = 60) -> DataFrame:
    """(date, n, beta): at every date the intercept and slopes that minimise half the mean square error plus penalty * (mix * |b| + (1 - mix) / 2 * b^2) on the rows known then.

    Sums of products of each date are added up over dates by a window of one row a date; each date's Gram matrix then goes through
    ``sweeps`` rounds of coordinate descent from 0, within one expression.  A mix of 1 is the lasso; a penalty of 0 least squares.  A factor
    without spread has slope 0; ``beta`` is null where no row is known.
    """
    k = len(factors)
    x, y = [F.col(f).cast("double") for f in factors], F.col(label).cast("double")
    full = df.filter(" and ".join(f"`{c}` is not null" for c in [*factors, label]))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    products = [*x, *[x[i] * x[j] for i, j in upper], *[c * y for c in x], y]
    sums = full.groupBy("date").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(products)])
    every = df.select("date").filter("date is not null").distinct().join(sums, "date", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding if dates is None else -(embargo + dates - 1), -embargo)  # one row a date
    added = every.select("date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), *[F.sum(f"s{i}").over(w).alias(f"s{i}") for i in range(len(products))])
    mean = lambda i: F.try_divide(F.col(f"s{i}"), F.col("n"))
    place = {pair: k + m for m, pair in enumerate(upper)}
    last = len(products) - 1
    gram = [[mean(place[min(i, j), max(i, j)]) - mean(i) * mean(j) for j in range(k)] for i in range(k)]
    target = [mean(k + len(upper) + i) - mean(i) * mean(last) for i in range(k)]
    ready = added.select("date", "n", F.array(*[mean(i) for i in range(k)]).alias("_m"), mean(last).alias("_y"), F.array(*[F.array(*row) for row in gram]).alias("_g"), F.array(*target).alias("_c"))

    def update(beta: Column, step: Column) -> Column:
        i = step % k
        row, old = F.get("_g", i), F.get(beta, i)
        others = F.aggregate(F.zip_with(row, beta, lambda g, b: g * b), F.lit(0.0), lambda t, v: t + v)
        left = F.get("_c", i) - others + F.get(row, i) * old
        shrunk = F.signum(left) * F.greatest(F.abs(left) - penalty * mix, F.lit(0.0))
        new = F.when(F.get(row, i) > 0, shrunk / (F.get(row, i) + penalty * (1 - mix))).otherwise(0.0)
        return F.transform(beta, lambda b, j: F.when(j == i, new).otherwise(b))

    slopes = F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * k - 1)), F.array(*[F.lit(0.0)] * k), update)
    fitted = ready.withColumn("_b", F.when(F.col("n") > 0, slopes))
    start = F.col("_y") - F.aggregate(F.zip_with("_m", "_b", lambda m, b: m * b), F.lit(0.0), lambda t, v: t + v)
    return fitted.select("date", "n", F.when(F.col("n") > 0, F.concat(F.array(start), F.col("_b"))).alias("beta"))
