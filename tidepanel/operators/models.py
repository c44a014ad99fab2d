"""Scores from several factors, and regressions fitted forward in time.

A regression needs its sums of products only.  They are taken for each date by one
grouped aggregation and added up over dates by a window, so every date's fit sees
exactly the dates before it and no row is read twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.statistics import student_p
from .evaluate import information_coefficients


def rank_score(df: DataFrame, factors: list[str], out: str = "score") -> DataFrame:
    """Mean over the factors of the average rank by the count of the date; null where any factor is."""
    ranks = {f"_r{i}": x.average_rank(x.col(f)) / x.cs_count(x.col(f)) for i, f in enumerate(factors)}
    ranked = x.with_factors(df, ranks)
    return ranked.withColumn(out, sum((F.col(r) for r in ranks), F.lit(0.0)) / len(factors)).drop(*ranks)


def forward_ic_weights(df: DataFrame, factors: list[str], label: str, embargo: int = 1) -> DataFrame:
    """(date, factor, weight): mean IC of a factor over the dates up to ``embargo`` before, by the sum of absolutes over the factors."""
    every = information_coefficients(df, factors, [label]).select("date", "factor", "ic")
    before = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, -embargo)
    known = every.withColumn("mean", F.avg("ic").over(before)).filter("mean is not null")
    return known.select("date", "factor", F.try_divide("mean", F.sum(F.abs("mean")).over(Window.partitionBy("date"))).alias("weight"))


def ic_weighted_score(df: DataFrame, factors: list[str], label: str, embargo: int = 1, out: str = "score") -> DataFrame:
    """Sum of the factors, each scaled by its date, with the weights known at the date."""
    weights = forward_ic_weights(df, factors, label, embargo).groupBy("date").pivot("factor", factors).agg(F.first("weight"))
    weights = weights.select("date", *[F.col(f).alias(f"_w{i}") for i, f in enumerate(factors)])
    scaled = x.with_factors(df, {f"_z{i}": x.zscore(x.col(f)) for i, f in enumerate(factors)}).join(weights, "date")
    total = sum((F.col(f"_w{i}") * F.col(f"_z{i}") for i in range(len(factors))), F.lit(0.0))
    return scaled.withColumn(out, total).drop(*[f"_{k}{i}" for k in "wz" for i in range(len(factors))])


def walk_forward_fit(df: DataFrame, factors: list[str], label: str, embargo: int = 1, dates: int | None = None, ridge: float = 0.0) -> DataFrame:
    """(date, n, beta): intercept and slopes of the least-squares fit on the rows of the dates up to ``embargo`` before, of the last ``dates`` or of all.

    ``embargo`` is how many dates ahead a label looks: it is known only then.  Null where there are too few rows or the products are singular.
    """
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in factors]]
    k, y = len(columns), F.col(label).cast("double")
    full = df.filter(" and ".join(f"`{c}` is not null" for c in [*factors, label]))
    products = [columns[i] * columns[j] for i in range(k) for j in range(i, k)] + [c * y for c in columns]
    sums = full.groupBy("date").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(products)])
    calendar = df.select("date").distinct().join(sums, "date", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding if dates is None else -(embargo + dates - 1), -embargo)  # one row a date
    added = calendar.select("date", F.sum("n").over(w).alias("n"), F.array(*[F.sum(f"s{i}").over(w) for i in range(len(products))]).alias("s"))

    def solve(batches):
        upper = np.triu_indices(k)
        for pdf in batches:
            found = []
            for n, s in zip(pdf["n"], pdf["s"], strict=True):
                a = np.zeros((k, k))
                if n is None or not n > k:
                    found.append(None)
                    continue
                a[upper] = s[: len(upper[0])]
                a = a + np.triu(a, 1).T + ridge * np.diag([0.0] + [1.0] * (k - 1))
                found.append(np.linalg.solve(a, s[len(upper[0]) :]).tolist() if np.linalg.matrix_rank(a) == k else None)
            yield pd.DataFrame({"date": pdf["date"], "n": pdf["n"].fillna(0).astype("int64"), "beta": found})

    kind = df.schema["date"].dataType.simpleString()
    return added.mapInPandas(solve, f"date {kind}, n long, beta array<double>")


def walk_forward_predict(df: DataFrame, factors: list[str], label: str, out: str = "prediction", **fit) -> DataFrame:
    """The rows with the prediction of the fit known at their date."""
    fitted = df.join(walk_forward_fit(df, factors, label, **fit), "date")
    value = F.get("beta", F.lit(0))
    for i, f in enumerate(factors):
        value = value + F.get("beta", F.lit(i + 1)) * F.col(f)
    return fitted.withColumn(out, value).drop("beta", "n")


def regression_report(df: DataFrame, value: str, label: str) -> DataFrame:
    """(n, slope, intercept, r2, t, p) of the pooled regression of the label on the value."""
    n, r2 = F.regr_count(label, value), F.regr_r2(label, value)
    slope = F.regr_slope(label, value)
    t = F.signum(slope) * F.sqrt(F.try_divide(r2 * (n - 2), 1 - r2))
    found = df.agg(n.alias("n"), slope.alias("slope"), F.regr_intercept(label, value).alias("intercept"), r2.alias("r2"), t.alias("t"))
    return found.withColumn("p", student_p(F.col("t"), F.col("n") - 2))
