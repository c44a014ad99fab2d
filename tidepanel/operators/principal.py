"""Principal components and orthogonal factors of each date, in column expressions.

A date's covariances are sums of products, one grouped aggregation with partial sums.  Their matrix, as
large as the factors are many, goes through Jacobi rotations within one expression, and the result comes
back to the rows by the date.  No row leaves the JVM and no date is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SWEEPS = 10
_STATE = "struct<a: array<array<double>>, v: array<array<double>>>"


def _let(value: Column, of) -> Column:
    """``of`` a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, v: t + v)


def _column(rows: Column, j: int) -> Column:
    return F.transform(rows, lambda row: F.get(row, F.lit(j)))


def _rotated(rows: Column, e: Column) -> Column:
    """Columns p and q of a matrix turned by the rotation e (p, q, c, s)."""

    def turn(row: Column) -> Column:
        a, b = F.get(row, e["p"]), F.get(row, e["q"])
        return F.transform(row, lambda v, j: F.when(j == e["p"], e["c"] * a - e["s"] * b).when(j == e["q"], e["s"] * a + e["c"] * b).otherwise(v))

    return F.transform(rows, turn)


def _turned(rows: Column, e: Column) -> Column:
    """Rows p and q of a matrix turned by the rotation."""
    a, b = F.get(rows, e["p"]), F.get(rows, e["q"])
    one = F.zip_with(a, b, lambda x, y: e["c"] * x - e["s"] * y)
    two = F.zip_with(a, b, lambda x, y: e["s"] * x + e["c"] * y)
    return F.transform(rows, lambda v, j: F.when(j == e["p"], one).when(j == e["q"], two).otherwise(v))


def eigen(matrix: Column, k: int, sweeps: int = SWEEPS) -> Column:
    """Pairs (value, vector) of a symmetric k x k array, the largest value first; the largest component of a vector (of equals the first) is positive."""
    pairs = [(p, q) for p in range(k) for q in range(p + 1, k)]
    order = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(sweeps) for p, q in pairs]) if pairs else None
    unit = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(k)]) for i in range(k)])

    def step(state: Column, at: Column) -> Column:
        app, aqq, apq = (F.get(F.get(state["a"], at[i]), at[j]) for i, j in (("p", "p"), ("q", "q"), ("p", "q")))
        theta = (aqq - app) / (2 * apq)
        t = F.when(apq == 0, 0.0).otherwise(F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))
        tangent = F.struct(at["p"].alias("p"), at["q"].alias("q"), F.when(F.abs(apq) > 1e-300, t).otherwise(0.0).alias("t"))
        angle = _let(tangent, lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), (1 / F.sqrt(e["t"] * e["t"] + 1)).alias("c"), (e["t"] / F.sqrt(e["t"] * e["t"] + 1)).alias("s")))
        return _let(F.struct(angle.alias("e"), state.alias("m")), lambda x: F.struct(_turned(_rotated(x["m"]["a"], x["e"]), x["e"]).alias("a"), _rotated(x["m"]["v"], x["e"]).alias("v")))

    start = F.struct(matrix, unit).cast(_STATE)
    done = F.aggregate(order, start, step) if pairs else start

    def signed(vector: Column) -> Column:
        size = F.transform(vector, F.abs)
        lead = F.get(vector, (F.array_position(size, F.array_max(size)) - 1).cast("int"))
        return F.when(lead < 0, F.transform(vector, lambda v: -v)).otherwise(vector)

    def found(m: Column) -> Column:
        columns = [F.struct((-F.get(F.get(m["a"], F.lit(j)), F.lit(j))).alias("minus"), F.lit(j).alias("j"), _column(m["v"], j).alias("vector")) for j in range(k)]
        return F.transform(F.array_sort(F.array(*columns)), lambda e: F.struct((-e["minus"]).alias("value"), signed(e["vector"]).alias("vector")))

    return F.when(matrix.isNotNull(), _let(done, found))


def covariances(df: DataFrame, factors: list[str], by: tuple[str, ...] = ("date",)) -> DataFrame:
    """(by, n, mean, cov): of the rows that have all factors, the means and the sample covariances; cov is null for fewer than two rows."""
    k = len(factors)
    full = df.filter(" and ".join(f"`{f}` is not null" for f in factors))
    x = [F.col(f"`{f}`").cast("double") for f in factors]
    one = lambda i, j: F.covar_samp(x[min(i, j)], x[max(i, j)])
    sums = full.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), *[one(i, j).alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)])
    matrix = F.array(*[F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return sums.select(*by, "n", "mean", F.when(F.col("n") > 1, matrix).alias("cov"))


def components(df: DataFrame, factors: list[str], by: tuple[str, ...] = ("date",)) -> DataFrame:
    """(by, n, mean, pairs): eigenvalues and loadings of the covariances of each group."""
    return covariances(df, factors, by).withColumn("pairs", eigen(F.col("cov"), len(factors))).drop("cov")


def principal_components(df: DataFrame, factors: list[str], keep: int | float = 0.8, by: tuple[str, ...] = ("date",), prefix: str = "pc") -> DataFrame:
    """``df`` with pc_1, pc_2, ...: the centred factors on the loadings of their date.

    ``keep`` is how many components are kept, or the share of the variance that the kept ones exceed together, as few as
    do so; those beyond are null, as are all of a row that lacks a factor and of dates with fewer than two full rows.
    """
    k = len(factors)
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in factors])
    joined = df.join(components(df, factors, by).select(*by, F.col("mean").alias("_m"), F.col("pairs").alias("_p")), list(by), "left")
    values = F.transform("_p", lambda p: F.greatest(p["value"], F.lit(0.0)))
    joined = joined.withColumns({"_x": F.zip_with(x, "_m", lambda a, m: a - m), "_v": values})
    out = {}
    for i in range(min(k, keep) if isinstance(keep, int) else k):
        score = _total(F.zip_with("_x", F.get("_p", F.lit(i))["vector"], lambda a, b: a * b))
        if not isinstance(keep, int):
            before = _total(F.slice("_v", 1, i)) if i else F.lit(0.0)
            score = F.when((F.lit(i) == 0) | (before <= keep * _total(F.col("_v"))), score)
        out[f"{prefix}_{i + 1}"] = score
    return joined.withColumns(out).drop("_m", "_p", "_x", "_v")


def orthogonal(df: DataFrame, factors: list[str], by: tuple[str, ...] = ("date",), suffix: str = "_orth") -> DataFrame:
    """``df`` with each factor's symmetric orthogonal form: the uncorrelated factors of unit variance nearest to the centred ones.

    They are the centred factors times the inverse root of the covariances, V diag(value ** -1/2) V'; null for a row that lacks a factor and for
    dates whose covariances are singular.
    """
    k = len(factors)
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in factors])
    joined = df.join(components(df, factors, by).select(*by, F.col("mean").alias("_m"), F.col("pairs").alias("_p")), list(by), "left")
    joined = joined.withColumn("_x", F.zip_with(x, "_m", lambda a, m: a - m))
    sound = F.get("_p", F.lit(k - 1))["value"] > 1e-12 * F.get("_p", F.lit(0))["value"]
    # The components of unit variance, turned back by the loadings.
    unit = F.transform("_p", lambda p: _total(F.zip_with("_x", p["vector"], lambda a, b: a * b)) / F.sqrt(p["value"]))
    joined = joined.withColumn("_u", F.when(sound, unit))
    out = {f"{f}{suffix}": _total(F.zip_with("_u", _column(F.transform("_p", lambda p: p["vector"]), i), lambda u, v: u * v)) for i, f in enumerate(factors)}
    return joined.withColumns(out).drop("_m", "_p", "_x", "_u")
