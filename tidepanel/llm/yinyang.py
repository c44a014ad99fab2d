"""Centroid clustering with Yinyang filtering, in whole numbers.

A component x becomes floor(``SCALE`` * x), so distances and means are exact and a run is the same
however rows are dealt.  The first centroids are the vectors of least hash of their id.  A round
assigns every vector to its nearest centroid (ties: the smaller number) and replaces each centroid
that has vectors by the floored mean of its vectors.

The centroids are put into groups once, by their first places.  A vector carries an upper bound of
the distance to its centroid and, for each group, one lower bound of the distance to the group's
other centroids.  When centroids move, the bounds move by as much.  A vector whose upper bound is
below all lower bounds stays (the global filter), first by the bound, then by the exact distance; else
only the groups whose lower bound is not above it are scanned, exactly.  Bounds are doubles and
decide only by a margin above their rounding.

A round is one pass over the table of vectors and bounds, written to the shared folder, and one
aggregation of those vectors alone that changed their centroid: each task adds its own up, sums are
kept by differences, and some k times k rows of sums come to the driver.  A table is deleted once its successor is written.
Rounds end early when no vector moves, as nothing would change after that.

Defined cases: a vector counts if it has exactly ``dims`` components, none null or not finite; others
give no row.  A component outside plus or minus 2**27 after scaling counts as that bound, so that a
squared distance fits a long.  Repeated rows are vectors of their own; among equal hashes the lesser
vector comes first, ids that are null come last.  With fewer vectors than k there are as many
centroids as vectors.  An empty table gives no rows; other columns are ignored.  The sum
of distances is a long; beyond one, the job ends with an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, shared_path, written

SCALE = 1024
LARGEST = 1 << 27
MARGIN_ABSOLUTE, MARGIN_RELATIVE = 1e-4, 1e-9
GROUP_SIZE = 3
_FAR = np.iinfo(np.int64).max
STATE = "vec_id long, v array<int>, was int, cluster int, upper double, lower array<double>"


@dataclass
class Clusters:
    """Rows (vec_id, v, cluster, distance) and the final centroids, by number."""

    rows: DataFrame
    centroids: list[list[int]]


def whole_vectors(vectors: DataFrame, column: str = "embedding", dims: int = 64) -> DataFrame:
    """(vec_id, v) of the vectors that count, in whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    scaled = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("e")).filter((F.size("e") == dims) & F.forall("e", finite))
    return good.select("vec_id", F.transform("e", scaled).alias("v"))


def grouped(centroids: np.ndarray, size: int = GROUP_SIZE, steps: int = 5) -> np.ndarray:
    """The group of each centroid: a few steps of clustering of the centroids themselves, about ``size`` a group."""
    n = max(1, -(-len(centroids) // size))
    at = centroids[np.linspace(0, len(centroids) - 1, n).astype(int)].astype(float) if len(centroids) else np.zeros((1, 0))
    group = np.zeros(len(centroids), int)
    for _ in range(steps if n > 1 else 0):
        group = ((centroids[:, None, :] - at[None]) ** 2).sum(2).argmin(1)
        at = np.array([centroids[group == g].mean(0) if (group == g).any() else at[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


def _squares(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    diff = v - centroid
    return np.einsum("ij,ij->i", diff, diff)


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray):
    """(cluster, upper, lower, number of distances) of vectors after centroids moved by ``drift``; an ``own`` of -1 is a vector that has none yet."""
    n, groups = len(v), lower.shape[1]
    own, fresh = own.copy(), own < 0
    upper = np.where(fresh, np.inf, upper + drift[own])
    for g in range(groups):
        lower[:, g] -= drift[group == g].max(initial=0)
    lower[fresh] = -np.inf
    above = lambda u: u * (1 + MARGIN_RELATIVE) + MARGIN_ABSOLUTE
    check = np.flatnonzero(above(upper) >= lower.min(1))  # the global filter
    d_own = np.full(n, _FAR)
    for c in range(len(centroids)):
        rows = check[own[check] == c]
        d_own[rows] = _squares(v[rows], centroids[c])
        upper[rows] = np.sqrt(d_own[rows].astype(float))
    computed = int((own[check] >= 0).sum())
    left = check[above(upper[check]) >= lower[check].min(1)]
    found = np.full((len(left), len(centroids)), _FAR)
    has = own[left] >= 0
    found[np.flatnonzero(has), own[left][has]] = d_own[left][has]
    scan = lower[left] <= above(upper[left])[:, None]  # the filter by group
    for c in range(len(centroids)):
        rows = np.flatnonzero(scan[:, group[c]] & (own[left] != c))
        found[rows, c] = _squares(v[left[rows]], centroids[c])
        computed += len(rows)
    best = found.argmin(1) if len(left) else np.zeros(0, int)  # the first of equals
    nearest = found[np.arange(len(left)), best]
    found[np.arange(len(left)), best] = _FAR
    for g in range(groups):
        others = found[:, group == g].min(1, initial=_FAR)
        # In a group that is not scanned only the centroid left behind can be nearer than the bound.
        root = np.where(others == _FAR, np.inf, np.sqrt(others.astype(float)))
        lower[left, g] = np.where(scan[:, g], root, np.minimum(lower[left, g], root))
    own[left], upper[left] = best, np.sqrt(nearest.astype(float))
    return own, upper, lower, computed


def _pass(centroids: np.ndarray, drift: np.ndarray, group: np.ndarray):
    groups = int(group.max(initial=0)) + 1

    def run(batches):
        for batch in batches:
            n, dims = batch.num_rows, centroids.shape[1]
            if not n:
                continue
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            v = named["v"].flatten().to_numpy().astype(np.int64).reshape(n, dims)
            if "cluster" in named:
                was = named["cluster"].to_numpy().astype(int)
                upper, lower = named["upper"].to_numpy(), named["lower"].flatten().to_numpy().reshape(n, groups).copy()
            else:
                was, upper, lower = np.full(n, -1), np.zeros(n), np.zeros((n, groups))
            own, upper, lower, _ = assign(v, was, upper, lower, centroids, drift, group)
            lower = np.where(np.isfinite(lower), lower, 1e300)  # a group of one centroid that is its own has no others
            columns = [named["vec_id"], named["v"], pa.array(was, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * groups, pa.int32()), pa.array(lower.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "was", "cluster", "upper", "lower"])

    return run


def _sums(k: int, dims: int):
    """Of the vectors that a task holds, the sums for each pair of centroid left and centroid found."""

    def run(batches):
        n, total = np.zeros(k * (k + 1), np.int64), np.zeros((k * (k + 1), dims), np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, dims)
            pair = (batch.column("was").to_numpy() + 1) * k + batch.column("cluster").to_numpy()
            n += np.bincount(pair, minlength=len(n))
            for p in np.unique(pair):
                total[p] += v[pair == p].sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at // k - 1, pa.int32()), pa.array(at % k, pa.int32()), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["was", "cluster", "n", "s"])

    return run


def moved_sums(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, int, list[int]]]:
    """(centroid left, centroid found, vectors, their sum) of the vectors that changed their centroid; at most k * (k + 1) rows."""
    parts = state.filter("was <> cluster").select("was", "cluster", "v").mapInArrow(_sums(k, dims), "was int, cluster int, n long, s array<long>")
    each = parts.select("was", "cluster", "n", F.posexplode("s").alias("p", "x")).groupBy("was", "cluster", "p")
    # In decimals, as a sum over all tasks may pass a long.
    sums = each.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).groupBy("was", "cluster")
    rows = sums.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "s"))).alias("s")).collect()
    return [(r.was, r.cluster, r.n, [int(x.s) for x in r.s]) for r in rows]


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, column: str = "embedding", dims: int = 64, group_size: int = GROUP_SIZE) -> Clusters:
    """Clusters of ``vectors`` (vec_id, ``column``) after ``rounds`` rounds and one more assignment."""
    path = shared_path(spark, "vectors")
    state = written(spark, whole_vectors(vectors, column, dims), "vectors", path)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v"]
    first = [r.v for r in state.orderBy(*order).limit(k).collect()]
    centroids = np.array(first, np.int64).reshape(len(first), dims)
    group, drift = grouped(centroids, group_size), np.zeros(len(first))
    sums, counts = [[0] * dims for _ in first], [0] * len(first)
    if not first:
        return Clusters(spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long"), [])
    for at in range(rounds + 1):
        before, path = path, shared_path(spark, "assigned")
        state = written(spark, state.mapInArrow(_pass(centroids, drift, group), STATE), "assigned", path)
        delete(spark, before)
        moved = moved_sums(state, len(first), dims) if at < rounds else []
        if not moved:  # the last assignment, or one after which nothing would change
            break
        for was, now, n, s in moved:
            for c, sign in ((was, -1), (now, 1)):
                if c >= 0:
                    counts[c] += sign * n
                    sums[c] = [a + sign * b for a, b in zip(sums[c], s, strict=True)]
        new = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids.tolist(), strict=True)], np.int64)
        drift, centroids = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)), new
    centroid = F.element_at(F.lit(centroids.tolist()), F.col("cluster") + 1)
    squares = F.zip_with("v", centroid, lambda x, c: (x - c) * (x - c))
    return Clusters(state.select("vec_id", "v", "cluster", F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance")), centroids.tolist())


def with_inertia(spark: SparkSession, found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia and inertia (sums of distances over the cluster and over all), centroid_sha256."""
    of = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    lookup = spark.createDataFrame([(c, s, sum(of.values()), sha[c]) for c, s in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(lookup), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
