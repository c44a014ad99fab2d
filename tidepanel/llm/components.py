"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id of the edges (a, b) reaches.  Ids without an edge are absent.

    Each step replaces edges by edges to smaller ids and keeps what is connected:
    the large star links every larger neighbour of a node to the node's least
    neighbour, the small star links the smaller ones.  The rows never outnumber
    the edges by more than the nodes, and a hot node is only joined, never
    gathered: the least neighbours are written first, so that both sides of their
    join are plain exchanges, which Spark may split.  The end is reached when a
    round changes nothing.
    """
    edges = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = _mark(edges)
    while True:
        around = _both_ways(edges)
        least = written(spark, around.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        edges = written(spark, large.distinct(), "edges")
        least = written(spark, edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(spark, small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
