"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on vertices, written to the shared folder. A vertex with many neighbours is
combined on the map side and its join can be split, so no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component``, the smallest vertex reachable; vertices without an edge are absent.

    ``edges`` has two integer columns ``a`` and ``b``. Loops, repeated edges and nulls are ignored.
    """
    edges = materialise(
        edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    )
    before = None
    while before != (now := _fingerprint(edges)):
        before = now
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("m").alias("low"), F.col("v").alias("high"))
        edges = materialise(large.distinct())
        centre = edges.groupBy("high").agg(F.min("low").alias("m"))
        small = (
            edges.join(centre, "high")
            .select(F.explode(F.array(F.struct("m", F.col("low").alias("v")), F.struct("m", F.col("high").alias("v")))).alias("e"))
            .select(F.col("e.m").alias("low"), F.col("e.v").alias("high"))
            .filter("low <> high")
        )
        edges = materialise(small.distinct())
    labels = edges.select(F.col("high").alias("vertex"), F.col("low").alias("component"))
    return labels.unionByName(edges.select(F.col("low").alias("vertex"), F.col("low").alias("component")).distinct())
