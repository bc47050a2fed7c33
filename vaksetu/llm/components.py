"""Connected components by alternating large-star and small-star steps on edge tables.

Each step is two aggregations and joins keyed by node; minima are combined before the shuffle, so a node with very
many links costs one row for each task. No group of links is ever gathered. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release_shuffles


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any order, repeats and self-links allowed: (node, label) with the smallest node of its component.

    Nodes without a link to another node are left out. Null ends are dropped.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        nxt = materialize(_small_star(_large_star(now)), "edges")
        state = _state(nxt)
        discard(now)
        now = nxt
        release_shuffles(spark)
        if state == before:
            break
        before = state
    # every non-root points at its root now
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
