"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (id, component), component the smallest id that edges reach; ids without an edge are absent.

    Each round hangs every neighbour on the smallest one (larger ends first, then smaller ends), until nothing changes;
    rounds grow as the square of the logarithm of the longest path. Minima are combined before the shuffle, so a node
    with very many edges costs one row a task; the join back splits such a node under adaptive execution. Each round is
    written to the shared folder. Nulls, loops and repeated edges are dropped; an empty table gives an empty one.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    )
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(edges), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select("b", "low").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
