"""Connected components on DataFrames by alternating large and small stars.

Every step is a group-by with partial aggregation and an equi-join; nothing is
collected but one count and one checksum a round.  Each round's edges are a
stored table, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_read


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges u, v with the least neighbour of u (u itself included) as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the least node reachable.

    Self-loops keep their node; null ends are ignored; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    own = edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = write_read(own, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = now.where("u = v")
        large = write_read(large.unionByName(loops).distinct(), "large-star")
        down = _with_least(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = write_read(small.distinct(), "small-star")
        seen = now.agg(F.count("*"), F.sum(_checksum(F.col("u"), F.col("v")))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _checksum(u: Column, v: Column) -> Column:
    return F.xxhash64(u, v).cast("decimal(38,0)")
