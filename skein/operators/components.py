"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import discard, materialize


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node on an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps on the edge table: hubs are split by the shuffle on the smaller
    neighbour, nothing is gathered on the driver, and each round is written to the shared folder, where it replaces the one before. Null ends, loops and
    repeated edges are dropped; an empty edge table gives an empty result. Raises if max_rounds do not settle it.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is tied to the least neighbour
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour, and the node, is tied to the least
        down = large.where(F.col("u") != F.col("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        stamp = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
