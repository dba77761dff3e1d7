"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` for each endpoint of an edge; component is the smallest node that it reaches.

    Each round hangs the larger neighbours of every node below its smallest neighbour and then does the same with the
    smaller ones; a chain of n nodes needs O(log n) rounds. Only minima are aggregated, so a node with very
    many neighbours is pre-aggregated and its join can be split. Edges with a null end are ignored, a loop gives its node; no edges
    give no rows. Each round's edges are checkpointed; nothing but two numbers for each round reaches the driver.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    pairs = cut(known.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())  # edges are made once
    loops = pairs.where("u = v").select("u")
    current = pairs.where("u <> v")
    seen = _state(current)
    while seen[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(moved.union(roots.select("u", F.col("m").alias("v"))).distinct())
        state = _state(current)
        if state == seen:
            break
        seen = state
    tree = current.union(current.select(F.col("v").alias("u"), "v")).union(loops.select("u", F.col("u").alias("v")))
    return tree.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0
