"""Connected components of a distributed graph by alternating large-star and small-star.

Each node ends with one edge to the smallest node of its component. A round does two
grouped minima and two equi-joins; the edges of each round are written to the shared
folder, so lineage stays one round long and no node list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the
    smallest node that can be reached. Loops, repeated edges and rows with a null end
    are ignored; an empty edge table gives an empty result."""
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now = now.filter("u is not null and v is not null and u != v")
    now = now.filter(F.col("u") > F.col("v")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        grown = materialize(_large_star(now).distinct(), "edges")
        after = materialize(_small_star(grown).distinct(), "edges")
        discard(grown)
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.lodestone_path = now.lodestone_path  # so that the caller can discard the table
    return out
