"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns ``node`` and ``component`` (its least node) for every node of an edge.

    Each round runs a large-star and a small-star join and ends once neither
    changes the edges. A star's centre gathers by a partial minimum, never as a
    list, so a component that holds most nodes is no larger task than others.
    Loops give their node its own component; null ends and repeated edges are
    ignored; without edges the result is empty.
    """
    raw = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null").distinct()
    current = cut(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(current)
    while before[0]:
        current = cut(_small_star(_large_star(current)))
        state = _state(current)
        if state == before:
            break
        before = state
    nodes = raw.select(F.col("u").alias("node")).unionByName(raw.select(F.col("v").alias("node"))).distinct()
    named = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
