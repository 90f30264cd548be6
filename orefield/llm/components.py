"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.session import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root) for every node that has an edge; root is the component's smallest node.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most. The minima are
    written before they are joined back: a hub's edges then sit in a plain shuffle, which adaptive execution splits.
    Rounds go on until the edges no longer change; a node's neighbour only ever gets smaller, so that comes.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _state(current)
    if not before[0]:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = _state(after)
        discard(current, low, large, low2)
        current = after
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
