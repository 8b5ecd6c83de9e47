"""Connected components of a link table by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; returns such edges. The minimum of each node is found by a map-side combined
    aggregation, so a hub with very many links is no hot task."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        # every larger neighbour of a node is linked to the least of its neighbourhood
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        out = edges.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node. ``links``: a, b in any order."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = staged(edges, "links")
    seen = None
    while True:  # every round lowers some link or is the last; about log(n) rounds
        edges = staged(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
