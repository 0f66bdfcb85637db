"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node u hangs its larger (large) or its smaller neighbours and itself (small) on the least of them."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # small: u > v holds for every edge already
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    if large:
        m = F.least("m", "u")
        return joined.where("v > u").select(F.col("v").alias("u"), m.alias("v")).distinct()
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component): the least node that links reach, for every node that has a link.

    Edges are kept on disk between rounds; nothing is gathered anywhere. Loops are ignored. discard() deletes what the
    result is read from.
    """
    edges = store(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        before, edges = edges, store(_star(_star(edges, True), False), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
            out.stored_at = edges.stored_at
            return out
        mark = now
