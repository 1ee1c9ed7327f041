"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _to_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Per row of edges: node's other end and the least of node and its other ends."""
    least = edges.groupBy(F.col(node).alias("_n")).agg(F.min(other).alias("_m")).select("_n", F.least("_n", "_m").alias("_m"))
    return edges.join(least, edges[node] == least["_n"]).select(F.col(node), F.col(other), "_m")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for each end of edges (a, b): the least node that it reaches.

    Alternates the large-star and small-star steps until the edges are stars
    around least nodes. A step's joins are on nodes, with one row a node on one
    side, so a hub of any degree may be split; each step's edges are written,
    and the two latest tables remain.
    """
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a <> b").distinct()
        small = _to_least(large, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(small.select("a", F.col("_m").alias("b")))
        new = scratch.cut(small.where("a <> b").distinct(), "edges")
        before, mark = mark, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
