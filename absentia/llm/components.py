"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from absentia.sources.storage import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest one: larger neighbours of every node (large
    star), or smaller ones and the node itself (small star)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        return moved.distinct()
    # Edges have a < b: the smaller neighbours of b are its a.
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    pair = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(pair)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for every node with an edge.

    Edges are (a, b), in any order. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. Nodes without an
    edge to another are not in the result.
    """
    edges = settle(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while True:
        edges = settle(_stars(_stars(edges, large=True), large=False), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    # Now every edge leads from a root to one of its nodes.
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
