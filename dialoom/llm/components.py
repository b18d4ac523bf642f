"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save


def _towards(pairs: DataFrame, with_self: bool) -> DataFrame:
    """Edges from each neighbour in ``pairs`` (u, v) to the least node around u.

    The minimum is aggregated before the shuffle, written and joined back, so that Spark can
    split the edges of a node with very many neighbours.
    """
    least = save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = pairs.join(least.hint("merge"), "u")
    edges = out.where("v > u" if not with_self else "true").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if with_self:
        edges = edges.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return edges.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its least node.

    Each round is written to the shared folder.  Self-loops and repeated edges are allowed;
    an empty edge table gives an empty result.
    """
    e = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        e = _towards(both, with_self=False)
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        e = save(_towards(down, with_self=True), "edges")
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            break
        mark = (n, total)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
