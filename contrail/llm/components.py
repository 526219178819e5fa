"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.sources.sinks import discard, materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is the smallest node reachable.

    Large star: every node passes the smallest of itself and its neighbours to its larger neighbours.
    Small star: the same among its smaller neighbours. The number of rows never grows, and the rounds
    needed grow with the logarithm of the longest path. Each round is written to the shared checkpoint
    folder, so a lost executor costs one round at most. An empty ``links`` gives an empty table.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        moved = both.join(least, both.a == least.k)
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        old, edges = edges, materialize(star(star(edges, True), False), "links")
        discard(old)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
