"""Connected components of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """Every vertex ``a`` with its least neighbour or itself as ``least``."""
    return edges.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    return (both.join(_least(both), "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    hung = (edges.join(least, "a").where("b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return hung.union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` of every linked vertex; the least id names it.

    Edges point from the larger to the smaller id.  A round hangs larger
    neighbours, then smaller ones, below the least neighbour; it ends in stars
    after about log(n) rounds.  A vertex with many links is only ever summed up
    by a minimum and joined, never gathered.  Each round is written to the
    checkpoint folder.
    """
    edges = (links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
             .where("a <> b").distinct())
    edges, before = cut_lineage(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = cut_lineage(_small_star(_large_star(edges)).distinct(), "edges")
    hung = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return hung.union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
