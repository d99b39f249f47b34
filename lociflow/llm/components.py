"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round replaces edges by edges to the smallest neighbour, first for larger neighbours (large star), then
    for smaller ones (small star), until only stars are left: a logarithmic number of rounds. No neighbour list is
    ever gathered, and the edges of a node with very many are dealt into parts. Edges with a null end and loops are
    ignored; no edges give an empty table.
    """
    plain = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = written(plain.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        total, stars = _shape(now)
        if stars:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(now.select("v", "v").distinct())
        both = now.union(now.select("v", "u")).toDF("u", "v")
        large = _to_least(both, F.least("u", "m"), 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_least(large, F.col("m"), total)
        # a node's own edge to the least one is among its rows, where v = m
        now = written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _to_least(edges: DataFrame, least, total: int) -> DataFrame:
    """edges(u, v) with m, which `least` makes from u and the smallest v of u."""
    ends = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, ends.select("u", least.alias("m")), "u", hot_keys(ends, "u", total))


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether every node is either a centre or a leaf with one centre."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    row = each.agg(F.sum("out").alias("total"), F.count_if(F.expr("out > 1 or out > 0 and into > 0")).alias("odd")).first()
    return row["total"] or 0, not row["odd"]
