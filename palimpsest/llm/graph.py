"""Connected components of an edge table, without ever collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that is reachable.

    Alternates the large-star and small-star steps until what is left are stars: no node hangs on two, none that hangs is hung on.
    Each round is written, so lineage stays short and a lost executor costs one round. Grouping is by node with aggregates that
    combine map-side. Null ends and loops are no edges, repeated edges count once, no edges give no rows. Where no stars are left
    after `rounds`, it raises.
    """
    e = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = common.written(small)
    else:
        if not _stars(e):
            raise RuntimeError(f"no stars after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node of e (u hangs on v) either hangs on one node only or is hung on."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def joined(old: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) after edges join components: only edges between different roots of `old` (node, root) are worked on."""
    if old is None:
        return common.written(components(edges))
    a, b = old.select(F.col("node").alias("a"), F.col("root").alias("ra")), old.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    new = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = common.written(components(new))
    moved = old.join(top.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return common.written(moved.unionByName(top.join(old.select("node"), "node", "left_anti").select("node", "root")))
