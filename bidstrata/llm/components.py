"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstrata.llm.common import settled


def _toward_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Hang every node's neighbours (all, or only the larger ones) on the least node of its neighbourhood."""
    near = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if larger_only else (
        links.groupBy("a").agg(F.min("b").alias("m")))
    joined = links.join(near, "a")
    if larger_only:
        return joined.where("b > a").selectExpr("b AS a", "m AS b").where("a <> b")
    return joined.selectExpr("b AS a", "m AS b").where("a <> b").union(near.selectExpr("a", "m AS b"))


def least_reachable(links: DataFrame) -> DataFrame:
    """For links (a, b), either way round: every linked node but the least of its component, as (a, root).

    Alternates large-star and small-star steps until nothing changes, O(log² n) rounds on any shape. Each round joins
    links with one row per node, so a node of very high degree is only a skewed join key. Every round is written to
    the shared folder, which bounds the lineage. No links give no rows; self links are ignored.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both, larger_only=True).distinct()
        edges = settled(_toward_least(large, larger_only=False).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select("a", F.col("b").alias("root"))
        seen = state
