"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.store import keep


def _stars(pairs: DataFrame) -> DataFrame:
    """Every row (u, v) of ``pairs`` with ``low``, the smallest of u and its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return pairs.join(low, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is its smallest reachable node.

    Large and small stars take turns (O(log n) rounds): each node's larger partners, then its smaller
    ones, are tied to the smallest node known to it, until the links are stars around the smallest."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        edges = keep(small.select(F.col("v").alias("u"), F.col("low").alias("v"))
                     .unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
