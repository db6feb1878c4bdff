"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is hooked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours are hooked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links (l, r) to (id, component): the smallest id that each linked id can reach. Ids without a link are absent.
    rows: an estimate of the links.

    Aggregates combine before they shuffle, and a hub's edges shrink to one per neighbour with every step; each
    step is written to the shared folder, which cuts the lineage. Steps grow with the logarithm of the longest path."""
    edges = links.where("l <> r").select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).distinct()
    mark = None
    while True:
        before, edges = edges, save(_small_star(_large_star(edges).distinct()).distinct(), "edges", rows)
        if mark is not None:
            discard(before)
        # the state has settled when the same edges come out again
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
