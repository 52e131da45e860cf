"""Connected components of a link table, by large-star and small-star rounds.

Every round is two aggregations and joins over links only; minima are
pre-aggregated, so a node with very many neighbours is no large group, and the
joins against one row per node may be split by the adaptive planner. The number
of rounds grows with the logarithm of the largest component. Each round is cut
by a reliable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import cut_lineage


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """Each node u of ``arcs(u, v)`` hooks its neighbours onto the least of
    them and itself: all larger neighbours (large), or, where arcs only lead
    to smaller ones, these and itself (small)."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hooked = arcs.join(least, "u")
    if large:
        return hooked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; root is the least
    node of the component. Nodes without links do not appear; links in either
    direction, repeated ones and loops are fine; null ends are dropped."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = cut_lineage(links), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, large=True).filter("u > v").distinct()
        links = cut_lineage(_star(large, large=False).filter("u > v").distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
