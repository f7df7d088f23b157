"""Connected components of a link table, by alternating large-star and small-star rounds.

No links, labels or components reach the driver: it only sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import cut, discard


def _nearest(arcs: DataFrame) -> DataFrame:
    """(u, v, m): each arc with the smallest of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    return (
        near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(near.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


def components(links: DataFrame, name: str) -> DataFrame:
    """links (u long, v long), either direction, repeats and self-links allowed -> (node, component).

    component is the smallest node that can be reached. Nodes without a link to another node are not returned;
    rows with a null end are ignored; an empty table gives an empty result.
    """
    edges = cut(links.filter("u is not null and v is not null and u != v").select("u", "v").distinct(), f"{name}-edges")
    seen = None
    while True:
        before, edges = edges, cut(_small_star(_large_star(edges)), f"{name}-round")
        discard(before)
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == seen or n == 0:
            break
        seen = (n, total)
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
