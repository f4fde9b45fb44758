"""Connected components of links by alternating stars; nothing but three numbers a round comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A node with over this share of all links, and over so many, is a hub. There are 2 / SHARE hubs at most.
SHARE, LINKS = 1e-3, 50_000


def _star(edges: DataFrame, large: bool, most: int | None) -> DataFrame:
    """Link each node's neighbours that are larger (large star), or itself and its smaller ones (small star), to the least.

    The least neighbours of hubs, which have over ``most`` links, are broadcast, so that a hub's links stay where they are.
    Where ``most`` is None there can't be one.
    """
    e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
    far = e.where("v > u") if large else e
    at = F.col("u") == F.col("w")
    if most is None:
        linked = far.join(least, at)
    else:
        hubs = F.broadcast(least.where(F.col("n") > most))
        linked = far.join(hubs, at).unionByName(far.join(hubs, at, "left_anti").join(least.where(F.col("n") <= most), at))
    linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for each node of ``links`` (a, b); self-links and nulls are left out."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("v")).first()
        if now == state:
            break
        state = now
        most = max(LINKS, int(now[0] * SHARE)) if 2 * now[0] > LINKS else None
        edges = materialize(_star(_star(edges, True, most), False, most), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
