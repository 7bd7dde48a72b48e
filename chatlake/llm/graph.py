"""Distributed connected components by alternating large and small stars.

Every round replaces each node's links by links to its smallest neighbour:
first for the larger neighbours of every node, then for the smaller ones.
The number of rounds grows with the logarithm of the longest path.  Every
round is a partial aggregate and two lookups of smallest neighbours.  A hub,
with so many links that they would all meet in one task, is looked up through a
broadcast: there are at most ``HUBS`` of them, as each has at least that part of
all links.  Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import stored


#: Links that make a node a hub, and most hubs of a round.
HUB, HUBS = 2_000, 20_000


def _smallest(edges: DataFrame, key: str, links: int) -> DataFrame:
    """Links (a > b) with ``m``: the smallest neighbour of the ``key`` end, null if it has no smaller one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    many = max(HUB, links // HUBS)
    hubs = edges.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).drop("n")
    known = F.broadcast(hubs.join(least, "node", "left").select(F.col("node").alias(key), "m", F.lit(True).alias("hub")))
    told = edges.join(known, key, "left")
    others = told.where("hub is null").select("a", "b")
    found = others.join(least, others[key] == least["node"], "left").select("a", "b", "m")
    return told.where("hub").select("a", "b", "m").unionByName(found)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Links of each node to larger neighbours move to its smallest neighbour."""
    return _smallest(edges, "b", links).select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest of them."""
    told = _smallest(edges, "a", links)
    return (told.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(told.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root), root the smallest node of the component.

    One row for every linked node but the roots themselves.  Null ends and
    links of a node to itself are ignored; the order of the ends doesn't
    matter.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = stored(links, "cc"), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        large = stored(_large_star(links, now[0]), "cc")
        links = stored(_small_star(large, now[0]), "cc")
