"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (longs ``a``, ``b``): columns ``node``, ``component``.

    ``component`` is the smallest node that can be reached. Large-star and
    small-star rounds run until the links no longer change: a number of rounds
    logarithmic in the nodes, with no more rows than links in any round. The
    smallest neighbour of each node is stored before it is joined back, so that
    adaptive execution can split the rows of a hub. An empty table gives an
    empty one; repeated links and links from a node to itself do no harm.
    """
    links = stored(_distinct(edges.select("a", "b").where("a <> b")), "links")
    seen = _state(links)
    while seen[0]:
        large = _star(links, both_ways=True)
        small = _star(large, both_ways=False)
        now = _state(small)
        discard(links, large)
        links = small
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node to its smaller one."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or else the smaller ones and itself) to its smallest neighbour."""
    around = links.union(links.select("b", "a")) if both_ways else links
    least = stored(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = around.join(least, "a")
    if both_ways:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    out = stored(_distinct(out), "links")
    discard(least)
    return out
