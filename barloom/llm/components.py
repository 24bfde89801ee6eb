"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    kept = both.filter("b > a") if large else both.filter("b < a")
    # rows of a hub are many, but each is on its own: the join can be split, and distinct() combines before its shuffle
    star = kept.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        star = star.union(low.select("a", F.col("m").alias("b")))
    return star.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (columns a, b); roots themselves aren't listed.

    Each step is a join and an aggregation over the links, written to the shared folder, until a step changes nothing; the steps of
    a path follow the logarithm of its length. Links between equal nodes are left out.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, before = now, edges
        edges = stored(_star(_star(before, large=True), large=False), "edges")
        discard(before)
