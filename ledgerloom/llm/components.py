"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.shared import Stored


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in `links` (columns a, b: long).

    Each step replaces links by links to the smallest neighbour, found by a grouped minimum, so a
    node with very many links is combined before the shuffle. A step that changes nothing ends it.
    """
    state = Stored(_ordered(links, "a", "b"), "links")
    before = _signature(state.frame)
    while True:
        large = Stored(_large_star(state.frame), "large-star")
        state.drop()
        state = Stored(_small_star(large.frame), "small-star")
        large.drop()
        after = _signature(state.frame)
        if after == before:
            break
        before = after
    roots = state.frame.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.frame.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component")).unionByName(roots)


def _ordered(links: DataFrame, a: str, b: str) -> DataFrame:
    pair = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return pair.filter("low < high").distinct()


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or the node."""
    least = links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("smallest"))
    joined = links.join(least, links["low"] == least["node"], "left")
    return _ordered(joined.select(F.coalesce("smallest", "low").alias("a"), F.col("high").alias("b")), "a", "b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself are linked to its smallest neighbour."""
    least = links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("smallest"))
    joined = links.join(least, links["high"] == least["node"]).select("smallest", "low", "high")
    pairs = joined.select(F.col("smallest").alias("a"), F.col("low").alias("b")).unionByName(
        joined.select(F.col("smallest").alias("a"), F.col("high").alias("b"))
    )
    return _ordered(pairs, "a", "b")
