"""Connected components of a table of links by large-star and small-star rounds.

Each round replaces links by links to smaller ids (the smallest neighbour of each node), written to the
shared folder, until nothing changes: a logarithmic number of rounds. Smallest neighbours are summed
before the shuffle; a node with very many links is joined by Spark's splittable skew join. Nothing is
collected but a count and a checksum of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import scratch_table


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Large star over all neighbours (`both_ways`), small star over the smaller ones; links are (a > b)."""
    near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if both_ways:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reached. Links: (a, b), any order, longs."""
    now = scratch_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))).first())
    last = mark(now)
    for _ in range(max_rounds if last[0] else 0):
        now = scratch_table(_star(_star(now, True), False), "links")
        last, before = mark(now), last
        if last == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if not last[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
