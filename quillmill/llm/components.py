"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Stash, join_groups


def _lowest(e: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours, and how many it has."""
    return _both(e).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is hung under the smallest of u and its neighbours (low: `_lowest` of e)."""
    return join_groups(_both(e).filter("b > a"), low, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def _small(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are hung under the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("low"))
    hung = e.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return hung.union(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """links (a, b) of long nodes -> (node, root) for every node that has a link; root is the smallest node it reaches.

    Each half of a round is written to the shared folder, as it is read several times
    and plans that hold plans grow in the driver; what a round no longer reads goes. A
    few rounds are needed (their number grows with the logarithm of the component size).
    Nothing is collected but a checksum.
    """
    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, k = stash.keep(ordered, "links0"), 0
    was = tally(now)
    while was[0]:
        k += 1
        low = stash.keep(_lowest(now), f"low{k}")
        hung = stash.keep(_large(now, low, was[0]).distinct(), f"hung{k}")
        now = stash.keep(_small(hung).distinct(), f"links{k}")
        for name in (f"low{k}", f"hung{k}", f"links{k - 1}"):
            stash.drop(name)
        got = tally(now)
        if got == was:
            break
        was = got
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
