"""Connected components of a table of links, by stars that shrink toward the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, saved, told

#: Rows of a node beyond which what is told of it is broadcast, so that they needn't meet in one
#: task; there are at most as many such nodes as this goes into the rows.
HEAVY = 10_000


def components(links: DataFrame, heavy: int = HEAVY, limit: int = BROADCAST_ROWS) -> DataFrame:
    """links (a, b: long) -> node, root: the smallest node that each node reaches.

    Alternates large-star and small-star steps until nothing changes; the number of rounds
    grows with the logarithm of the longest chain. Each round is written to the shared folder
    and the one before deleted. The links of a node with more than `heavy` don't meet in one
    task. Repeated links and links of a node to itself say nothing; no links, no rows.
    """
    links = saved(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, hot = None, F.col("n") > heavy
    while True:
        both = links.union(links.select("b", "a"))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = saved(told(both.where(F.col("b") > F.col("a")), low, "a", hot, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = saved(told(large, least, "a", hot, limit).select(F.explode(pairs).alias("x")).select("x.*").where(F.col("a") != F.col("b")).distinct(), "links")
        forget(links, low, large, least)
        links = after
        # Stars only: every node has one link, to a root that links to none, and a round leaves them alone.
        sums = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())
        before = sums
