"""Connected components of links between longs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node sends its neighbours (large: the greater ones; small: the lesser ones and itself) to the least of them.

    ``links`` are (a, b) with a > b, distinct. The least neighbour of a node comes from a partial aggregate, and the
    neighbours are joined to it one by one, so no node's neighbours are ever gathered.
    """
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m"))
        least = least.withColumn("m", F.least("m", "a"))
        moved = ways.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: the least node it reaches. Links are columns a and b in any order.

    Null ends and links of a node to itself count for nothing; an empty frame gives no rows. Each round is
    checkpointed; their number grows with the logarithm of the longest path.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a is not null and b is not null and a <> b"
    )
    now = checkpointed(pairs.distinct())
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    mark = now.agg(F.count(F.lit(1)), total).first()
    while mark[0]:
        now = checkpointed(_star(_star(now, True), False))
        after = now.agg(F.count(F.lit(1)), total).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
