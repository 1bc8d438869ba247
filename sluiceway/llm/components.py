"""Connected components of a table of links, without ever gathering a node's neighbours.

Large-star and small-star steps alternate until nothing changes: the first links every larger neighbour to the smallest
one, the second links a node and its smaller neighbours to the smallest of them. Each step is one combined aggregate
and one join whose hot side adaptive execution can split. The number of rounds grows with the logarithm of a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import stored


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Expects links from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of the component."""
    current = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        step = stored(small_star(large_star(current)), "links")
        seen = step.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if (seen.n, seen.sum) == mark:
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, mark = step, (seen.n, seen.sum)
