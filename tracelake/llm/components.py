"""Connected components of a graph given by its edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, release

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; the root is the component's
    smallest node and has no row of its own.

    ``edges`` has long columns u and v; direction, repeats and loops don't matter.  Rounds of large
    and small stars (each node's neighbours are tied to the smallest of them) take a number of
    rounds that grows with the logarithm of the graph.  A node with very many neighbours is summed
    up with partial results and joined back by a join that Spark can split.
    """
    down = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = cut(down(edges))
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, cut(down(small))
        release(before)
        told = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("children")).first()
        if told["n"] == told["children"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
