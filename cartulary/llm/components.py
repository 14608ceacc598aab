"""Connected components of a graph as DataFrames: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import join_groups, materialise

MOST_ROUNDS = 60


def _star(rows: DataFrame, n: int) -> DataFrame:
    """rows (u, v) with m, the least node among u and all v of u."""
    least = materialise(rows.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")), "stars")
    return join_groups(rows, least, "u", "degree", n).withColumn("m", F.least("u", "low"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v), two long columns; root is the component's least node.

    Every round points nodes to lesser ones, through their neighbours, until
    each points to its root: a number of rounds logarithmic in the nodes. Stars
    are joined so that a node with very many neighbours doesn't gather in a task.
    Loops and repeated edges don't matter; null ends are left out.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        n = now.count()
        if not n:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        small = _star(large, n)
        now = materialise(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
