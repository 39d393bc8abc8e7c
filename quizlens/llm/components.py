"""Connected components by repeated contraction, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; nodes have the same root if and only if they are connected.

    In each round a node points to its neighbour of least priority (a hash,
    new in each round, so that long chains fall apart) or to itself; pointers
    are followed one step further and the graph is contracted along them.
    Minima are aggregated before the shuffle, so a node with very many edges
    is no burden, and each round is staged.  The number of rounds grows with
    the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    flat = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = staged(edges.where(F.col(a) != F.col(b)).select(*flat).distinct(), "edges-0")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        n = len(rounds) + 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(n), F.col(c)).alias("p"), F.col(c).alias("node"))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        parents = staged(least.select("node", F.least(rank("node"), F.col("best"))["node"].alias("parent")), f"parents-{n}")
        further = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        up = staged(parents.join(further, "parent").select("node", F.col("root").alias("parent")), f"up-{n}")
        rounds.append(up)
        moved = (left.join(up.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
                 .join(up.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b"))
        left = staged(moved.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                      .distinct(), f"edges-{n}")
    if not rounds:
        return spark.createDataFrame([], f"node {edges.schema[a].dataType.simpleString()}, root {edges.schema[a].dataType.simpleString()}")
    labels = rounds[-1].select("node", F.col("parent").alias("root"))
    for up in reversed(rounds[:-1]):
        labels = (up.join(labels.withColumnRenamed("node", "parent"), "parent", "left")
                  .select("node", F.coalesce("root", "parent").alias("root")))
    return staged(labels, "components")
