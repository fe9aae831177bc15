"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, both.a == least.u).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return down.join(least, down.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()


def connected_components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node that links reach) of every node in links(a, b); nodes are longs.

    Minima are added up in every task before the shuffle, so a node with very many links
    costs no more than its links. Each round is cut to the shared folder. Rounds needed grow
    with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        mark = new
        edges = cut(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
