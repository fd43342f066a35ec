"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.storage import discard, written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that has an edge.

    Alternates two joins until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. The number of rounds grows with the logarithm of
    the longest chain; each round is written to the shared folder. Self-loops and nulls drop out.
    """
    a, b = F.col(left), F.col(right)
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = written(_to_smaller(_to_larger(now, mark[0]), mark[0]))
        discard(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())


#: From so many edges on, the table of smallest neighbours is written before it is joined. A join
#: of two plain shuffles is one whose hubs adaptive execution splits; below an aggregate it is not.
MANY = 1_000_000


def _smallest(edges: DataFrame, n: int) -> DataFrame:
    """Smallest neighbour of every node that has a smaller one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return written(least) if n >= MANY else least


def _to_larger(edges: DataFrame, n: int) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one, or keeps them if it is smaller itself."""
    least = _smallest(edges, n).withColumnRenamed("a", "b")
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _to_smaller(edges: DataFrame, n: int) -> DataFrame:
    """Every node hands its smaller neighbours to the smallest of them, and keeps that one."""
    if n >= MANY:
        edges = written(edges)
    least = _smallest(edges, n)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
