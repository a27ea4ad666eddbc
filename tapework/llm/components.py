"""Connected components of a link table, as rounds of joins that each end in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
    return tuple(row)


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (the smallest node reachable) for each node that has a link to another node.

    Links are undirected; loops and repeats do no harm. Alternating large and small stars shrink each component to a star
    around its smallest node; a node with very many links is spread by the joins' skew handling, and its minimum is
    aggregated before the shuffle.
    """
    ends = links.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).where("high <> low")
    edges = cut(ends.distinct())
    before = _print(edges)
    for _ in range(MOST_ROUNDS):
        after = cut(_small_star(_large_star(edges)))
        now = _print(after)
        forget(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    roots = edges.select("low").distinct().select(F.col("low").alias("node"), F.col("low").alias("component"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
