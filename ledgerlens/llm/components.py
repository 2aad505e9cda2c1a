"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). No row is ever gathered by node: each round is
two aggregations to a minimum and two joins, so hub nodes only cost a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, low: DataFrame, keep) -> DataFrame:
    return edges.join(low, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _star(both, low, F.col("v") > F.col("u")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return _star(down, low, F.col("v") != F.col("m")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the component's smallest node.

    Self-loops, repeated edges and edges with a null end are of no effect; no edges: an empty result. Each round is
    written to the shared folder, so that lineage stays short and a lost executor costs one round at most.
    """
    now = staged(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        nxt = staged(_small(_large(now)))
        discard(now)
        now = nxt
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"components: not settled after {rounds} rounds")
