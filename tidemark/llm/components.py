"""Connected components by alternating large-star and small-star steps.

The method of Kiveris et al., "Connected Components in MapReduce and Beyond"
(SoCC 2014).  Every step is a partial aggregation followed by a join, so a hub
with very many neighbours is reduced before the shuffle and its join partition
can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_small


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Map every node of ``edges`` (columns ``u``, ``v``, any orderable type) to its least reachable node.

    Returns ``node``, ``root``; a root is mapped to itself.  Self-loops and
    repeated edges are allowed, an empty table gives an empty result, and edges
    with a null end are left out.
    """
    loops = edges.filter("u = v").select("u").distinct()
    now = cut_small(
        edges.filter("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(now)
    for _ in range(rounds):
        now = cut_small(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.join(stars.select("node"), loops.u == F.col("node"), "left_anti")
    alone = alone.join(roots.select("node"), alone.u == F.col("node"), "left_anti")
    return stars.union(roots).union(alone.select("u", "u"))
