"""Connected components by alternating large and small stars, with tables cut each round.

Each round hangs every node on the smallest node it knows of. Rounds grow with the logarithm of a component's
size; no node's edges are gathered in one task, as minima are taken by partial aggregation and what they are
joined back to can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapql.runtime import cut


def _star(edges: DataFrame, hang: str) -> DataFrame:
    """Edges (x, y) as (x, smallest of y for that x) hung on by what ``hang`` says."""
    least = edges.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"))
    joined = edges.join(least, F.col("x") == F.col("k"))
    if hang == "large":
        joined = joined.where("y > x").select(F.col("y").alias("x"), F.least("m", "x").alias("y"))
    else:
        joined = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("k").alias("x"), F.col("m").alias("y")))
    return joined.where("x <> y").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for each node that a link (a, b) has; the component is its smallest node."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _star(both, "large")
        edges = cut(_star(large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), "small"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 31))), F.coalesce(F.sum(F.pmod(F.col("y"), F.lit(1 << 31))), F.lit(0))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
