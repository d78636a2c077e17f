"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.session import cut


def _state(edges: DataFrame) -> tuple:
    """What tells two edge lists apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (a, b) edges; a root is the least node of its component.

    Alternates large-star and small-star steps until the edges are stars. Both take a
    node's least neighbour by a grouped minimum and hand it on by a join, so that a node
    with very many neighbours is combined before the shuffle and split after it. Loops
    give no row.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = _state(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u")), F.struct(F.col("v").alias("u")))).alias("x"), "m")
        state = cut(small.select("x.u", F.col("m").alias("v")).filter("u <> v").distinct())
        now = _state(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
