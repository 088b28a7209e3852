"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node reachable, for every node that has an edge.

    Alternating large and small stars; each keeps one row for each edge, and the
    minimum of a node is aggregated before the shuffle.  Rounds end when no edge
    moves; their number grows with the logarithm of the nodes.
    """
    state, seen = cut(edges.where("node <> root").select("node", "root")), None
    while True:
        both = state.unionAll(state.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        lower = large.groupBy("node").agg(F.min("root").alias("m"))
        joined = large.join(lower, "node")
        small = joined.select(F.when(F.col("root") == F.col("m"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("m").alias("root"))
        last, state = state, cut(small.where("node <> root").distinct())
        discard(last)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == seen:
            return state
        seen = now
