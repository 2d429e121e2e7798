"""Collections that grow from seeds over weighted links, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpalith.sources.kept import written


def expanded(links: DataFrame, seeds: DataFrame, hops: int, floor: float = 0.0) -> DataFrame:
    """(node, score, hops) of what ``seeds(node, score)`` reach over ``links(u, v, weight)`` in ``hops`` steps at most.

    A path scores its seed's score times its links' weights, each product rounded to six decimals; paths that
    fall under ``floor`` end. Each hop keeps the best path to a node, so rings and ties add no rows: a hop has a
    row for each node at most. Of equal scores the fewer hops count. Null nodes and weights lead nowhere, and
    weights are 1 at most, so a way back never scores more.
    """
    level = written(seeds.where("node is not null and score is not null").groupBy("node").agg(F.round(F.max("score"), 6).alias("score")).where(F.col("score") >= floor))
    best = level.select("node", "score", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        met = level.join(links.where("v is not null and weight <= 1"), F.col("node") == F.col("u"))
        level = written(met.groupBy(F.col("v").alias("node")).agg(F.max(F.round(F.col("score") * F.col("weight"), 6)).alias("score")).where(F.col("score") >= floor))
        best = best.union(level.select("node", "score", F.lit(hop).alias("hops")))
    found = best.groupBy("node").agg(F.max(F.struct("score", (-F.col("hops")).alias("near"))).alias("b"))
    return found.select("node", "b.score", (-F.col("b.near")).alias("hops"))
