"""Gradients of neighbour distances for both clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.knn import nearest


def both_ways(a: DataFrame, b: DataFrame, rank: int = 1) -> DataFrame:
    """(side, pid, gx, gy, gz): the gradient of the sum of weight * d2 of each point (pid, x, y, z, weight) and its rank-th
    neighbour in the other cloud, for the points of both. A pair pulls at both of its points; a point gets the sum of its
    own pair's and of those that found it, added up in each task before the shuffle. Points that no pair holds have no row."""
    at = lambda t, n: t.select(F.col("pid").alias(n), *(F.col(c).alias(n + c) for c in "xyz"), F.col("weight").alias(f"{n}w"))
    forth = nearest(a, b, ("pid", "pid"), rank).select("a", "b", F.lit(0).alias("way"))
    back = nearest(b, a, ("pid", "pid"), rank).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("way"))
    pairs = forth.unionByName(back).join(at(a, "a"), "a").join(at(b, "b"), "b")
    weight = F.when(F.col("way") == 0, F.col("aw")).otherwise(F.col("bw"))
    pull = pairs.select("a", "b", *((2 * weight * (F.col(f"a{c}") - F.col(f"b{c}"))).alias(f"g{c}") for c in "xyz"))
    ends = pull.select(F.lit("a").alias("side"), F.col("a").alias("pid"), *(f"g{c}" for c in "xyz")).unionByName(pull.select(F.lit("b").alias("side"), F.col("b").alias("pid"), *((-F.col(f"g{c}")).alias(f"g{c}") for c in "xyz")))
    return ends.groupBy("side", "pid").agg(*(F.sum(f"g{c}").alias(f"g{c}") for c in "xyz"))
