"""Greedy one-to-one matching of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import cut, drop_cut


def greedy_matching(pairs: DataFrame, least: int = 0) -> DataFrame:
    """(a, b, score) of the pairs that taking the best pair again and again, and all that share its a or b away, leaves.

    Pairs of score ``least`` or less don't count; ties go to the smaller a, then b. A
    round takes every pair that is the best of both its a and its b, which the global
    order would take too, so rounds stay few and no task sees all pairs.
    """
    none = pairs.select("a", "b", "score").limit(0)
    left = cut(pairs.where(F.col("score") > least).groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
    taken = []
    while left.head(1):
        rank = F.struct("score", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        best_a = left.groupBy(F.col("a").alias("k_a")).agg(F.max(rank).alias("r_a"))
        best_b = left.groupBy(F.col("b").alias("k_b")).agg(F.max(rank).alias("r_b"))
        now = cut(best_a.join(best_b, F.col("r_a") == F.col("r_b")).select(F.col("k_a").alias("t_a"), F.col("k_b").alias("t_b"), F.col("r_a.score").alias("score")), "taken")
        taken.append(now)
        rest = cut(left.join(now.select("t_a"), F.col("a") == F.col("t_a"), "left_anti").join(now.select("t_b"), F.col("b") == F.col("t_b"), "left_anti"), "pairs")
        drop_cut(left)
        left = rest
    for t in taken:
        none = none.unionByName(t.select(F.col("t_a").alias("a"), F.col("t_b").alias("b"), "score"))
    return none
