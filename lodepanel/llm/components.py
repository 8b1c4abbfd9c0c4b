"""Connected components by alternating large-star and small-star rounds.

Each round hangs every node's larger (or smaller) neighbours on the smallest node of its neighbourhood; the forest
becomes stars after a number of rounds in the order of log squared of the longest chain. Only (node, node) pairs
move. Minima are pre-aggregated and written before they are joined back, so that both join sides are plain
exchanges and a hub's rows can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import settled


def _hang(pairs: DataFrame, keep) -> DataFrame:
    """For pairs (u, v): each v that `keep` selects hangs on the smallest of u and its neighbours."""
    lowest = settled(pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("lu"), F.least("u", "low").alias("low")))
    return pairs.join(lowest, F.col("u") == F.col("lu")).where(keep(F.col("v"), F.col("u"))).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges(u, v)`, where root is the smallest node that the node reaches.

    Null ends and loops are ignored; repeated edges count once; without edges there are no rows.
    """
    star = settled(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _state(star)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        large = _hang(_both_ways(star), lambda v, u: v > u).distinct()
        large = settled(large.where(F.col("u") != F.col("v")))
        pairs = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = settled(pairs.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "lu"))
        moved = pairs.join(lowest, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        hung = lowest.select(F.col("lu").alias("u"), F.col("low").alias("v"))
        star = settled(moved.unionByName(hung).where(F.col("u") != F.col("v")).distinct())
        now = _state(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = star.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
