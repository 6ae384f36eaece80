"""Connected components by alternating star contraction, on DataFrames.

Every round points the neighbours of each node at the smallest one around it,
first towards larger neighbours, then towards smaller ones, until each
component is a star around its smallest node. Rounds grow with the logarithm
of the longest path. A round is two grouped minimums and two equi-joins; it is
written to the shared folder, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.session import materialize

MAX_ROUNDS = 60


def _toward_smallest(links: DataFrame) -> DataFrame:
    """Large star, then small star; links are (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = materialize(large.distinct(), "star")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node below has one node above, which is below none."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
    )
    nodes = links.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link that is not the smallest of its component.

    Nodes are integers; direction, repeats, loops and null ends of links do not matter.
    """
    current = materialize(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        if _is_settled(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = materialize(_toward_smallest(current), "round")
    raise RuntimeError("components have not settled")
