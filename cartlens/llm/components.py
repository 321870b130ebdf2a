"""Connected components of a link table, round by round in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.session import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (u, v): the smallest node connected to it.

    Each round replaces the links of a node by links to the smallest node in its neighbourhood, first towards
    larger neighbours, then towards smaller ones, until only stars are left; the number of rounds follows the
    logarithm of the longest chain. Every round aggregates before it shuffles, and is checkpointed. A node
    with very many links is only ever the key of a minimum and of a join that adaptive execution can split.
    """
    edges = checkpointed(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        # Large star: every node tells its larger neighbours the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = checkpointed(large)
        # Small star: every node links its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = after
        # In a star, a centre has no link of its own, and every other node has one. Links go to smaller nodes, so the
        # centre of a star is the smallest node of it.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(False).alias("centre")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("links"), F.lit(True).alias("centre"))
        )
        seen = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
        if not seen.where("links > 1 OR (links = 1 AND centre)").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
