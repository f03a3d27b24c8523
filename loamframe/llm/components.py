"""Connected components of links between keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, ``component`` the smallest node that it reaches.

    ``links`` has two long columns ``a`` and ``b``.  Each round hangs every node's larger neighbours, then its smaller
    ones, on its smallest; the number of rounds grows with the logarithm of the longest chain.  Minima are taken with
    partial sums and met by joins, so a node with very many links is no single task.  Rounds end in written tables.
    """
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = durable(large)
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(lower, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = durable(hung.union(lower.select(F.col("m").alias("a"), "b")).distinct())
