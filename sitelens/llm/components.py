"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) of every node that occurs in ``links`` (a, b): the label is its component's smallest node.

    Each step replaces links by links to the smallest neighbour, so the number of rows never grows, and a node with
    very many neighbours is aggregated on the map side. ``links`` should be stored (it is read twice); links and the result
    are checkpointed.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .where("u <> v"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        m = big.groupBy("u").agg(F.min("v").alias("m"))
        e = (big.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint(True))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()   # two numbers
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct().checkpoint(True))
