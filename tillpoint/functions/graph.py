"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.session import checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of an edge reaches.

    Star contraction: every round ties the larger neighbours of a node to its
    smallest one, then the smaller neighbours too, until all edges are stars.
    Neighbourhoods are only reduced by partially aggregated minima, so a node
    with very many neighbours is no hot group; each round is checkpointed.
    """
    checkpoint_dir(edges.sparkSession)
    stars = (edges.filter(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct().checkpoint())
    seen = None
    while True:
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(small, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = small.select("hi", F.col("m").alias("lo")).unionByName(rest).distinct().checkpoint()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
