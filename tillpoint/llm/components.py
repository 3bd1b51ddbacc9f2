"""Connected components of an edge table, by spreading the smallest node and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of an edge reaches.

    A round gives every node the smallest label among its neighbours, then the label of that label; the
    neighbours are reduced by a partially aggregated minimum, so a node with very many is no hot group.
    The labels are written once per round.
    """
    most = 2 * edges.count()        # rows of each table: every edge has two ends
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
                   .unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
                   .filter(F.col("x") != F.col("y")).distinct(), "edges", most)
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select(
        "node", F.least("node", "low").alias("comp"))
    labels = written(labels, "labels", most)
    while True:
        near = (both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node"))
                .agg(F.min("comp").alias("near")))
        # the smallest label of the neighbours of all nodes with one label goes to that label's node as well
        joined = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        hooked = joined.groupBy(F.col("comp").alias("node")).agg(F.min("new").alias("hook"))
        fresh = (joined.join(hooked, "node", "left")
                 .select("node", "comp", F.least("new", F.coalesce("hook", "new")).alias("new")))
        jump = fresh.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        after = written(fresh.join(jump, "new", "left").select(
            "node", "comp", F.least("new", F.coalesce("jump", "new")).alias("new")), "labels", most)
        if after.filter(F.col("comp") != F.col("new")).isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", F.col("new").alias("comp"))
