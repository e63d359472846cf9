"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.runtime import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``u``, ``v``): the same label for those connected.

    In each round every node follows the smallest of itself and its neighbours, and the edges are
    drawn between what their ends follow, without loops and repetitions. Labels are nodes; with
    ids in random order the rounds grow with the logarithm of the number of nodes.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e, labels = materialize(both.where("u <> v").distinct()), None
    while True:
        follows = materialize(e.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        if labels is None:
            labels = follows.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(follows, F.col("label") == F.col("u"), "left").select(
                "node", F.coalesce("p", "label").alias("label")
            )
        if e.isEmpty():
            return labels
        labels = materialize(labels)
        other = follows.select(F.col("u").alias("v"), F.col("p").alias("q"))
        moved = e.join(follows, "u").join(other, "v").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v"))
        e = materialize(moved.distinct())
