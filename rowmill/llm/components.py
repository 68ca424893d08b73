"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.table import saved


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (bigint columns ``a`` and ``b``): the smallest node reachable.

    Each round, a node takes the smallest label among its neighbours and then the label of that label, so
    the distance that labels travel doubles. Labels of a round are written to the shared folder. Nothing is
    collected; a node with very many links is reduced on the map side.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        step = saved(
            labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "labels"
        )
        ahead = step.select(F.col("node").alias("comp"), F.col("comp").alias("ahead"))
        labels = saved(step.join(ahead, "comp").select("node", F.col("ahead").alias("comp"), "old"), "labels")
        done = labels.where("comp <> old").isEmpty()
        labels = labels.select("node", "comp")
        if done:
            return labels
