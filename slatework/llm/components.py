"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import written


def components(links: DataFrame, *, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label) for every node with a link, label being the smallest node reachable.

    Labels sink to the smallest neighbour's, then to their own label's label, until nothing changes: the rounds
    grow with the logarithm of the longest chain.  Nodes are joined and aggregated, never gathered.
    """
    ways = links.select(F.col(left).alias("node"), F.col(right).alias("other")).where(F.col(left) != F.col(right))
    ways = written(ways.union(ways.select("other", "node")).distinct())
    labels = written(ways.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = ways.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        sunk = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jumped = sunk.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = written(jumped.select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("before")).isEmpty():
            return labels
