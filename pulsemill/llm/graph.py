"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node that each node of a link can reach.

    Every round a node takes the smallest label among its own and its neighbours', then the
    label of its label, so chains shorten by doubling. Each round is written out, and ends
    the lineage. Sums per node are made before rows move; adaptive execution splits the
    joins of a node with many links.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct()
    both = materialize(both.where("src != dst"))
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        near = both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("near")).agg(F.min("label").alias("low"))
        step = labels.join(near, labels["node"] == near["near"]).select(
            "node", "label", F.least("label", "low").alias("low")
        )
        step = materialize(step)
        of = step.select(F.col("node").alias("_n"), F.col("low").alias("_up"))
        jumped = step.join(of, step["low"] == of["_n"], "left").select(
            "node", F.least("low", F.coalesce("_up", "low")).alias("label"), (F.col("label") != F.least("low", F.coalesce("_up", "low"))).alias("changed")
        )
        jumped = materialize(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("changed").isEmpty():
            return labels
