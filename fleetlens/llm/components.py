"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the least node that links reach.

    Every round takes the least label among a node's neighbours and then the label of that label, so the rounds grow
    with the logarithm of the longest path. Minima are combined before they are shuffled. Every round is written, so a
    lost executor costs one round at most. Loops and repeated links are harmless; no links give no nodes.
    """
    both = saved(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                 .unionAll(links.select("b", "a")).where("node <> other").distinct(), "links")
    labels = saved(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    if not labels.limit(1).count():
        return labels
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "label"), "other")
                .groupBy("node").agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = saved(step.join(jump, "to").select("node", F.least("to", "beyond").alias("new"), "label"), "labels")
        if not new.where("new <> label").limit(1).count():
            return labels
        labels = new.select("node", F.col("new").alias("label"))
