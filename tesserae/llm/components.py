"""Connected components by least labels, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import forget, settle


def least_labels(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``links`` (a, b; longs).

    Each round gives a node the least label around it and then the label of
    that label, so labels travel twice as far each round. Every round is
    written, so a lost executor repeats one round at most; what the rounds before
    have written is removed. Links of a node with itself and repeated links change
    nothing; links with a null are left out; no links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        met = settle(met, "labels")
        jump = met.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = met.join(jump, met["root"] == jump["at"], "left").select("node", "old", F.coalesce("further", "root").alias("root"))
        jumped = settle(jumped, "labels")
        forget(labels, met)
        labels = jumped
        if jumped.where(F.col("root") != F.col("old")).isEmpty():
            forget(both)
            return jumped.select("node", "root")
