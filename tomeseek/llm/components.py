"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.session import written


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its group) for all nodes of ``links`` (a, b: bigint, any order, repeats allowed).

    Each round takes the smallest label of all neighbours and then the label of one's
    label, so a chain shortens by half. It ends when no label changes, never at a
    count of rounds. Labels of each round are a written table: no lineage grows, and
    no node or label comes to the driver. Work in a task follows a node's links, not
    its group: the label side of the last join is split where one label is frequent.
    """
    both = links.where("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
    labels = written(labels, "labels")
    while True:
        low = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        near = labels.join(low, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("via"))
        onward = labels.select(F.col("node").alias("via"), "root")
        labels = written(near.join(onward, "via").select("node", F.least("root", "via").alias("root"), (F.least("root", "via") < F.col("was")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
