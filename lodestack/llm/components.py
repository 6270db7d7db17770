"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a, b. Returns node, label: the smallest node of its component.

    Each round takes the smallest label among a node's neighbours, then replaces
    a label by its own label, so path lengths halve. Every round is a checkpoint;
    nothing but a count reaches the driver. Links from a node to itself and
    repeated links are harmless; no links give no rows.

    Both directions of a link come from one evaluation: which of several equally
    good links span a group may depend on the order of rows, and differ the next time.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = cut(edges.where("a <> b").select(both.alias("x")).select("x.a", "x.b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        old = labels.withColumnRenamed("label", "old")
        step = old.join(near, old.node == near.a).select("node", "old", F.least("old", "near").alias("low"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = cut(step.join(up, step.low == up.at, "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("label")))
        if not step.where("label <> old").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")
