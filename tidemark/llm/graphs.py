"""Connected components of links between long ids, by smallest labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, label: the smallest id that can be reached, for each id in a link.

    Each step takes the smallest label among neighbours (an aggregate with a partial step, so a hub with very many
    neighbours costs a row per task) and then the label's own label, which makes the number of steps a logarithm of the
    longest path. Nothing but a count comes to the driver.
    """
    both = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, F.col("node") == F.col("of")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        over = step.select(F.col("node").alias("over"), F.col("label").alias("next"))
        jumped = written(step.join(over, step["label"] == over["over"]).select("node", "was", F.col("next").alias("label")), "labels")
        done = jumped.where("label <> was").isEmpty()
        forget(labels, step)
        labels = jumped.select("node", "label")
        labels._tidemark_path = jumped._tidemark_path
        if done:
            forget(both)
            return labels
