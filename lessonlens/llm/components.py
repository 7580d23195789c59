"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lessonlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label) for every node of an edge; the label is the least node of its component.

    Every round takes the least label among the neighbours, then the label's own label, so the number of rounds grows with
    the logarithm of the longest path. Rounds are written tables; nothing but the count of changes reaches the driver.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = cut_lineage(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower")))
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("root"))
        labels = cut_lineage(lower.join(jump, "lower").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
