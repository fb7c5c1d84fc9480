"""Connected components of a graph that is too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, join_counted, materialise


def components(edges: DataFrame) -> DataFrame:
    """For each end of ``edges`` (a, b) the least node it is connected with: node, label.

    Every step takes the least label among a node's neighbours and then that label's own label,
    so long chains shrink by half each time.  Only joins and partial minima are used, and labels of
    nodes with very many links are broadcast, so these are no single task's work.  The driver sees only whether labels changed.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")), "labels")
    counts = tuple(labels.agg(F.sum("n"), F.max("n")).first())
    while True:
        heard = join_counted(both.toDF("other", "node"), labels, ["node"], counts).select(F.col("other").alias("node"), "label", F.lit(None).cast("long").alias("old"), F.lit(0).cast("long").alias("n"))
        heard = heard.union(labels.select("node", "label", F.col("label").alias("old"), "n"))
        step = heard.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("mid"), F.max("n").alias("n"))
        jump = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        after = step.join(jump, step["mid"] == jump["_node"], "left")
        after = materialise(after.select("node", "old", F.least("mid", F.coalesce("_label", "mid")).alias("label"), "n"), "labels")
        moved = after.where("old <> label").limit(1).count()
        drop(labels)
        labels = after.select("node", "label", "n")
        if not moved:
            drop(both)
            return labels.select("node", "label")
