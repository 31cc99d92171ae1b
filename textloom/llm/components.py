"""Connected components of an edge table, distributed: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, written

SALTS = 16


def connected_components(edges: DataFrame, broadcast_rows: int = 0) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's least node.

    Each round takes the least label among a node's neighbours and then its label's label, so the number of rounds is
    logarithmic in practice. Rounds are written to the shared folder; nothing is collected but the number of changes. Labels of up to
    ``broadcast_rows`` nodes are sent to all executors. Beyond, they are joined by shuffles, and since a label may be shared by a
    large share of all nodes, the next label of each distinct one is looked up with ``SALTS`` keys.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    small = bounded(labels, broadcast_rows) is not None
    sent = F.broadcast if small else (lambda df: df)
    while True:
        near = both.join(sent(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = near.join(sent(labels), "node").select("node", F.least("label", "near").alias("next"), "label")
        lower = written(lower, "lower")
        step = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        if small:
            moved = lower.join(F.broadcast(step), "next")
        else:
            far = lower.select("next").distinct().join(step, "next")
            jump = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            moved = lower.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(jump, ["next", "salt"])
        moved = written(moved.select("node", F.least("next", "far").alias("next"), "label"), "labels")
        done = moved.filter("next != label").isEmpty()
        labels = moved.select("node", F.col("next").alias("label"))
        if done:
            return labels
