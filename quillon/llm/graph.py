"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label): label is the least node that can be reached. edges: (a, b), any orientable type.

    Every round takes the least label of all neighbours and then the label of that label, so a chain halves each time; the
    labels are written between rounds. No edge or label is collected. An empty table gives an empty one.
    """
    both = edges.select(F.col("a").alias("s"), F.col("b").alias("d")).unionByName(edges.select(F.col("b").alias("s"), F.col("a").alias("d")))
    both = scratch.table(both.distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        least = both.join(labels, F.col("s") == F.col("node")).groupBy(F.col("d").alias("to")).agg(F.min("label").alias("near"))
        near = labels.join(least, F.col("node") == F.col("to")).select("node", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("far"))
        nxt = near.join(roots, F.col("near") == F.col("root"), "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old")
        nxt = scratch.table(nxt, f"{name}-{turn}")
        moved = nxt.where(F.col("label") != F.col("old")).limit(1).count()
        labels = nxt.select("node", "label")
        scratch.drop(f"{name}-{turn - 2}") if turn > 1 else None
        if not moved:
            return labels
