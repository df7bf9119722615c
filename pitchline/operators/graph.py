"""Connected components of an edge table (used by G3 and the Elo groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): ``label`` is the least node of the component.

    Every round takes the least label among the neighbours and then the label
    of that label (pointer jumping, so a chain of n nodes needs about log n
    rounds), until no label changes.  Rounds are checkpointed: the lineage
    stays short and a lost executor repeats one round at most.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint(eager=True)
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = step.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")).checkpoint(eager=True)
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels
