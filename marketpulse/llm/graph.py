"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) with the smallest vertex of each component, from edges (a, b).

    Every round takes the least label among the neighbours and then the label's own label,
    so the number of rounds grows with the logarithm of a component's diameter. Each round
    is written to the shared folder. Vertices are those of the edges.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges"
    ).toDF("v", "w")
    labels = stored(
        both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("other")), "w")
            .groupBy("v")
            .agg(F.min("other").alias("other"))
        )
        lower = labels.join(near, "v").select(
            "v", "label", F.least("label", "other").alias("next")
        )
        jumped = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        after = stored(
            lower.join(jumped, "next").select(
                "v", F.col("label").alias("old"), F.least("next", "jump").alias("label")
            ),
            "labels",
        )
        labels = after.select("v", "label")
        if after.filter("old <> label").isEmpty():
            return labels
