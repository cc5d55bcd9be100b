"""Connected components of a graph by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``, label the least node that can be reached, from edges ``(a, b)``.

    Each round takes the least label of a node's neighbours, then the label of that label,
    so that long paths halve. Rounds are written to the shared folder; the driver sees
    only how many labels changed. Least labels are combined before each shuffle, and the
    joins may split hot nodes. Nodes without an edge are not in the result.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = stored(edges.where(F.col("a") != F.col("b")).select(ways.alias("e")).select("e.*").distinct(), "edges")
    labels = stored(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("_near"))
        hooked = labels.join(near, F.col("node") == F.col("_a")).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label")
        )
        hooked = stored(hooked, "labels")
        of = hooked.select(F.col("node").alias("_node"), F.col("label").alias("_next"))
        jumped = hooked.join(of, F.col("label") == F.col("_node")).select("node", "_old", F.col("_next").alias("label"))
        jumped = stored(jumped, "labels")
        changed = jumped.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
