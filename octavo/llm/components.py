"""Connected components of an edge table by minimum labels and pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.plans.tables import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long) for every node of an edge; component is the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours and then its
    label's label, so rounds grow with the logarithm of the diameter for the star-shaped edges that
    the operators emit. Messages are minimised before they are shuffled; tables between rounds are
    written, so joins read plain exchanges that Spark can split where one node has most edges. Rows
    with a null end or two equal ends link nothing.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL AND a <> b"
    )
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
        "cc-labels",
    )
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        lower = materialize(
            labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")),
            "cc-lower",
        )
        roots = lower.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = materialize(
            lower.join(roots, lower.label == roots.root).select("node", "old", F.col("root_label").alias("label")),
            "cc-labels",
        )
        moved = jumped.where("label <> old").limit(1).count()
        discard(labels, lower)
        labels = jumped
        if not moved:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
