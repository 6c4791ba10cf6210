"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwatch.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Minimum labels spread along the edges and then jump to the label of the
    label, so paths shrink by half per round.  Each round is written to the
    checkpoint folder.
    """
    both = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
                       .union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("x").alias("node"))
                         .agg(F.least(F.min("y"), F.first("x")).alias("comp")), "cc-labels")
    while True:
        near = (both.join(labels, both["y"] == labels["node"])
                .groupBy("x").agg(F.min("comp").alias("near")))
        spread = materialize(labels.join(near, F.col("node") == F.col("x"))
                             .select("node", "comp", F.least("comp", "near").alias("next")), "cc-spread")
        if spread.where(F.col("next") < F.col("comp")).limit(1).count() == 0:
            return labels
        jump = spread.select(F.col("node").alias("_j"), F.col("next").alias("_to"))
        labels = materialize(spread.join(jump, F.col("next") == F.col("_j"))
                             .select("node", F.least("next", "_to").alias("comp")), "cc-labels")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the pairs, per row."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == old).all():
            return root
