"""Connected components of a graph given by its edges, as DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.storage import remove, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node with an edge can reach, itself included. Nodes may be of any type that has an order.

    Each round takes the least label among neighbours and then the label of that label, so paths shrink by half and the
    rounds grow with the logarithm of the longest one. A round's labels are written to the shared folder: lineage stays
    short, and the joins are between plain tables, where Spark splits a node with very many edges.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = written(both.union(both.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        low = written(labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "labels")
        up = low.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = written(low.join(up, low["label"] == up["n2"]).select("node", F.col("l2").alias("label"), (F.col("l2") != F.col("old")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        remove(edges.sparkSession, labels, low)
        labels = new.select("node", "label")
        if not moved:
            remove(edges.sparkSession, both)
            return labels


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of components after more links (a, b), which are traced between the old components only."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    tops = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = components(tops)
    lifted = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return written(lifted.unionByName(up.join(labels, "node", "left_anti").select("node", "label")), "labels")


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first node of its component for each of n nodes, by links between i and j, in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
