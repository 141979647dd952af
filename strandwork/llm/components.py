"""Connected components of an edge table by least labels and pointer jumping, in shuffles only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from strandwork.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of (a, b), root being the least node that edges reach.

    In a round each node takes the least label among its neighbours' and its own, and then its label's label.
    Each round is written as a table; it ends when a round changes nothing. Nodes with any number of edges are
    allowed: minima are taken before the shuffle, and joins leave large keys to adaptive splitting.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    for turn in count(1):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = lower.select(F.col("node").alias("of"), F.col("root").alias("next"))
        labels_now = scratch.table(lower.join(jump, lower["root"] == jump["of"]).select("node", "old", F.least("root", "next").alias("root")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        labels = labels_now.select("node", "root")
        if labels_now.where("root <> old").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
