"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the links (a, b); the component is its smallest node.

    Each round joins every node to its smallest neighbour and to that one's, then replaces
    nodes by what they were joined to. At least half of the nodes go in a round, and links
    inside a merged node with them, so all rounds together cost little more than the first.
    Minima are partial in every task, and each round is a written table. Nodes without links
    are not listed. Null nodes and links of a node to itself are ignored.
    """

    def settled(frame: DataFrame) -> DataFrame:
        pairs = frame.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stored(pairs.distinct(), "links")

    left = settled(links)
    rounds: list[DataFrame] = []
    while not left.isEmpty() or not rounds:
        both = left.union(left.select("b", "a"))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up"))
        joined = stored(joined, "joined-nodes")
        above = joined.select(F.col("node").alias("up"), F.col("up").alias("component"))
        merged = stored(joined.join(above, "up").select("node", "component"), "merged-nodes")
        rounds.append(merged)
        ends = {k: merged.select(F.col("node").alias(k), F.col("component").alias(f"_{k}")) for k in "ab"}
        left = settled(left.join(ends["a"], "a").join(ends["b"], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    labels = rounds[0]
    for merged in rounds[1:]:
        later = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
        labels = labels.join(later, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    return stored(labels, "components") if len(rounds) > 1 else labels
