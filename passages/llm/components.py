"""Connected components of a graph given as rows (a, b), on DataFrames.

Each round every node takes its least neighbour as parent if that is less than
itself, parents are followed until they are roots (pointer doubling), and edges
are drawn between roots; rounds go on until no edge is left. Edges and labels
stay distributed; every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _followed(parents: DataFrame) -> DataFrame:
    """(node, p) with p the root of node's chain."""
    while True:
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jumped = written(parents.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "parents")
        moved = not jumped.where("moved").isEmpty()
        forget(parents)
        parents = jumped.select("node", "p")
        parents._written_at = jumped._written_at
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable. Written."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _followed(written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p")), "parents"))
        step = parents.select(F.col("node").alias("root"), F.col("p").alias("next"))
        if labels is None:
            labels = parents.select("node", F.col("p").alias("root"))
            labels._written_at = parents._written_at
        else:
            longer = written(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            forget(labels)
            labels = longer
        a = parents.select(F.col("node").alias("a"), F.col("p").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        rest = now.join(a, "a").join(b, "b").where("ra != rb")
        rest = written(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        forget(now)
        if parents._written_at != labels._written_at:
            forget(parents)
        now = rest
        if now.isEmpty():
            forget(now)
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, root) after more edges between nodes, labelled or not; labels themselves if there are none."""
    if edges.isEmpty():
        return labels
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(between)
    step = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    out = written(old.unionByName(fresh), "labels")
    forget(labels, more)
    return out
