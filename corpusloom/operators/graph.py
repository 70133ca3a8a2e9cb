"""Connected components and what is derived from them, on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bounded import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of edges (x, y) by their smallest node.

    Each round takes the neighbours' least label and then that label's own label, so paths halve; every round is cut
    from its lineage. Labels only ever fall, so the rounds come to an end by themselves. Edges with a null end are left out; a loop makes a component of one.
    """
    e = edges.select("x", "y").where("x is not null and y is not null")
    both = checkpointed(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"))
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("_m"))
        step = labels.join(seen, F.col("node") == F.col("x")).select("node", F.least("label", "_m").alias("new"), F.col("label").alias("old"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.new") == F.col("l.node"), "left").select("s.node", F.least("s.new", F.coalesce("l.label", "s.new")).alias("label"), "s.old")
        jump = checkpointed(jump)
        labels = jump.select("node", "label")
        if jump.where("label <> old").isEmpty():
            return labels


def stars(members: DataFrame, key: list[str], node: str) -> DataFrame:
    """(x, y): edges from the least member of each group to the others; groups as large as they come, no pairs."""
    hub = members.groupBy(*key).agg(F.min(node).alias("x"))
    return members.join(hub, key).select("x", F.col(node).alias("y")).where("x <> y").distinct()


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of everything below the roots along edges (parent, child); a node met twice keeps its least depth.

    Each round writes its new nodes alone and meets those of the rounds before in an anti-join; a graph of any depth
    ends, as no node comes twice.
    """
    fronts = [checkpointed(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())]
    while True:
        front, seen = fronts[-1], reduce(DataFrame.unionByName, fronts)
        step = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(len(fronts)).alias("depth")).distinct()
        new = checkpointed(step.join(seen, ["root", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        fronts.append(new)
