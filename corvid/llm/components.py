"""Connected components of a graph of links, by hooking and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node that links reach from it, for each node with a link.

    Each round lets every node hook to its least neighbour, follows the hooks to their ends by
    doubling, and goes on with the links between different ends; at least half of the nodes of
    each component that is left go in a round. Links may repeat, be loops or hold nulls (which
    link nothing). What is known is written to the shared folder after each round.
    """
    left = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    label = None
    while True:
        both = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("low"))
        hooks = stored(both.select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "hooks")
        if label is None and hooks.isEmpty():
            return hooks
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            hooks = stored(hooks.join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("node", "root")
        if label is None:
            label = hooks
        else:
            then = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            label = stored(label.join(then, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels")
        of_a, of_b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"end_{x}")) for x in ("a", "b"))
        left = stored(left.join(of_a, "a").join(of_b, "b").where("end_a <> end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b")).distinct(), "links")
        if left.isEmpty():
            return label
