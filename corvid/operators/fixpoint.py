"""Fixpoints over relations: closure, reaching definitions, liveness, chains."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import stored


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], hops: int = 4, compact: int = 8) -> DataFrame:
    """All rows that ``step`` gives from ``seed``, from what it gives of those, and so on.

    ``step`` gives the same of some rows whether others are beside them or not, and ends because there are
    only so many rows that it can give. Only rows that are new take part in a round, which goes ``hops``
    steps; each round's are written to the shared folder, so lineage stays short and a lost executor costs
    one round. After every ``compact`` rounds what is known becomes one table again.
    """
    new = stored(seed.distinct(), "fixpoint")
    seen = new
    for k in count(1):
        reached = last = step(new).distinct()
        for _ in range(hops - 1):
            last = step(last).distinct()
            reached = reached.unionByName(last)
        new = stored(reached.select(*seen.columns).subtract(seen), "fixpoint")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        if k % compact == 0:
            seen = stored(seen, "fixpoint")


def reachable(roots: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``node`` of every node that edges ``a`` to ``b`` reach from ``roots``, roots included."""
    keys = keys or []
    step = lambda new: new.withColumnRenamed("node", "a").join(edges, [*keys, "a"]).select(*keys, F.col("b").alias("node"))
    return fixpoint(roots.select(*keys, "node"), step)


def reaching(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Which definitions reach the entry of which blocks.

    ``blocks`` has ``key``, ``block`` and the ``name`` that it writes; ``edges`` has ``key``, ``a``, ``b``.
    A definition passes a block that writes another name.
    """
    named = edges.join(blocks.select(key, F.col("block").alias("a"), F.col("name").alias("written")), [key, "a"])
    seed = named.select(key, F.col("b").alias("block"), F.col("a").alias("def"), F.col("written").alias("name"))
    step = lambda new: new.withColumnRenamed("block", "a").join(named, [key, "a"]).where("written <> name").select(key, F.col("b").alias("block"), "def", "name")
    return fixpoint(seed, step)


def live(blocks: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Which names are live at the entry of which blocks; a block reads ``used`` before it writes ``name``."""
    back = edges.join(blocks.select(key, F.col("block").alias("a"), F.col("name").alias("written")), [key, "a"])
    seed = blocks.where(F.col("used").isNotNull()).select(key, "block", F.col("used").alias("name"))
    step = lambda new: new.withColumnRenamed("block", "b").join(back, [key, "b"]).where("written <> name").select(key, F.col("a").alias("block"), "name")
    return fixpoint(seed, step)


def chain_ends(links: DataFrame) -> DataFrame:
    """``node`` and ``end`` of each chain of links ``node`` to ``next``, by doubling.

    A chain that runs into a cycle has no end: once no more chains end in a round, the rest never do.
    """
    hops, going = stored(links.select("node", F.col("next").alias("end")), "chains"), -1
    while True:
        further = hops.select(F.col("node").alias("end"), F.col("end").alias("further"))
        hops = stored(hops.join(further, "end", "left").select("node", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("on")), "chains")
        left = hops.where("on").count()
        if left in (0, going):
            return hops.select("node", F.when(~F.col("on"), F.col("end")).alias("end"))
        hops, going = hops.select("node", "end"), left
