"""A stored closure kept up over edits: edges go and come, and only what they touch is derived anew.

What a removed edge may have led to is taken away first; of that, what other edges still lead to comes back, step by
step; then added edges join what leads to them and what they lead to.
Pairs go on along edges, never along other pairs, so dense closures aren't multiplied with themselves.
Pairs that no edit touches aren't looked at but by hash joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators.fixpoint import fixpoint
from corvid.storage import stored


def closure_of(edges: DataFrame) -> DataFrame:
    """a and b of everything that edges (a, b) lead to: each pair goes on along edges once, so work goes as pairs times ways out of a node."""
    edges = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "closure")
    return fixpoint(edges, lambda new: _along(new, edges))


def _along(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with their ends moved along an edge."""
    return pairs.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))


def _up_to(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs from all that lead to an edge, or begin it, to its end."""
    into = closure.select(F.col("a").alias("from"), F.col("b").alias("a")).unionByName(edges.select(F.col("a").alias("from"), "a").distinct())
    return edges.join(into, "a").select(F.col("from").alias("a"), "b").distinct()


def kept_up(closure: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure and the edges once ``removed`` have gone from ``edges`` and ``added`` have come.

    ``closure`` is that of ``edges``. Removing what isn't there, or adding what is, changes nothing; what is both removed
    and added is there.
    """
    pick = lambda df: df.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges, added = stored(pick(edges), "edges"), stored(pick(added), "added")
    gone = stored(pick(removed).join(edges, ["a", "b"], "left_semi").join(added, ["a", "b"], "left_anti"), "gone")
    left = stored(edges.join(gone, ["a", "b"], "left_anti"), "edges")
    closure = pick(closure)
    lost = stored(fixpoint(_up_to(closure, gone), lambda new: _along(new, edges)).join(closure, ["a", "b"], "left_semi"), "lost")
    sound = stored(closure.join(lost, ["a", "b"], "left_anti"), "sound")
    # Of what was lost, what an edge that is left still leads to: at once, or through what is sound, or what has come back.
    onward = left.join(lost.select("a").distinct(), "a", "left_semi").select("a", F.col("b").alias("c"))
    direct = lost.join(left, ["a", "b"], "left_semi")
    through = lost.join(onward, "a").join(sound.select(F.col("a").alias("c"), "b"), ["c", "b"], "left_semi").select("a", "b")
    step = lambda new: new.select(F.col("a").alias("c"), "b").join(onward, "c").select("a", "b").join(lost, ["a", "b"], "left_semi")
    back = fixpoint(direct.unionByName(through), step)
    held = stored(sound.unionByName(back).distinct(), "held")
    fresh = stored(added.join(left, ["a", "b"], "left_anti"), "fresh")
    # A pair that is new goes over some added edge: up to the first one's end it's found at once, and from there along edges.
    every = stored(left.unionByName(fresh).distinct(), "edges")
    unknown = lambda rows: rows.join(held, ["a", "b"], "left_anti")
    new = fixpoint(unknown(_up_to(held, fresh)), lambda new: unknown(_along(new, every)))
    return stored(held.unionByName(new), "held"), every
