"""Control flow of scripts: every simple command is a node, and edges say which may run next.

Nodes are numbered in the order of the text. Keywords in front of a command tell which compound it
belongs to: ``if``, ``elif``, ``else`` and ``fi``; ``while``, ``until``, ``for``, ``select`` and ``done``. A condition
leads into its branch and past it; the end of a branch leads to the end of its compound; the end of a
loop leads back; ``break``, ``continue``, ``exit`` and ``return`` leave. ``case`` arms and functions' bodies are
taken in order. The kernels of ``corvid.operators.fixpoint`` run on what this gives.

Edge cases: a file without commands has no nodes. Compounds that never end have edges as far as they go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.fixpoint import reachable
from corvid.operators.semantic import bindings

_LOOPS = ("while", "until", "for", "select")
_LEAVE = ("exit", "return", "break", "continue")


def _keyword(facts: DataFrame) -> Column:
    """What part of a compound a command opens or closes; null for a plain one."""
    leads = lambda *words: F.exists("leading", lambda w: w.isin(*words))
    return F.when(leads("fi"), "fi").when(leads("done"), "done").when(leads("elif"), "elif").when(leads("else"), "else").when(leads("if"), "if").when(leads("while", "until") | F.col("name").isin("for", "select"), "loop")


def nodes(facts: DataFrame) -> DataFrame:
    """path, node (from 1), line_no, seg_no, name, part and level of each command; ``facts`` is of ``commands``.

    ``level`` is how many compounds are open around it; the parts of a compound stand at its own level.
    """
    order = Window.partitionBy("path").orderBy("line_no", "seg_no")
    rows = facts.select("path", "line_no", "seg_no", "name", _keyword(facts).alias("part"), F.row_number().over(order).alias("node"))
    opens, closes = F.col("part").isin("if", "loop").cast("int"), F.col("part").isin("fi", "done").cast("int")
    before = F.sum(F.coalesce(opens, F.lit(0)) - F.coalesce(closes, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = F.col("part").isin("if", "loop", "elif", "else")
    return rows.withColumn("level", before - F.coalesce(inner, F.lit(False)).cast("int"))


def parts(rows: DataFrame) -> DataFrame:
    """path, node, part, owner, following and closer of each part of a compound: its first part, the next one and the last."""
    own = rows.where("part IS NOT NULL").select("path", "node", "part", "level")
    order = Window.partitionBy("path", "level").orderBy("node")
    owned = own.withColumn("owner", F.last(F.when(F.col("part").isin("if", "loop"), F.col("node")), ignorenulls=True).over(order))
    same = Window.partitionBy("path", "owner").orderBy("node")
    closer = F.max(F.when(F.col("part").isin("fi", "done"), F.col("node"))).over(Window.partitionBy("path", "owner"))
    return owned.where("owner IS NOT NULL").select("path", "node", "part", "owner", F.lead("node").over(same).alias("following"), closer.alias("closer"))


def edges(rows: DataFrame) -> DataFrame:
    """path, a and b of each possible step from one node to another."""
    known = parts(rows)
    last = Window.partitionBy("path")
    plain = rows.withColumn("n", F.max("node").over(last))
    # The innermost loop around each node.
    loops = known.where("part = 'loop' AND closer IS NOT NULL").select(F.col("path").alias("_path"), F.col("node").alias("head"), F.col("closer").alias("tail"))
    leaving = rows.where(F.col("name").isin("break", "continue"))
    around = leaving.join(loops, (F.col("path") == F.col("_path")) & (F.col("node") > F.col("head")) & (F.col("node") <= F.col("tail"))).groupBy("path", "node").agg(F.max(F.struct("head", "tail")).alias("loop"))
    # A branch ends before the next part of its ``if``.
    ends = known.where("part IN ('elif', 'else') AND closer IS NOT NULL").select("path", (F.col("node") - 1).alias("node"), F.col("closer").alias("to"))
    full = plain.join(known.drop("part"), ["path", "node"], "left").join(around, ["path", "node"], "left").join(ends, ["path", "node"], "left")
    next_ = F.col("node") + 1
    onward = F.when(F.col("name").isin("exit", "return"), F.lit(None)).when(F.col("name") == "break", F.col("loop.tail") + 1).when(F.col("name") == "continue", F.col("loop.head")).when(F.col("part") == "done", F.col("owner")).when(F.col("to").isNotNull(), F.col("to")).otherwise(next_)
    past = F.when(F.col("part").isin("if", "elif"), F.col("following")).when(F.col("part") == "loop", F.col("closer") + 1)
    both = full.select("path", "n", F.col("node").alias("a"), F.explode(F.array_distinct(F.array_compact(F.array(onward.cast("int"), past.cast("int"))))).alias("b"))
    return both.where("b <= n").select("path", "a", "b")


def unreachable(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes that no path from the first command of their file reaches."""
    roots = rows.where("node = 1").select("path", "node")
    return rows.join(reachable(roots, steps, ["path"]), ["path", "node"], "left_anti")


def writes(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """path, node and the name that it writes: the definitions of reaching and liveness."""
    return bindings(facts).join(rows.select("path", "line_no", "seg_no", "node"), ["path", "line_no", "seg_no"]).select("path", "node", F.col("name").alias("written")).distinct()
