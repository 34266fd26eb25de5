"""What encloses what in scripts, as relations over tokens: nests, compounds, commands, scopes.

Brackets match by running depth: what opens at a depth closes at the next mark that comes back to it. Intervals that nest
are numbered by their ends, so one encloses another if it begins before and ends behind it. The parent is the
last one that opened a level further out, found by a window over levels, not by comparing intervals with each other;
chains of ancestors come by doubling, so depth costs its logarithm in rounds.

Everything is within a file: windows are by path and, where possible, by nest and level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import stored

#: Where an interval that is never closed ends.
NEVER = 2**62
# What opens and closes compounds, and what divides them.
OPENERS = ("if", "while", "until", "for", "select", "case", "{")
CLOSERS = ("fi", "done", "esac", "}")
DIVIDERS = ("then", "elif", "else", "do")
LOOPS = ("while", "until", "for", "select")


def nested(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``intervals`` (keys, at, stop) with ``level`` (from 1) and ``parent``, the ``at`` of the innermost around it.

    Intervals nest, and begin at different places; a null ``stop`` is behind everything.
    """
    stop = F.coalesce("stop", F.lit(NEVER))
    marks = intervals.select(*keys, F.col("at").alias("pos"), F.lit(1).alias("step"), "at").unionByName(intervals.select(*keys, stop.alias("pos"), F.lit(-1).alias("step"), "at"))
    order = Window.partitionBy(*keys).orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = marks.withColumn("level", F.sum("step").over(order)).where("step = 1").select(*keys, "at", F.col("level").cast("int").alias("level"))
    # An interval opens for those a level further in, and asks at its own for who is open.
    opens = levels.select(*keys, (F.col("level") + 1).alias("slot"), "at", F.lit(True).alias("opens"))
    asks = levels.select(*keys, F.col("level").alias("slot"), "at", F.lit(False).alias("opens"))
    last = Window.partitionBy(*keys, "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parents = opens.unionByName(asks).withColumn("parent", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(last))
    found = parents.where("NOT opens").select(*keys, "at", F.col("slot").alias("level"), "parent")
    return intervals.join(found, [*keys, "at"])


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, pos) with ``inside``, the ``at`` of the innermost of ``intervals`` around each, or null.

    An interval holds the positions from its ``at`` to before its ``stop``.
    """
    points = points.select(*keys, "pos").distinct()
    stop = F.coalesce("stop", F.lit(NEVER))
    marks = intervals.select(*keys, F.col("at").alias("pos"), F.lit(1).alias("step"), F.lit(1).alias("rank")).unionByName(intervals.select(*keys, stop.alias("pos"), F.lit(-1).alias("step"), F.lit(0).alias("rank")))
    marks = marks.unionByName(points.select(*keys, "pos", F.lit(0).alias("step"), F.lit(2).alias("rank")))
    order = Window.partitionBy(*keys).orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = marks.withColumn("slot", F.sum("step").over(order)).where("step >= 0")
    last = Window.partitionBy(*keys, "slot").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = levels.withColumn("inside", F.last(F.when(F.col("step") == 1, F.col("pos")), ignorenulls=True).over(last))
    return held.where("step = 0").select(*keys, "pos", F.when(F.col("slot") > 0, F.col("inside")).alias("inside"))


def lineage(links: DataFrame, keys: list[str], child: str = "at", parent: str = "parent") -> DataFrame:
    """keys, ``child``, ``ancestor`` and ``distance`` (from 1) of all ancestors along ``links``, by doubling."""
    one = links.where(F.col(parent).isNotNull()).select(*keys, F.col(child).alias("_id"), F.col(parent).alias("ancestor")).distinct()
    jump = known = stored(one.withColumn("distance", F.lit(1)), "lineage")
    while True:
        on = jump.select(*keys, F.col("_id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        further = lambda rows: rows.join(on, [*keys, "ancestor"]).select(*keys, "_id", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))  # noqa: E731, B023
        new = stored(further(known), "lineage")
        if new.isEmpty():
            return known.withColumnRenamed("_id", child)
        jump = stored(further(jump), "lineage")
        known = known.unionByName(new)


def selection_chains(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, step (from 0), at and stop of every interval around each point, the innermost first."""
    nest = stored(nested(intervals, keys), "nested")
    inside = stored(innermost(points, nest, keys).where("inside IS NOT NULL"), "inside")
    own = inside.select(*keys, "pos", F.lit(0).alias("step"), F.col("inside").alias("at"))
    outer = inside.withColumnRenamed("inside", "at").join(lineage(nest, keys), [*keys, "at"]).select(*keys, "pos", F.col("distance").alias("step"), F.col("ancestor").alias("at"))
    return own.unionByName(outer).join(nest.select(*keys, "at", "stop"), [*keys, "at"]).select(*keys, "pos", "step", "at", "stop")


# ---- compounds and commands


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def statements(tokens: DataFrame) -> DataFrame:
    """Tokens that make commands, without line breaks that end none, and with ``depth``: how many compounds are open behind each."""
    w = Window.partitionBy("path", "nest").orderBy("at")
    plain = tokens.where("kind IN ('word', 'operator', 'redirect', 'keyword', 'pattern') OR kind = 'nest' AND text = '('")
    # A line break behind an operator, or at the very beginning, ends nothing.
    told = plain.withColumns({"_kind": F.lag("kind").over(w), "_text": F.lag("text").over(w)})
    told = told.where(~((F.col("text") == "\n") & (F.col("kind") == "operator") & (F.col("_kind").isNull() | (F.col("_kind") == "operator") | (F.col("_kind") == "keyword") & ~F.col("_text").isin(*CLOSERS))))
    opens = (F.col("kind") == "keyword") & F.col("text").isin(*OPENERS)
    closes = (F.col("kind") == "keyword") & F.col("text").isin(*CLOSERS)
    depth = F.sum(opens.cast("int") - closes.cast("int")).over(_before("path", "nest"))
    arm = (F.col("kind") == "operator") & (F.col("text") == ")") & (F.col("_kind") == "pattern")
    return told.withColumns({"opens": opens, "closes": closes, "arm": arm, "depth": depth.cast("int")}).drop("_text", "_kind")


def compounds(marked: DataFrame) -> DataFrame:
    """path, nest, at, kind, level, close and stop of each compound; ``marked`` is of ``statements``.

    ``close`` is where its last keyword begins, and ``stop`` where that ends; both are null if it never closes.
    """
    ends = marked.where("opens OR closes").withColumn("level", F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1))
    w = Window.partitionBy("path", "nest", "level").orderBy("at")
    met = ends.withColumns({"close": F.lead(F.when(F.col("closes"), F.col("at"))).over(w), "end": F.lead(F.when(F.col("closes"), F.col("stop"))).over(w), "end_text": F.lead("text").over(w)})
    return met.where("opens").select("path", "nest", "at", F.col("text").alias("kind"), "level", "close", F.col("end").alias("stop"), "end_text", "line_no", "col")


def nested_commands(tokens: DataFrame) -> DataFrame:
    """A row for each simple command of every nest but the words of arrays: path, nest, at, stop, line_no, col, end_line, end_col, name, args, assigned, redirects, head and outer.

    ``head`` is the keyword that it belongs to (``for``, ``select``, ``case``, ``function``) or null, ``outer`` the ``at``
    of the word that the nest stands in, and so of the command that has it, null outside of nests.
    """
    arrays = tokens.where("kind = 'nest' AND text = '=('").select("path", F.col("at").alias("nest"))
    marked = statements(tokens).where("text <> '(' OR kind <> 'nest'").join(arrays, ["path", "nest"], "left_anti")
    breaks = F.col("kind").isin("operator", "keyword", "pattern")
    w = Window.partitionBy("path", "nest").orderBy("at")
    cut = marked.withColumn("part", F.sum(breaks.cast("int")).over(_before("path", "nest"))).withColumn("of", F.when((F.lag("kind").over(w) == "redirect") & (F.col("kind") == "word"), F.lag("text").over(w)))
    head = F.first(F.when(F.col("kind") == "keyword", F.col("text")), ignorenulls=True)
    row = F.struct("at", "kind", "text", "of")
    said = F.array_sort(F.collect_list(F.when(~breaks, row)))
    commands = cut.groupBy("path", "nest", "part").agg(
        head.alias("head"), said.alias("said"), *[F.min(F.when(~breaks, F.struct("at", "line_no", "col"))).alias("first"), F.max(F.when(~breaks, F.struct("stop", "end_line", "end_col"))).alias("last")]
    ).where(F.size("said") > 0)
    words = F.transform(F.filter("said", lambda x: (x["kind"] == "word") & x["of"].isNull()), lambda x: x["text"])
    redirects = F.transform(F.filter("said", lambda x: x["of"].isNotNull()), lambda x: F.concat(x["of"], x["text"]))
    listed = commands.select("path", "nest", F.when(F.col("head").isin("for", "select", "case", "function"), F.col("head")).alias("head"), "first.*", "last.*", words.alias("words"), redirects.alias("redirects"))
    # The words of assignment in front: as many as before the first other one.
    is_set = lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\[[^\]]*\])?\+?=")
    first = F.array_position(F.transform("words", is_set), False).cast("int")
    n = F.when(F.col("head").isNotNull(), 0).when(first == 0, F.size("words")).otherwise(first - 1)
    shown = listed.withColumn("n", n).select(
        "path", "nest", "at", "stop", "line_no", "col", "end_line", "end_col", "head", "redirects", F.slice("words", F.lit(1), F.col("n")).alias("assigned"),
        F.get("words", F.col("n")).alias("name"), F.slice("words", F.col("n") + 2, F.greatest(F.size("words") - F.col("n") - 1, F.lit(0))).alias("args"),
    )
    return shown.join(outer_words(tokens), ["path", "nest"], "left")


def outer_words(tokens: DataFrame) -> DataFrame:
    """path, nest and outer: the word that each nest of commands stands in, if it does in one.

    Quotes and braces in between are followed outwards.
    """
    words = tokens.where("kind = 'word'").select("path", F.col("nest").alias("around"), "at", "stop")
    nests = tokens.where("kind = 'nest'").select("path", "at", "stop", F.col("nest").alias("parent"), F.col("text").alias("mark"))
    inner = nests.where(F.col("mark").isin("$(", "`", "=(", "<(", ">("))
    # Out to the first nest that stands among commands: quotes, braces and sums are no such places.
    soft = nests.where(F.col("mark").isin('"', "${", "$((", "((")).select("path", "at", "parent")
    ends = lineage(soft, ["path"]).select("path", F.col("at").alias("parent"), "ancestor", "distance")
    hard = inner.select("path", F.col("at").alias("pos"), "parent").join(soft.select("path", F.col("at").alias("parent"), F.lit(True).alias("soft")), ["path", "parent"], "left")
    around = hard.where("soft IS NULL").select("path", "pos", F.col("parent").alias("around"))
    within = hard.where("soft").join(ends, ["path", "parent"]).groupBy("path", "pos").agg(F.max_by("ancestor", "distance").alias("around"))
    placed = around.unionByName(within)
    # The last word of that nest which begins at or before it.
    marks = words.select("path", "around", "at", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("pos")).unionByName(placed.select("path", "around", F.col("pos").alias("at"), F.lit(1).alias("rank"), "pos"))
    w = Window.partitionBy("path", "around").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("outer", F.last(F.when(F.col("rank") == 0, F.col("at")), ignorenulls=True).over(w)).where("rank = 1").select("path", F.col("pos").alias("nest"), "outer")


def scopes(tokens: DataFrame) -> DataFrame:
    """path, at, stop, kind, name, level and parent of each scope: functions, subshells and substitutions; files are level 0.

    A function's scope is its body. ``at`` of a file is -1.
    """
    marked = stored(statements(tokens), "statements")
    bodies = function_bodies(marked, compounds(marked))
    nests = tokens.where("kind = 'nest'").where(F.col("text").isin("$(", "`", "(", "<(", ">("))
    kinds = F.when(F.col("text") == "(", "subshell").when(F.col("text").isin("$(", "`"), "substitution").otherwise("process")
    taken = bodies.where("body = '('").select("path", "at")
    rows = nests.select("path", "at", "stop", kinds.alias("kind"), F.lit(None).cast("string").alias("name")).join(taken, ["path", "at"], "left_anti")
    rows = rows.unionByName(bodies.select("path", "at", "stop", F.lit("function").alias("kind"), "name"))
    inner = nested(rows, ["path"]).select("path", "at", "stop", "kind", "name", "level", F.coalesce("parent", F.lit(-1).cast("bigint")).alias("parent"))
    files = tokens.select("path").distinct().select("path", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("stop"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent"))
    return inner.unionByName(files)


def function_bodies(marked: DataFrame, found: DataFrame) -> DataFrame:
    """path, nest, name, named (where its name is), at and stop of each function's body, and whether ``body`` is ``{`` or ``(``.

    A body follows ``name ()`` or ``function name``.
    """
    w = Window.partitionBy("path", "nest").orderBy("at")
    back = lambda column, k: F.lag(column, k).over(w)
    rows = marked.where("text <> '\n' OR kind <> 'operator'")
    rows = rows.withColumns({f"k{k}": back("kind", k) for k in (1, 2)} | {f"t{k}": back("text", k) for k in (1, 2)} | {f"a{k}": back("at", k) for k in (1, 2)})
    body = (F.col("kind") == "keyword") & (F.col("text") == "{") | (F.col("kind") == "nest") & (F.col("text") == "(")
    brackets = (F.col("k1") == "operator") & (F.col("t1") == "()") & (F.col("k2") == "word")
    word = (F.col("k1") == "word") & (F.col("k2") == "keyword") & (F.col("t2") == "function")
    named = rows.where(body & (brackets | word)).select("path", "nest", "at", F.col("stop").alias("own_stop"), F.col("text").alias("body"), F.when(brackets, F.col("t2")).otherwise(F.col("t1")).alias("name"), F.when(brackets, F.col("a2")).otherwise(F.col("a1")).alias("named"))
    braces = found.where("kind = '{'").select("path", "at", F.col("stop").alias("brace_stop"))
    return named.join(braces, ["path", "at"], "left").select("path", "nest", "name", "named", "at", F.when(F.col("body") == "{", F.col("brace_stop")).otherwise(F.col("own_stop")).alias("stop"), "body")


