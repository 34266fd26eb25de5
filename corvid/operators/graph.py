"""The flow graph of scripts from their tokens: which command may run after which.

Nodes are simple commands of every nest, and the marks that close a compound or a subshell. What
stands side by side (commands, compounds, subshells of one part of one compound) is in order, and each says what
comes after it: the next one, past a list that its status cuts short, or what the part's end leads to. A condition
leads into its branch and past it, a loop's end back to its head; ``break``, ``continue``, ``exit`` and ``return`` leave.
A function's body is a region of its own, entered at its head; what a substitution runs is entered from what
leads to its command, and leads nowhere.

Everything is windows and joins within a file. ``exit`` in a pipeline ends a subshell only and is passed;
``eval``, traps and aliases are not followed. Compounds that never close have edges as far as they go.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.fixpoint import chain_ends, fixpoint
from corvid.operators.scopes import DIVIDERS, LOOPS, compounds, function_bodies, lineage, nested_commands, statements
from corvid.storage import stored

_TERMS = (";;", ";&", ";;&")


class Flow(NamedTuple):
    """``nodes``: path, node, kind (simple or close), nest, name, args, assigned and where it is; ``edges``: path, a, b;
    ``roots``: path, node and kind (file, function or nest); ``functions``: path, name, named (where its name is) and root;
    ``elements``: path, at, what, nest, parent and head of what stands side by side, with where it is; ``falls``: path, a, b
    of what leaving commands would lead to if they went on, and ``name`` of those; ``finals``: path, node of what may come last in a file,
    but for ``exit`` and ``return``; ``shells``: path, nest, head and close of each subshell: its first node and its end;
    ``ends``: path, node of what would lead to a command behind the file; ``loose``: path, a and name of leaving commands that would, if they
    went on; ``entries``: path, node of what would be entered from a command in front of the file."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    functions: DataFrame
    elements: DataFrame
    falls: DataFrame
    finals: DataFrame
    shells: DataFrame
    ends: DataFrame
    loose: DataFrame
    entries: DataFrame


def _elements(marked: DataFrame, commands: DataFrame, found: DataFrame) -> DataFrame:
    """path, nest, at, what, slot (the level it stands at) and op (the operator before it) of what stands side by side."""
    w = Window.partitionBy("path", "nest").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = marked.withColumn("op", F.last(F.when(F.col("kind") == "operator", F.col("text")), ignorenulls=True).over(w)).select("path", "nest", "at", "op", "depth", "kind", "text")
    simple = commands.select("path", "nest", "at", F.lit("simple").alias("what"))
    shells = marked.where("kind = 'nest'").select("path", "nest", "at", F.lit("shell").alias("what"))
    joined = simple.unionByName(shells).join(told, ["path", "nest", "at"]).select("path", "nest", "at", "what", F.col("depth").alias("slot"), "op")
    return joined.unionByName(found.select("path", "nest", "at", F.lit("compound").alias("what"), (F.col("level") - 1).alias("slot")).join(told.select("path", "nest", "at", "op"), ["path", "nest", "at"]))


def _placed(marked: DataFrame, elements: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with parent, part and tag (where the part begins, and by what); and the parts of compounds."""
    rows = found.select("path", "nest", F.col("level").alias("slot"), "at", F.lit("open").alias("role"), F.col("kind").alias("tag"))
    divides = marked.where("kind = 'keyword'").where(F.col("text").isin(*DIVIDERS)).unionByName(marked.where("arm"))
    rows = rows.unionByName(divides.select("path", "nest", F.col("depth").alias("slot"), "at", F.lit("divide").alias("role"), F.col("text").alias("tag")))
    rows = rows.unionByName(marked.where(F.col("text").isin(*_TERMS)).where("kind = 'operator'").select("path", "nest", F.col("depth").alias("slot"), "at", F.lit("term").alias("role"), F.col("text").alias("tag")))
    rows = rows.unionByName(elements.select("path", "nest", "slot", "at", F.lit("element").alias("role"), F.lit(None).cast("string").alias("tag")))
    w = Window.partitionBy("path", "nest", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda column, *roles: F.last(F.when(F.col("role").isin(*roles), F.col(column)), ignorenulls=True).over(w)
    known = rows.withColumns({"parent": last("at", "open"), "part": last("at", "open", "divide"), "part_tag": last("tag", "open", "divide")})
    inside = elements.join(known.where("role = 'element'").select("path", "nest", "slot", "at", "parent", "part", "part_tag"), ["path", "nest", "slot", "at"])
    of = Window.partitionBy("path", "nest", "parent").orderBy("at")
    ends = known.where("role IN ('open', 'divide', 'term') AND parent IS NOT NULL")
    ends = ends.withColumn("term", F.lead(F.when(F.col("role") == "term", F.col("tag"))).over(of)).withColumn("term_at", F.lead(F.when(F.col("role") == "term", F.col("at"))).over(of))
    parts = ends.where("role <> 'term'").select("path", "nest", "parent", "part", "part_tag", "term", "term_at", F.lead("part").over(of).alias("next"), F.lead("part", 2).over(of).alias("second"))
    return inside, parts


def _heads(spots: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, spot and head: the first node at or behind each spot of the text."""
    spots = spots.select("path", F.col("spot")).where("spot IS NOT NULL").distinct()
    both = spots.select("path", F.col("spot").alias("at"), F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("node")).unionByName(nodes.select("path", F.col("node").alias("at"), F.lit(1).alias("rank"), "node"))
    w = Window.partitionBy("path").orderBy("at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("head", F.first("node", ignorenulls=True).over(w)).where("rank = 0 AND head IS NOT NULL").select("path", F.col("at").alias("spot"), "head")


def flow_graph(tokens: DataFrame) -> Flow:
    """The flow of scripts; ``tokens`` is of ``corvid.functions.lexer.tokens``."""
    marked = stored(statements(tokens), "statements")
    found = stored(compounds(marked), "compounds")
    commands = stored(nested_commands(tokens).join(_said_behind(marked), ["path", "at"], "left_anti"), "commands")
    bodies = stored(function_bodies(marked, found), "bodies")
    shells = marked.where("kind = 'nest'").select("path", "at", (F.col("stop") - 1).alias("close"), "nest", "end_line", "end_col")
    spot = ["line_no", "col", "end_line", "end_col"]
    none = lambda kind: F.lit(None).cast(kind)
    simple = commands.select("path", F.col("at").alias("node"), F.lit("simple").alias("kind"), "nest", none("bigint").alias("of"), "head", "name", "args", "assigned", "stop", "outer", *spot)
    marks = marked.where("closes").select("path", F.col("at").alias("close"), *spot)
    shut = found.where("close IS NOT NULL").select("path", "nest", F.col("at").alias("of"), "close", F.col("end_text").alias("name")).join(marks, ["path", "close"])
    shut = shut.unionByName(shells.where("close IS NOT NULL").select("path", "nest", F.col("at").alias("of"), "close", F.lit(")").alias("name"), F.col("end_line").alias("line_no"), (F.col("end_col") - 1).alias("col"), "end_line", "end_col"))
    closers = shut.select("path", F.col("close").alias("node"), F.lit("close").alias("kind"), "nest", "of", none("string").alias("head"), "name", none("array<string>").alias("args"), none("array<string>").alias("assigned"), (F.col("close") + F.length("name")).alias("stop"), none("bigint").alias("outer"), *spot)
    nodes = stored(simple.unionByName(closers), "nodes")

    elements = stored(_elements(marked, commands, found), "elements")
    placed, parts = _placed(marked, elements, found)
    placed, parts = stored(placed, "placed"), stored(parts, "parts")
    bare = placed.join(bodies.select("path", "at"), ["path", "at"], "left_anti")
    w = Window.partitionBy("path", "nest", F.coalesce("parent", F.lit(-1)), F.coalesce("part", F.lit(-1))).orderBy("at")
    turn = F.when(F.coalesce("op", F.lit("")) != F.coalesce(F.lag("op").over(w), F.lit("")), F.col("at"))
    rows = bare.withColumn("turn", turn)
    rows = rows.withColumns({"next": F.lead("at").over(w), "next_op": F.lead("op").over(w), "past": F.first("turn", ignorenulls=True).over(w.rowsBetween(2, Window.unboundedFollowing))})
    rows = stored(rows, "siblings")

    # Where each spot that something leads to begins to run.
    spots = rows.select("path", F.col("next").alias("spot")).union(rows.select("path", "past")).union(parts.select("path", "next")).union(parts.select("path", "second")).union(parts.where("part_tag = ')'").select("path", "part")).union(found.select("path", "at"))
    spots = spots.union(bodies.select("path", "at")).union(tokens.where("kind = 'nest'").select("path", F.col("at") + 1))
    heads = stored(_heads(spots, nodes), "heads")
    head_of = lambda df, column: df.join(heads.select("path", F.col("spot").alias(column), F.col("head").alias(f"{column}_head")), ["path", column], "left")

    conditional = F.col("next_op").isin("&&", "||")
    onward = head_of(head_of(rows, "next"), "past").withColumn("ends", F.col("next").isNull() | conditional & F.col("past").isNull())
    steps = onward.select("path", "at", F.explode(F.array_compact(F.array("next_head", F.when(conditional, F.col("past_head"))))).alias("b"))
    last = onward.where("ends").select("path", "nest", "at", "parent", "part", "part_tag")

    # What the end of each part leads to.
    closed = found.select("path", F.col("at").alias("parent"), "close", F.col("kind").alias("parent_kind"))
    full = head_of(head_of(head_of(parts, "next"), "second"), "part").join(closed, ["path", "parent"])
    empty = F.col("part_head").isNull() | (F.col("term_at").isNotNull() & (F.col("part_head") > F.col("term_at")))
    of_case = Window.partitionBy("path", "parent").orderBy("part")
    full = full.withColumn("entry", F.when(empty, F.col("close")).otherwise(F.col("part_head"))).withColumn("next_entry", F.lead("entry").over(of_case))
    arms = full.where("part_tag = ')'").groupBy("path", "parent").agg(F.collect_set("entry").alias("entries"))
    defaults = _defaults(marked, found)
    full = full.join(arms, ["path", "parent"], "left").join(defaults, ["path", "parent"], "left")
    tag, to = F.col("part_tag"), lambda *columns: F.array_compact(F.array(*columns))
    lead = F.coalesce("second_head", "close")
    targets = (
        F.when(tag.isin("if", "elif"), to(F.col("next_head"), F.when(F.col("second").isNull(), F.col("close")).otherwise(lead)))
        .when(tag.isin(*LOOPS), to(F.col("next_head")))
        .when(tag == "case", F.concat(F.coalesce("entries", F.array().cast("array<bigint>")), to(F.when(F.col("has_default").isNull(), F.col("close")))))
        .when((tag == ")") & (F.col("term") == ";&"), to(F.coalesce("next_entry", "close")))
        .when((tag == ")") & (F.col("term") == ";;&"), to(F.col("next_entry"), F.col("close")))
        .otherwise(to(F.col("close")))
    )
    ends = stored(full.select("path", "nest", "parent", "part", targets.alias("targets"), tag.isin(*LOOPS).alias("also_after")), "part-ends")
    at_end = last.where("parent IS NOT NULL").join(ends, ["path", "nest", "parent", "part"])
    steps = steps.unionByName(at_end.select("path", "at", F.explode("targets").alias("b")))
    steps = steps.unionByName(last.where("parent IS NULL AND nest >= 0").join(shells.where("close IS NOT NULL").select("path", F.col("at").alias("nest"), F.col("close").alias("b")), ["path", "nest"]).select("path", "at", "b"))
    steps = stored(steps, "steps")
    # The end of a loop's condition leads to what comes after the loop as well; that may be such an end again.
    refs = stored(at_end.where("also_after").select("path", "at", "parent"), "refs")
    further = lineage(refs, ["path"]).select("path", "at", F.col("ancestor").alias("via"))
    after = stored(steps.unionByName(further.join(steps.withColumnRenamed("at", "via"), ["path", "via"]).select("path", "at", "b")).distinct(), "after")

    onto, back = _plain_ways(nodes, rows, found, bodies, heads)
    out = onto.join(after, ["path", "at"]).select("path", "a", "b").unionByName(back)
    left, broken = _leaving_edges(nodes, placed, found, after, heads, shells)
    over = last.where("parent IS NULL AND nest = -1").select("path", "at")
    over = stored(over.unionByName(further.join(over.withColumnRenamed("at", "via"), ["path", "via"]).select("path", "at")).distinct(), "over")
    loops = found.where(F.col("kind").isin(*LOOPS)).select("path", F.col("at").alias("of"))
    finals = nodes.where(~_is_leaving()).where("kind = 'simple'").select("path", F.col("node").alias("at"), "node")
    finals = finals.unionByName(nodes.where("kind = 'close'").join(loops, ["path", "of"], "left_anti").join(bodies.select("path", F.col("at").alias("of")), ["path", "of"], "left_anti").select("path", F.col("of").alias("at"), "node"))
    finals = stored(finals.unionByName(broken.select("path", F.col("loop").alias("at"), "node")).join(over, ["path", "at"]).select("path", "node").distinct(), "finals")
    inner = out.unionByName(left).distinct()
    past = onto.select("path", F.col("a").alias("node"), "at").unionByName(broken.select("path", "node", F.col("loop").alias("at"))).join(over, ["path", "at"]).select("path", "node").distinct()
    loose = nodes.where(_is_leaving()).select("path", F.col("node").alias("at"), "name").join(over, ["path", "at"]).select("path", F.col("at").alias("a"), "name")
    edges, roots, entries = _entered(tokens, nodes, stored(inner, "edges"), bodies, heads)
    functions = bodies.select("path", "name", "named", F.col("at").alias("spot")).join(heads, ["path", "spot"]).select("path", "name", "named", F.col("head").alias("root"))
    falls = nodes.where(_is_leaving()).select("path", F.col("node").alias("at"), "name").join(after, ["path", "at"]).select("path", F.col("at").alias("a"), "b", "name")
    where = nodes.where("kind = 'simple'").select("path", F.col("node").alias("at"), "line_no", "col").unionByName(found.select("path", "at", "line_no", "col")).unionByName(marked.where("kind = 'nest'").select("path", "at", "line_no", "col"))
    first = F.when(F.col("what") == "simple", F.col("at")).otherwise(F.coalesce("head", "at"))
    spotted = bare.withColumn("spot", F.when(F.col("what") == "shell", F.col("at") + 1).otherwise(F.col("at"))).join(heads, ["path", "spot"], "left")
    shown = spotted.select("path", "at", "what", "nest", "parent", first.alias("head")).join(where, ["path", "at"])
    inner = shells.where("close IS NOT NULL").select("path", F.col("at").alias("nest"), (F.col("at") + 1).alias("spot"), "close").join(heads, ["path", "spot"]).where("head < close").select("path", "nest", "head", "close")
    return Flow(nodes, edges, roots, functions, stored(shown, "shown"), stored(falls, "falls"), finals, stored(inner, "shells"), stored(past, "ends"), loose, entries)


def _said_behind(marked: DataFrame) -> DataFrame:
    """Redirections behind a closing mark begin no command: path and at of what follows one directly."""
    w = Window.partitionBy("path", "nest").orderBy("at")
    behind = (F.lag("closes").over(w)) | (F.lag("kind").over(w) == "nest")
    return marked.withColumn("behind", behind).where("behind AND kind IN ('redirect', 'word')").select("path", "at")


def _defaults(marked: DataFrame, found: DataFrame) -> DataFrame:
    """path and parent of each ``case`` that has an arm for everything."""
    w = Window.partitionBy("path", "nest").orderBy("at")
    stars = marked.withColumn("ends", F.lead("arm").over(w)).where("kind = 'pattern' AND text = '*' AND ends")
    slots = Window.partitionBy("path", "nest", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = found.select("path", "nest", F.col("level").alias("slot"), "at", F.lit(True).alias("opens")).unionByName(stars.select("path", "nest", F.col("depth").alias("slot"), "at", F.lit(False).alias("opens")))
    of = both.withColumn("parent", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(slots)).where("NOT opens")
    return of.select("path", "parent", F.lit(True).alias("has_default")).distinct()


def _is_leaving() -> Column:
    return (F.col("kind") == "simple") & F.col("head").isNull() & F.coalesce(F.col("name").isin("exit", "return", "break", "continue"), F.lit(False))


def _plain_ways(nodes: DataFrame, rows: DataFrame, found: DataFrame, bodies: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, a and at: nodes that lead to what comes after an element; and edges from the ends of loops back to their heads."""
    piped = rows.where((F.col("op").isin("|", "|&")) | F.col("next_op").isin("|", "|&")).select("path", F.col("at").alias("node"), F.lit(True).alias("piped"))
    stays = nodes.join(piped, ["path", "node"], "left").where(~_is_leaving() | F.col("piped") & F.col("name").isin("exit", "return"))
    simple = stays.where("kind = 'simple'").select("path", F.col("node").alias("a"), F.col("node").alias("at"))
    loops = found.where(F.col("kind").isin(*LOOPS)).select("path", F.col("at").alias("of"))
    ends = nodes.where("kind = 'close'").select("path", "node", "of")
    back = ends.join(loops, ["path", "of"]).join(heads.withColumnRenamed("spot", "of"), ["path", "of"]).select("path", F.col("node").alias("a"), F.col("head").alias("b"))
    on = ends.join(loops, ["path", "of"], "left_anti").join(bodies.select("path", F.col("at").alias("of")), ["path", "of"], "left_anti").select("path", F.col("node").alias("a"), F.col("of").alias("at"))
    return simple.unionByName(on), back


def _leaving_edges(nodes: DataFrame, placed: DataFrame, found: DataFrame, after: DataFrame, heads: DataFrame, shells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``break`` and ``continue`` go behind and to the head of the loop that they name, ``exit`` to the end of its subshell; and which loop each ``break`` leaves."""
    leaving = nodes.where(_is_leaving())
    out = leaving.where("name = 'exit'").join(shells.where("close IS NOT NULL").select("path", F.col("at").alias("nest"), F.col("close").alias("b")), ["path", "nest"]).select("path", F.col("node").alias("a"), "b")
    jumps = leaving.where("name IN ('break', 'continue')").select("path", "node", "name", F.coalesce(F.expr("try_cast(get(args, 0) AS int)"), F.lit(1)).alias("n"))
    inside = jumps.join(placed.select("path", F.col("at").alias("node"), "parent"), ["path", "node"]).where("parent IS NOT NULL")
    tree = placed.where("what = 'compound' AND parent IS NOT NULL").select("path", "at", "parent")
    outer = lineage(tree, ["path"]).select("path", F.col("at").alias("parent"), "ancestor")
    around = inside.select("path", "node", "name", "n", F.col("parent").alias("loop")).unionByName(inside.join(outer, ["path", "parent"]).select("path", "node", "name", "n", F.col("ancestor").alias("loop")))
    loops = around.join(found.where(F.col("kind").isin(*LOOPS)).select("path", F.col("at").alias("loop")), ["path", "loop"])
    w = Window.partitionBy("path", "node")
    # A number beyond the loops there are means the outermost.
    chosen = loops.withColumns({"k": F.row_number().over(w.orderBy(F.desc("loop"))), "most": F.count("*").over(w)}).where("k = least(greatest(n, 1), most)")
    again = chosen.where("name = 'continue'").join(heads.withColumnRenamed("spot", "loop"), ["path", "loop"]).select("path", F.col("node").alias("a"), F.col("head").alias("b"))
    gone = chosen.where("name = 'break'").join(after.withColumnRenamed("at", "loop"), ["path", "loop"]).select("path", F.col("node").alias("a"), "b")
    return out.unionByName(again).unionByName(gone), chosen.where("name = 'break'").select("path", "node", "loop")


def _entered(tokens: DataFrame, nodes: DataFrame, edges: DataFrame, bodies: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges into substitutions, from what leads to their commands; the roots; and the file's first node with what is entered beside it."""
    firsts = nodes.groupBy("path").agg(F.min("node").alias("node")).withColumn("kind", F.lit("file"))
    entries = bodies.select("path", F.col("at").alias("spot")).join(heads, ["path", "spot"]).select("path", F.col("head").alias("node"), F.lit("function").alias("kind"))
    nests = tokens.where("kind = 'nest'").where(F.col("text").isin("$(", "`", "<(", ">(")).select("path", (F.col("at") + 1).alias("spot"), F.col("at").alias("nest"), "stop")
    inner = nests.join(heads, ["path", "spot"]).where("stop IS NULL OR head < stop").select("path", "nest", F.col("head").alias("first"))
    outer = nodes.where("outer IS NOT NULL").select("path", "nest", F.col("outer").alias("pos")).distinct()
    # The command that the word is of: the last one of any nest that begins at or before it and has it within.
    both = nodes.where("kind = 'simple'").select("path", F.col("node").alias("at"), F.lit(0).alias("rank"), "node", "stop", F.lit(None).cast("bigint").alias("nest")).unionByName(outer.select("path", F.col("pos").alias("at"), F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("stop"), "nest"))
    w = Window.partitionBy("path").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("container", F.last("node", ignorenulls=True).over(w)).where("rank = 1").select("path", "nest", "container")
    entered = inner.join(held, ["path", "nest"], "left")
    into = entered.where("container IS NOT NULL").join(edges.withColumnRenamed("b", "container"), ["path", "container"]).select("path", "a", F.col("first").alias("b"))
    # Substitutions in substitutions: what leads to the outer one's first command leads to theirs.
    edges = stored(edges.unionByName(into).distinct(), "edges-in")
    roots = firsts.unionByName(entries)
    begun = entered.where("container IS NULL").select("path", F.col("first").alias("node")).unionByName(entered.join(roots.select("path", F.col("node").alias("container")), ["path", "container"]).select("path", F.col("first").alias("node")))
    beside = entered.join(firsts.select("path", F.col("node").alias("container")), ["path", "container"]).select("path", F.col("first").alias("node"))
    entries = stored(firsts.select("path", "node").unionByName(beside).distinct(), "entries")
    return edges, stored(roots.unionByName(begun.withColumn("kind", F.lit("nest"))).dropDuplicates(["path", "node"]), "roots"), entries


# ---- what follows from it


def blocks(flow: Flow) -> tuple[DataFrame, DataFrame]:
    """path, node and block of each node, and the edges between blocks.

    A block is a stretch of nodes, each with one way on to the next and no other way into it; its number is its first
    node. Stretches are followed by doubling, so later fixpoints take as many steps as there are branches, not commands.
    """
    ways_out, ways_in = flow.edges.groupBy("path", "a").agg(F.count("*").alias("n_out")), flow.edges.groupBy("path", "b").agg(F.count("*").alias("n_in"))
    only = flow.edges.join(ways_out.where("n_out = 1"), ["path", "a"]).join(ways_in.where("n_in = 1"), ["path", "b"]).join(flow.roots.select("path", F.col("node").alias("b")), ["path", "b"], "left_anti").where("a <> b")
    key = lambda column: F.struct("path", F.col(column).alias("node"))
    ends = chain_ends(only.select(key("b").alias("node"), key("a").alias("next")))
    known = flow.nodes.select("path", "node").join(ends.select("node.path", "node.node", F.col("end.node").alias("first")), ["path", "node"], "left")
    of = stored(known.select("path", "node", F.coalesce("first", "node").alias("block")), "blocks")
    a, b = of.select("path", F.col("node").alias("a"), F.col("block").alias("block_a")), of.select("path", F.col("node").alias("b"), F.col("block").alias("block_b"))
    inside = only.select("path", "a", "b", F.lit(True).alias("inside"))
    between = flow.edges.join(inside, ["path", "a", "b"], "left").join(a, ["path", "a"]).join(b, ["path", "b"]).where("inside IS NULL OR block_a <> block_b")
    return of, stored(between.select("path", F.col("block_a").alias("a"), F.col("block_b").alias("b")).distinct(), "block-edges")


def _reached(flow: Flow, of: DataFrame, between: DataFrame) -> DataFrame:
    """path and block of what some root leads to."""
    roots = flow.roots.select("path", "node").join(of, ["path", "node"]).select("path", F.col("block").alias("node")).distinct()
    step = lambda new: new.withColumnRenamed("node", "a").join(between, ["path", "a"]).select("path", F.col("b").alias("node"))
    return fixpoint(roots, step).withColumnRenamed("node", "block")


def unreachable_nodes(flow: Flow) -> DataFrame:
    """Nodes that no path from a root reaches; functions' bodies count as entered."""
    of, between = blocks(flow)
    gone = of.join(_reached(flow, of, between), ["path", "block"], "left_anti")
    return flow.nodes.join(gone.select("path", "node"), ["path", "node"])


def dead_code(flow: Flow) -> DataFrame:
    """path, line_no and col of what can't be reached because of ``exit`` or ``return``: the outermost commands and compounds.

    What a loop's ``break`` or ``continue`` cuts off isn't among it, nor is the inside of a function that is never defined.
    """
    return outermost(flow, dead_nodes(flow))


def dead_nodes(flow: Flow) -> DataFrame:
    """path and head: nodes that can't be reached because of ``exit`` or ``return``."""
    jumps = flow.falls.where("name IN ('break', 'continue')").select("path", "a", "b")
    onward = flow._replace(edges=stored(flow.edges.unionByName(jumps).distinct(), "edges-on"))
    return stored(unreachable_nodes(onward).select("path", F.col("node").alias("head")), "dead")


def outermost(flow: Flow, dead: DataFrame) -> DataFrame:
    """path, line_no and col of the outermost commands and compounds that begin with ``dead`` nodes (path, head)."""
    elements = flow.elements.join(dead, ["path", "head"])
    spots = elements.select("path", F.col("at").alias("parent")).unionByName(dead.select("path", F.col("head").alias("parent"))).distinct()
    outer = elements.join(spots, ["path", "parent"], "left_anti")
    # A subshell's commands are within it; a substitution's whose first one is dead are within a dead command.
    shells = elements.where("what = 'shell'").select("path", F.col("at").alias("nest"))
    held = flow.nodes.where("nest >= 0").groupBy("path", "nest").agg(F.min("node").alias("head")).join(dead, ["path", "head"]).select("path", "nest")
    return outer.join(shells.unionByName(held).distinct(), ["path", "nest"], "left_anti").select("path", "line_no", "col").distinct()
