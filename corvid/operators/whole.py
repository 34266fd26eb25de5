"""What holds across whole texts, from what is found in their distinct parts.

Parts follow each other in a row, and whatever leads out of one leads to all that the next is entered at, so a text is a chain of
parts with one spot between each two. Fixpoints run over distinct parts with a node in front and one behind; how far that gets from spot to spot is
a window over the parts of a text. Numbers of nodes and ``places`` are those of ``corvid.operators.parts.numbered``; with those of ``by_lines`` lines take
the place of nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corvid.operators import dataflow
from corvid.operators.copies import distinct_texts, held
from corvid.operators.fixpoint import fixpoint
from corvid.operators.graph import Flow, blocks, dead_nodes, outermost, unreachable_nodes
from corvid.operators.parts import Parts, part_names, states_by_number
from corvid.storage import stored

# Nodes in front of and behind a part, and behind it for what would get there only if ``break`` or ``continue`` went on.
_FRONT, _BEHIND, _LOOSE = -2, 1 << 62, (1 << 62) + 1
# How a part is entered: not at all, at its first node, or at all nodes that a command in front of it leads to.
_LEVELS = (0, 1, 2)
# Links between functions of one text up to which they are followed in one row.
_FEW_LINKS = 32


def by_lines(parts: Parts) -> tuple[DataFrame, DataFrame]:
    """What ``numbered`` gives, with the line of each node for its number."""
    return parts.flow.nodes.select("path", "node", F.col("line_no").alias("number")), parts.places.select("path", "seq", F.col("_text").alias("_part"), F.col("_line").alias("_before"))


def _turns() -> WindowSpec:
    return Window.partitionBy("path").orderBy("seq")


def _in_front(turns: WindowSpec) -> WindowSpec:
    return turns.rowsBetween(Window.unboundedPreceding, -1)


def _near(parts: Parts) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if parts.few else (lambda rows: rows)


def _moved(column: str) -> Column:
    return (F.col(column) + F.col("_before")).cast("int")


def _virtual(flow: Flow, node: int, kind: str) -> DataFrame:
    return flow.nodes.select("path").distinct().select("path", F.lit(node).cast("bigint").alias("node"), F.lit(kind).alias("kind"))


def _inner_roots(flow: Flow) -> DataFrame:
    """Roots wherever the part stands: not what it begins with."""
    return flow.roots.where("kind <> 'file'").join(flow.entries, ["path", "node"], "left_anti").select("path", "node", "kind")


def _leading_out(flow: Flow) -> DataFrame:
    return flow.edges.select("path", "a", "b").unionByName(flow.ends.select("path", F.col("node").alias("a"), F.lit(_BEHIND).cast("bigint").alias("b")))


def framed(flow: Flow) -> Flow:
    """The flow of parts with a node in front, which leads to all that is entered, and one behind."""
    front, behind = _virtual(flow, _FRONT, "file"), _virtual(flow, _BEHIND, "behind")
    edges = _leading_out(flow).unionByName(flow.entries.select("path", F.lit(_FRONT).cast("bigint").alias("a"), F.col("node").alias("b")))
    return flow._replace(
        nodes=stored(flow.nodes.unionByName(front.unionByName(behind), allowMissingColumns=True), "framed-nodes"),
        edges=stored(edges, "framed-edges"),
        roots=stored(_inner_roots(flow).unionByName(front).unionByName(behind), "framed-roots"),
    )


# ---- what is reached


def _entered(flow: Flow, levels: tuple[int, ...]) -> Flow:
    """The flow of parts for each way that they may be entered; path becomes part and level."""
    each = lambda rows: rows.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    keyed = lambda rows: rows.withColumn("path", F.struct(F.col("path").alias("part"), "level")).drop("level")
    first = each(flow.roots.where("kind = 'file'").select("path", "node", "kind")).where("level >= 1")
    beside = each(flow.entries.select("path", "node", F.lit("nest").alias("kind"))).where("level = 2")
    roots = keyed(each(_inner_roots(flow)).unionByName(first).unionByName(beside)).dropDuplicates(["path", "node"])
    behind = _virtual(flow, _BEHIND, "behind").unionByName(_virtual(flow, _LOOSE, "behind"))
    falls = flow.falls.select("path", "a", "b", "name").unionByName(flow.loose.select("path", "a", F.lit(_LOOSE).cast("bigint").alias("b"), "name"))
    return flow._replace(
        nodes=stored(keyed(each(flow.nodes.unionByName(behind, allowMissingColumns=True))), "entered-nodes"),
        edges=stored(keyed(each(_leading_out(flow))), "entered-edges"),
        roots=stored(roots, "entered-roots"),
        falls=keyed(each(falls)),
        elements=keyed(each(flow.elements)),
    )


def _levels(places: DataFrame, flow: Flow, gone: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``places`` with the level that each part is entered at; ``gone`` (path, node) is what isn't reached in ``flow``, which is of ``_entered``.

    Nodes beside the first lead nowhere, so levels 1 and 2 reach the same behind the part.
    """
    left = flow.nodes.where(F.col("node") >= _BEHIND).select("path", "node").join(gone.select("path", "node", F.lit(True).alias("gone")), ["path", "node"], "left")
    out = F.when(F.col("gone").isNotNull(), 0).when(F.col("node") == _BEHIND, 2).otherwise(1)
    got = lambda level: F.coalesce(F.max(F.when(F.col("path.level") == level, out)), F.lit(0))
    outs = left.groupBy(F.col("path.part").alias("_part")).agg(got(0).alias("out0"), got(2).alias("out2"))
    known = places.join(near(stored(outs, "outs")), "_part", "left").na.fill(0, ["out0", "out2"])
    act = F.when(F.col("out0") > 0, True).when(F.col("out2") == 0, False)
    known = known.withColumn("on", F.coalesce(F.last(act, ignorenulls=True).over(_in_front(_turns())), F.lit(True)))
    behind = F.when(F.col("on"), F.greatest("out0", "out2")).otherwise(F.col("out0"))
    return known.withColumn("behind", behind).withColumn("level", F.coalesce(F.lag("behind").over(_turns()), F.lit(2))).drop("out0", "out2", "on", "behind")


def _at_levels(found: DataFrame, level: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = found.withColumns({"_part": F.col("path.part"), "level": F.col("path.level")}).drop("path")
    return level.join(near(stored(rows, "found")), ["_part", "level"])


def unreachable(parts: Parts, numbers: DataFrame, places: DataFrame) -> DataFrame:
    """path and node of what ``graph.unreachable_nodes`` gives for whole texts, by number."""
    near, flow = _near(parts), _entered(parts.flow, (0, 2))
    gone = stored(unreachable_nodes(flow).select("path", "node"), "gone")
    found = gone.withColumn("part", F.col("path.part")).join(numbers.select(F.col("path").alias("part"), "node", "number"), ["part", "node"]).select("path", "number")
    return _at_levels(found, _levels(places, flow, gone, near), near).select("path", _moved("number").alias("node"))


def dead_lines(parts: Parts) -> DataFrame:
    """path, line_no and col of what ``graph.dead_code`` gives for whole texts."""
    near, flow = _near(parts), _entered(parts.flow, _LEVELS)
    gone = dead_nodes(flow)
    found = outermost(flow, gone).select("path", "line_no", "col")
    level = _levels(by_lines(parts)[1], flow, gone.withColumnRenamed("head", "node"), near)
    return _at_levels(found, level, near).select("path", _moved("line_no").alias("line_no"), "col").distinct()


# ---- dominators


def dominators(parts: Parts, numbers: DataFrame, places: DataFrame) -> DataFrame:
    """path, node and dominator of what ``dataflow.dominators`` gives for whole texts, by number.

    Every path to a node runs through all that dominates the spot behind each part in front of it.
    """
    near, flow = _near(parts), parts.flow
    each = lambda rows: rows.withColumn("level", F.explode(F.array(F.lit(1), F.lit(2))))
    keyed = lambda rows: rows.withColumn("path", F.struct(F.col("path").alias("part"), "level")).drop("level")
    front = _virtual(flow, _FRONT, "file")
    nodes = flow.nodes.select("path", "node").unionByName(front.select("path", "node")).unionByName(_virtual(flow, _BEHIND, "behind").select("path", "node"))
    # A text begins at its first node only.
    begun = each(flow.roots.where("kind = 'file'").select("path", "node")).where("level = 1").unionByName(each(flow.entries.select("path", "node")).where("level = 2"))
    edges = keyed(each(_leading_out(flow)).unionByName(begun.select("path", F.lit(_FRONT).cast("bigint").alias("a"), F.col("node").alias("b"), "level")))
    two = flow._replace(nodes=stored(keyed(each(nodes)), "nodes"), edges=stored(edges, "edges"), roots=stored(keyed(each(_inner_roots(flow).unionByName(front))), "roots"))
    pairs = stored(dataflow.dominators(two).where(F.col("dominator") != _FRONT).select("path.part", "path.level", "node", "dominator"), "dominators")
    of = lambda column: numbers.select(F.col("path").alias("part"), F.col("node").alias(column), F.col("number").alias(f"n_{column}"))
    inner = pairs.join(of("node"), ["part", "node"]).join(of("dominator"), ["part", "dominator"]).select(F.col("part").alias("_part"), "level", "n_node", "n_dominator")
    inner = stored(inner, "inner")
    behind = pairs.where(F.col("node") == _BEHIND)
    spine = stored(behind.join(of("dominator"), ["part", "dominator"]).select(F.col("part").alias("_part"), "level", "n_dominator"), "spine")
    passed = behind.where(F.col("dominator") == _BEHIND).select(F.col("part").alias("_part"), "level", F.lit(True).alias("passes"))
    turned = places.select("path", "seq", "_part", "_before", F.when(F.col("seq") == 0, 1).otherwise(2).alias("level"))
    told = turned.join(near(stored(passed, "passed")), ["_part", "level"], "left")
    entered = F.coalesce(F.min(F.col("passes").isNotNull()).over(_in_front(_turns())), F.lit(True))
    live = stored(told.withColumn("entered", entered).where("entered").select("path", "seq", "_part", "_before", "level"), "live")
    own = live.join(near(inner), ["_part", "level"]).select("path", _moved("n_node").alias("node"), _moved("n_dominator").alias("dominator"))
    first = live.select("path", F.col("seq").alias("_seq"), "_part", "level", "_before").join(near(spine), ["_part", "level"]).select("path", "_seq", _moved("n_dominator").alias("dominator"))
    met = near(stored(inner.select("_part", "level", "n_node").distinct(), "met"))
    later = live.join(first, "path").where("_seq < seq").join(met, ["_part", "level"])
    return own.unionByName(later.select("path", _moved("n_node").alias("node"), "dominator"))


# ---- names


def _met(flow: Flow, of: DataFrame, between: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, block, e and f: whether the front, and whether a function's body, leads there; and _part, e0 and f0: whether they lead behind the part. ``flow`` is framed."""
    onward = between.select("path", F.col("a").alias("block"), "b")
    begun = flow.roots.where("kind IN ('file', 'function')").join(of, ["path", "node"]).select("path", "block", F.when(F.col("kind") == "file", "e").otherwise("f").alias("src"))
    found = fixpoint(begun, lambda new: new.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "src"))
    met = stored(found.groupBy("path", "block").agg(*[F.max(F.col("src") == x).alias(x) for x in "ef"]), "met")
    return met, met.where(F.col("block") == _BEHIND).select(F.col("path").alias("_part"), F.col("e").alias("e0"), F.col("f").alias("f0"))


def unused(parts: Parts, numbers: DataFrame, places: DataFrame) -> DataFrame:
    """path, node, name and kind of what ``dataflow.unused`` gives for whole texts, by number.

    A name that is live behind a part is live in front of it, isn't, or is if a read in the part says so. The next part with the name says what holds, unless nothing comes through to it.
    """
    near, flow = _near(parts), framed(parts.flow)
    of, between = blocks(flow)
    met, through = _met(flow, of, between)
    reads, writes = stored(dataflow.reads(parts.tokens, parts.flow), "reads"), stored(dataflow.writes(parts.flow), "writes")
    used = stored(reads.select("path", "name").unionByName(writes.select("path", "name")).distinct(), "used")
    proper = writes.where("kind <> 'declaration'")
    # In a command words are expanded before its names are written.
    marks = reads.select("path", "node", "name").distinct().withColumn("rank", F.lit(0)).unionByName(proper.groupBy("path", "node", "name").agg(F.min(F.when(F.col("append"), 1).otherwise(2)).alias("rank"))).join(of, ["path", "node"])
    w = Window.partitionBy("path", "block", "name").orderBy("node", "rank")
    told = stored(marks.withColumns({"next": F.lead("rank").over(w), "at": F.row_number().over(w)}), "uses")
    kills = told.where("rank = 2").select("path", "block", "name").distinct()
    back = between.select("path", F.col("b").alias("block"), "a")
    seeds = told.where("at = 1 AND rank < 2").select("path", "block", "name", F.lit("r").alias("src")).unionByName(used.select("path", F.lit(_BEHIND).cast("bigint").alias("block"), "name", F.lit("b").alias("src")))
    step = lambda new: new.join(back, ["path", "block"]).select("path", F.col("a").alias("block"), "name", "src").join(kills, ["path", "block", "name"], "left_anti")
    live = stored(fixpoint(seeds, step), "live")
    flags = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.max(F.col("src") == x).alias(x) for x in "rb"])
    out = flags(live.join(back, ["path", "block"]).select("path", F.col("a").alias("block"), "name", "src"), "path", "block", "name")
    fates = told.where("rank > 0").join(out, ["path", "block", "name"], "left").na.fill(False, ["r", "b"]).where("next = 2 OR next IS NULL AND NOT r")
    fates = fates.select("path", "node", "name", (F.col("next").eqNullSafe(2) | ~F.col("b")).alias("always"))
    fated = proper.join(fates, ["path", "node", "name"]).join(numbers, ["path", "node"]).select(F.col("path").alias("_part"), "number", "name", "kind", "always").distinct()
    named = used.join(flags(live.where(F.col("block") == _FRONT), "path", "name"), ["path", "name"], "left").na.fill(False, ["r", "b"]).withColumnRenamed("path", "_part")
    # What functions read, and what is exported, may be read anywhere.
    known = writes.where("kind = 'declaration'").join(flow.nodes.where("name = 'export'").select("path", "node"), ["path", "node"], "left_semi").select("path", "name")
    exported = writes.where("kind = 'export'").select("path", "name").unionByName(known).withColumn("f", F.lit(True))
    far = reads.join(of, ["path", "node"]).join(met, ["path", "block"]).select("path", "name", "f").unionByName(exported)
    far = far.groupBy(F.col("path").alias("_part"), "name").agg(F.max("f").alias("f"))

    turns = _turns()
    known = places.join(near(stored(through, "through")), "_part", "left").na.fill(False, ["e0", "f0"])
    act = F.when(F.col("f0"), True).when(~F.col("e0"), False)
    wall = F.min(F.when(~F.col("e0"), F.col("seq"))).over(turns.rowsBetween(1, Window.unboundedFollowing))
    inside = F.coalesce(F.last(act, ignorenulls=True).over(_in_front(turns)), F.lit(False))
    turned = stored(known.select("path", "seq", "_part", "_before", wall.alias("wall"), inside.alias("inside")), "turned")
    everywhere = turned.join(near(stored(far, "far")), "_part").where("f OR inside").select("path", "name").distinct()
    turn = Window.partitionBy("path", "name").orderBy("seq")
    then = F.lead("seq").over(turn)
    rows = turned.join(near(stored(named, "named")), "_part").withColumn("cut", then.isNull() | F.coalesce(F.col("wall") < then, F.lit(False)))
    rows = rows.withColumn("act", F.when(F.col("r"), True).when(~F.col("b") | F.col("cut"), False))
    behind = ~F.col("cut") & F.coalesce(F.first("act", ignorenulls=True).over(turn.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    dead = rows.select("path", "name", "_part", "_before", behind.alias("behind")).join(near(stored(fated, "fated")), ["_part", "name"]).where("always OR NOT behind")
    return dead.join(everywhere, ["path", "name"], "left_anti").select("path", _moved("number").alias("node"), "name", "kind")


def values(parts: Parts, numbers: DataFrame, places: DataFrame) -> DataFrame:
    """What ``dataflow.values`` gives for whole texts, with numbers of nodes.

    In a part the spot in front of it counts as a write that overwrites nothing, and the one behind it as a read; texts go on from part to part as far as parts with the name let them through.
    """
    near, flow = _near(parts), framed(parts.flow)
    of, between = blocks(flow)
    _, through = _met(flow, of, between)
    names = part_names(parts)
    used = stored(names.reads.select("path", "name").unionByName(names.writes.select("path", "name")).distinct(), "used")
    spot = lambda node: F.lit(node).cast("bigint").alias("node")
    reads = names.reads.select("path", "node", "name", "guarded", "quoted").unionByName(used.select("path", spot(_BEHIND), "name", F.lit(False).alias("guarded"), F.lit(False).alias("quoted")))
    writes = names.writes.select("path", "node", "name", "append", "kind").unionByName(used.select("path", spot(_FRONT), "name", F.lit(True).alias("append"), F.lit("front").alias("kind")))
    reach = dataflow.reaching(dataflow.Names(stored(reads, "reads"), stored(writes, "writes"), of, between, flow)).join(dataflow.plain_texts(names), ["path", "def", "name"], "left")
    texts = F.collect_set(F.when(F.col("def") != _FRONT, F.struct("text"))).alias("texts")
    got = stored(reach.groupBy("path", "node", "name", "guarded").agg(texts, F.max(F.col("def") == _FRONT).alias("far")), "reached")
    leaving = got.where(F.col("node") == _BEHIND).select("path", "name", F.col("texts").alias("left"), F.col("far").alias("passes"))
    named = used.join(leaving, ["path", "name"], "left").na.fill(False, ["passes"]).withColumnRenamed("path", "_part")
    own = names.reads.join(got, ["path", "node", "name", "guarded"], "left").join(numbers, ["path", "node"]).select(F.col("path").alias("_part"), "number", "name", "guarded", "texts", F.coalesce("far", F.lit(False)).alias("far"))

    turns = _turns()
    known = places.join(near(stored(through, "through")), "_part", "left").na.fill(False, ["e0"])
    turned = known.select("path", "seq", "_part", "_before", F.max(F.when(~F.col("e0"), F.col("seq"))).over(_in_front(turns)).alias("wall"))
    turn = Window.partitionBy("path", "name").orderBy("seq")
    last, stops = F.lag("seq").over(turn), (~F.col("passes")).cast("int")
    rows = turned.join(near(stored(named, "named")), "_part").withColumn("cut", (last.isNull() | F.coalesce(F.col("wall") > last, F.lit(False))).cast("int"))
    # Parts between which texts get through share the numbers of walls and stops in front of them.
    rows = rows.withColumns({"walls": F.sum("cut").over(turn), "stops": F.coalesce(F.sum(stops).over(_in_front(turn)), F.lit(0))})
    none = F.lit(None).cast(rows.schema["left"].dataType)
    two = F.array(F.struct(F.lit(0).alias("rank"), F.col("stops").alias("n"), none.alias("given")), F.struct(F.lit(1).alias("rank"), (F.col("stops") + stops).alias("n"), F.col("left").alias("given")))
    events = rows.select("path", "name", "seq", "_part", "_before", "walls", F.explode(two).alias("x")).select("path", "name", "seq", "_part", "_before", "walls", "x.*")
    given = F.flatten(F.collect_set("given").over(_in_front(Window.partitionBy("path", "name", "walls", "n").orderBy("seq", "rank"))))
    rows = events.withColumn("got", given).where("rank = 0").select("path", "name", "_part", "_before", "got").join(near(stored(own, "own")), ["_part", "name"])
    empty = F.array().cast(rows.schema["got"].dataType)
    every = F.concat(F.coalesce("texts", empty), F.when(F.col("far"), F.coalesce("got", empty)).otherwise(empty))
    rows = rows.select("path", _moved("number").alias("node"), "name", "guarded", F.transform(every, lambda x: x["text"]).alias("every"))
    literals, unknown = F.array_sort(F.array_distinct(F.array_compact("every"))), (F.size("every") == 0) | F.exists("every", lambda t: t.isNull())
    rows = rows.select("path", "node", "name", "guarded", literals.alias("literals"), unknown.alias("unknown"))
    return dataflow.judged(states_by_number(names, numbers, places, parts.few).join(rows, ["path", "node", "name", "guarded"]))


# ---- calls


class Calls(NamedTuple):
    """Functions are numbered from 0 by where their bodies begin in the text. ``functions``: path, number and name; ``sites``: path, caller (null for the file) and callee;
    ``places``: path, _part, _start (how many functions begin in front of the part) and _outer (whose body leads into it); ``inner``: path of a part, node and own, the function in the part (-1: _outer)."""

    functions: DataFrame
    sites: DataFrame
    places: DataFrame
    inner: DataFrame


def _function(own: str) -> Column:
    return F.when(F.col(own) >= 0, F.col("_start") + F.col(own)).when(F.col(own) == -1, F.col("_outer"))


def calls(parts: Parts) -> Calls:
    """What ``dataflow.call_sites`` gives for whole texts, with numbers of functions."""
    near, flow = _near(parts), framed(parts.flow)
    front = _virtual(flow, _FRONT, "").select("path", F.col("node").alias("root"))
    roots = flow.functions.select("path", "root").distinct()
    numbers = roots.withColumn("own", F.row_number().over(Window.partitionBy("path").orderBy("root")) - 1).unionByName(front.withColumn("own", F.lit(-1)))
    numbers = stored(numbers, "roots")
    found = dataflow.regions(flow._replace(functions=flow.functions.select("path", "root").unionByName(front)))
    inner = stored(found.join(numbers, ["path", "root"]).select("path", "node", "own"), "regions")
    sizes = numbers.where("own >= 0").groupBy(F.col("path").alias("_part")).agg(F.count("*").cast("int").alias("size"))
    leads = inner.where(F.col("node") == _BEHIND).select(F.col("path").alias("_part"), F.col("own").alias("leads"))
    before = _in_front(_turns())
    known = parts.places.select("path", "seq", "_at", F.col("_text").alias("_part")).join(near(stored(sizes, "sizes")), "_part", "left").join(near(stored(leads, "leads")), "_part", "left")
    known = known.withColumn("_start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int"))
    # Behind a part the function goes on whose body leads there, the one in front of the part, or none.
    goes = F.when(F.col("leads").isNull(), F.struct(F.lit(None).cast("int").alias("of"))).when(F.col("leads") >= 0, F.struct((F.col("_start") + F.col("leads")).alias("of")))
    places = stored(known.withColumn("_outer", F.last(goes, ignorenulls=True).over(before)["of"]).select("path", "_part", "_at", "_start", "_outer"), "turned")

    named = stored(parts.flow.functions.join(numbers, ["path", "root"]).select(F.col("path").alias("_part"), "name", "named", "own"), "named")
    said = parts.flow.nodes.where("kind = 'simple' AND head IS NULL AND name IS NOT NULL").select("path", "node", "name").join(parts.flow.functions.select("path", F.col("named").alias("node")), ["path", "node"], "left_anti")
    said = said.join(named.select("name").distinct(), "name", "left_semi").join(inner, ["path", "node"], "left").select(F.col("path").alias("_part"), "node", "name", "own")
    functions = places.join(near(named), "_part").select("path", _function("own").alias("number"), "name", (F.col("named") + F.col("_at")).alias("at"))
    sites = places.join(near(stored(said, "said")), "_part").select("path", "name", (F.col("node") + F.col("_at")).alias("at"), _function("own").alias("caller"))
    both = functions.withColumns({"caller": F.lit(None).cast("int"), "site": F.lit(False)}).unionByName(sites.withColumns({"number": F.lit(None).cast("int"), "site": F.lit(True)}))
    turn = Window.partitionBy("path", "name").orderBy("at", "site")
    callee = F.coalesce(F.last("number", ignorenulls=True).over(_in_front(turn)), F.first("number", ignorenulls=True).over(turn.rowsBetween(1, Window.unboundedFollowing)))
    sites = both.withColumn("callee", callee).where("site AND callee IS NOT NULL").select("path", "caller", "callee")
    return Calls(functions.select("path", "number", "name"), sites, places, inner)


def called(found: Calls) -> tuple[DataFrame, DataFrame]:
    """What ``dataflow.components`` gives for the calls of whole texts, by numbers of functions: texts whose functions call each other alike are looked into once."""
    links = found.sites.where("caller IS NOT NULL").select("path", F.col("caller").alias("a"), F.col("callee").alias("b"))
    graphs = links.groupBy("path").agg(F.to_json(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("content"))
    copies = distinct_texts(stored(graphs, "graphs"), once=True)
    links = copies.texts.select("path", F.from_json("content", "array<struct<a:int,b:int>>").alias("links"))
    # Few links are followed within their row; of more, the closure doubles by joins.
    few = links.where(F.size("links") <= _FEW_LINKS)
    further = lambda known, _: F.array_distinct(F.concat(known, F.flatten(F.transform("links", lambda x: F.transform(F.filter(known, lambda k: k["a"] == x["b"]), lambda k: F.struct(x["a"].alias("a"), k["b"].alias("b")))))))
    few = few.select("path", F.aggregate(F.sequence(F.lit(1), F.size("links")), F.col("links"), further).alias("known"))
    nodes = F.array_distinct(F.flatten(F.transform("known", lambda k: F.array(k["a"], k["b"]))))
    back = lambda n: F.filter("known", lambda k: (k["a"] == n) & F.array_contains("known", F.struct(k["b"].alias("a"), k["a"].alias("b"))))
    least = F.transform(nodes, lambda n: F.struct(n.alias("node"), F.array_min(F.concat(F.array(n), F.transform(back(n), lambda k: k["b"]))).alias("component")))
    few = stored(few.select("path", "known", least.alias("components")), "closed")
    reach, components = few.select("path", F.explode("known").alias("x")).select("path", "x.*"), few.select("path", F.explode("components").alias("x")).select("path", "x.*")
    many = links.where(F.size("links") > _FEW_LINKS)
    if not many.isEmpty():
        more = dataflow.components(many.select("path", F.explode("links").alias("x")).select("path", "x.*"), ["path"])
        reach, components = reach.unionByName(more[0]), components.unionByName(more[1])
    return held(reach, copies), held(components, copies)


def scope_reads(parts: Parts, found: Calls) -> DataFrame:
    """path, function and name of what ``dataflow.scope_reads`` gives for whole texts, by numbers of functions."""
    near = _near(parts)
    reads = dataflow.reads(parts.tokens, parts.flow).join(found.inner, ["path", "node"]).select(F.col("path").alias("_part"), "own", "name").distinct()
    own = found.places.join(near(stored(reads, "reads")), "_part").select("path", _function("own").alias("function"), "name").where("function IS NOT NULL").distinct()
    own = stored(own, "own")
    reach, _ = called(found)
    through = reach.join(own.withColumnRenamed("function", "b"), ["path", "b"]).select("path", F.col("a").alias("function"), "name")
    return own.unionByName(through).distinct()
