"""What holds of names on the flow graph: written on some path, on every path, read again; and who dominates whom.

Fixpoints run over blocks (``corvid.operators.graph.blocks``), so they take as many rounds as there are branches; what
happens within a block is windows over its nodes. What must hold on every path is the greatest fixpoint, found by
deletion: all candidates stand until a path shows one to be wrong, and only what was deleted last looks for more.

A path begins at the root of its region: the file, or a function's body, where every name that is only written
outside counts as written, since its callers may have done so.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.fixpoint import fixpoint
from corvid.operators.graph import Flow, blocks
from corvid.storage import stored

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
# Commands whose operands are names that they write.
_DECLARING = ("export", "local", "declare", "typeset", "readonly")
_SETTING = ("read", "getopts", "mapfile", "readarray")


class Names(NamedTuple):
    """``reads``: path, node, name, guarded, quoted; ``writes``: path, node, name, append, kind; ``of``: path, node, block; ``between``: path, a, b of blocks; ``flow``."""

    reads: DataFrame
    writes: DataFrame
    of: DataFrame
    between: DataFrame
    flow: Flow


def reads(tokens: DataFrame, flow: Flow) -> DataFrame:
    """path, node, name, guarded (by a default) and quoted of each distinct read; single quotes hide names.

    Bodies of here-documents are read by the command before them.
    """
    # A word in parts: single quotes go, double quotes are told apart from the rest.
    plain = F.regexp_replace("text", r"(?<!\\)\$?'[^']*+'", "")
    bare = F.regexp_replace(plain, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', " ")
    words = tokens.where("kind IN ('word', 'pattern', 'body')").select("path", "nest", "at", F.when(F.col("kind") == "body", F.col("text")).otherwise(plain).alias("whole"), F.when(F.col("kind") == "body", "").otherwise(bare).alias("bare"))
    names = lambda column, pattern: F.regexp_extract_all(column, F.lit(pattern), F.lit(1))
    kinds = ((rf"(?<!\\)\$({_NAME})", False), (rf"\$\{{[#!]?({_NAME})(?!(?:\[[^\]]*\])?:?[-=?+])(?![A-Za-z0-9_])", False), (rf"\$\{{({_NAME})(?:\[[^\]]*\])?:?[-=?+]", True))
    # Names alone in sums.
    sums = F.flatten(F.transform(F.regexp_extract_all("whole", F.lit(r"\(\((.*?)\)\)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(rf"(?<![$A-Za-z0-9_{{])({_NAME})"), F.lit(1))))
    told = lambda found, guarded, quoted: F.transform(found, lambda n: F.struct(n.alias("name"), F.lit(guarded).alias("guarded"), F.lit(quoted).alias("quoted")))
    listed = F.concat(*[told(names(column, p), g, column == "whole") for column in ("whole", "bare") for p, g in kinds], told(sums, False, True))
    found = words.select("path", "nest", "at", F.explode(listed).alias("r")).select("path", "nest", "at", "r.*").groupBy("path", "nest", "at", "name", "guarded").agg(F.min("quoted").alias("quoted"))
    return _at_nodes(found, flow).select("path", "node", "name", "guarded", "quoted").groupBy("path", "node", "name", "guarded").agg(F.min("quoted").alias("quoted"))


def _at_nodes(found: DataFrame, flow: Flow) -> DataFrame:
    """``found`` (path, nest, at) with the node that each is part of: the last one of its nest that begins at or before it.

    The words of an array belong to the command of their array.
    """
    spots = found.select("path", "nest", "at").distinct()
    nodes = flow.nodes.where("kind = 'simple'").select("path", "nest", F.col("node").alias("at"), F.lit(0).alias("rank"), "node")
    both = nodes.unionByName(spots.select("path", "nest", "at", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("node")))
    w = Window.partitionBy("path", "nest").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("of", F.last("node", ignorenulls=True).over(w)).where("rank = 1").select("path", "nest", "at", F.col("of").alias("node"))
    lost = near.where("node IS NULL").select("path", "nest", "at")
    every = flow.nodes.where("kind = 'simple'").select("path", F.col("node").alias("at"), F.lit(0).alias("rank"), "node", F.lit(None).cast("bigint").alias("nest"))
    wide = Window.partitionBy("path").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = every.unionByName(lost.select("path", "at", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("node"), "nest")).withColumn("of", F.last("node", ignorenulls=True).over(wide)).where("rank = 1").select("path", "nest", "at", F.col("of").alias("node"))
    return found.join(near.where("node IS NOT NULL").unionByName(other.where("node IS NOT NULL")), ["path", "nest", "at"])


def writes(flow: Flow) -> DataFrame:
    """path, node, name, append and kind (assignment, loop, declaration, or the command that writes) of each write.

    A declaration without a value writes nothing, but the name is known from there on.
    """
    simple = flow.nodes.where("kind = 'simple'")
    assigned = simple.select("path", "node", F.explode("assigned").alias("word"), F.lit("assignment").alias("kind"))
    # An assignment in front of a command is that command's only.
    assigned = assigned.join(simple.where("name IS NULL").select("path", "node"), ["path", "node"])
    declared = simple.where(F.col("name").isin(*_DECLARING)).select("path", "node", F.explode("args").alias("word"), F.col("name").alias("kind")).where(F.col("word").rlike(rf"^{_NAME}(\[[^\]]*\])?\+?="))
    named = simple.where(F.col("name").isin(*_DECLARING)).select("path", "node", F.explode(F.filter("args", lambda a: a.rlike(rf"^{_NAME}$"))).alias("name"), F.lit(True).alias("append"), F.lit("declaration").alias("kind"))
    both = assigned.unionByName(declared).select("path", "node", F.regexp_extract("word", rf"^({_NAME})", 1).alias("name"), F.col("word").rlike(rf"^{_NAME}(\[[^\]]*\])?\+=|^{_NAME}\[").alias("append"), "kind")
    operands = F.filter("args", lambda a: a.rlike(rf"^{_NAME}$"))
    read = simple.where(F.col("name").isin(*_SETTING)).select("path", "node", F.explode(operands).alias("name"), F.lit(False).alias("append"), F.col("name").alias("kind"))
    printed = simple.where("name = 'printf' AND get(args, 0) = '-v'").select("path", "node", F.get("args", F.lit(1)).alias("name"), F.lit(False).alias("append"), F.lit("printf").alias("kind"))
    loops = simple.where("head IN ('for', 'select')").where(F.col("name").rlike(rf"^{_NAME}$")).select("path", "node", "name", F.lit(False).alias("append"), F.lit("loop").alias("kind"))
    return both.unionByName(read).unionByName(printed).unionByName(loops).unionByName(named)


def names_of(tokens: DataFrame, flow: Flow) -> Names:
    of, between = blocks(flow)
    return Names(stored(reads(tokens, flow), "reads"), stored(writes(flow), "writes"), of, between, flow)


def _deleted(gone: DataFrame, between: DataFrame, keeps: DataFrame) -> DataFrame:
    """Everything that deletion takes: from (path, block, name) in ``gone`` on to the next blocks, unless the block is in ``keeps``."""
    passes = between.select("path", F.col("a").alias("block"), "b")
    step = lambda new: new.join(keeps, ["path", "block", "name"], "left_anti").join(passes, ["path", "block"]).select("path", F.col("b").alias("block"), "name")
    return fixpoint(gone, step)


def states(names: Names) -> DataFrame:
    """path, node, name, guarded, quoted, may and must of each read: whether some, and whether every, path to it writes the name.

    Reads that nothing reaches hold on every path and on none.
    """
    of, flow = names.of, names.flow
    wanted = names.reads.select("path", "name").distinct()
    written = names.writes.join(wanted, ["path", "name"], "left_semi").join(of, ["path", "node"])
    keeps = stored(written.select("path", "block", "name").distinct(), "written-blocks")
    starts = flow.roots.where("kind <> 'function'").join(of, ["path", "node"]).select("path", "block").distinct()
    # In a function a name may come from its callers, if the file writes it anywhere outside of functions or in another.
    bodies = flow.roots.where("kind = 'function'").join(of, ["path", "node"]).select("path", "block").distinct()
    unknown = wanted.join(names.writes.select("path", "name").distinct(), ["path", "name"], "left_anti")
    unset = stored(_deleted(starts.join(wanted, "path").unionByName(bodies.join(unknown, "path")), names.between, keeps), "unset")
    elsewhere = wanted.join(unknown, ["path", "name"], "left_anti")
    onward = names.between.select("path", F.col("a").alias("block"), "b")
    begun = keeps.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name").unionByName(bodies.join(elsewhere, "path"))
    spread = lambda new: new.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name")
    may = fixpoint(begun, spread)
    # Within the block: the last write before the read.
    marks = names.reads.select("path", "node", "name", "guarded", "quoted", F.lit(0).alias("rank")).unionByName(written.select("path", "node", "name", F.lit(None).cast("boolean").alias("guarded"), F.lit(None).cast("boolean").alias("quoted"), F.lit(1).alias("rank")).distinct())
    before = Window.partitionBy("path", "block", "name").orderBy("node", "rank").rowsBetween(Window.unboundedPreceding, -1)
    own = marks.join(of, ["path", "node"]).withColumn("own", F.coalesce(F.max("rank").over(before), F.lit(0)) > 0).where("rank = 0")
    joined = own.join(unset.withColumn("open", F.lit(True)), ["path", "block", "name"], "left").join(may.withColumn("some", F.lit(True)), ["path", "block", "name"], "left")
    return joined.select("path", "node", "name", "guarded", "quoted", (F.col("own") | F.col("some").isNotNull()).alias("may"), (F.col("own") | F.col("open").isNull()).alias("must"))


class Spread(NamedTuple):
    """How far a graph's sources get in it, if more may be in front of it and behind it.

    ``reads``: path, node, name, guarded, quoted, own (written before it in its block), and from where the read is met: ``e``, ``o``, ``f`` with no write on the way,
    from an entry, another root or a function's body; ``w`` from a write; ``e0``, ``f0`` by any way. ``names``: path, name, written, and the same letters for
    what leads out at the end. ``through``: path, e0, o0, f0: what leads out, whatever is written."""

    reads: DataFrame
    names: DataFrame
    through: DataFrame


def spread(names: Names) -> Spread:
    of, flow = names.of, names.flow
    entries = flow.entries.join(of, ["path", "node"]).select("path", "block", F.lit("e").alias("src"))
    roots = flow.roots.where("kind <> 'file'").join(flow.entries, ["path", "node"], "left_anti").join(of, ["path", "node"])
    begun = entries.unionByName(roots.select("path", "block", F.when(F.col("kind") == "function", "f").otherwise("o").alias("src"))).distinct()
    # The empty name is never written: it shows what is reached at all.
    used = stored(names.reads.select("path", "name").unionByName(names.writes.select("path", "name")).distinct(), "used")
    wanted = used.unionByName(of.select("path", F.lit("").alias("name")).distinct())
    written = names.writes.select("path", "node", "name").distinct().join(of, ["path", "node"])
    keeps = stored(written.select("path", "block", "name").distinct(), "written-blocks")
    onward = names.between.select("path", F.col("a").alias("block"), "b")
    seeds = begun.join(wanted, "path").select("path", "block", "name", "src").unionByName(keeps.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name", F.lit("w").alias("src")))
    kept = keeps.withColumn("kept", F.lit(True))
    step = lambda new: new.join(kept, ["path", "block", "name"], "left").where("kept IS NULL OR src = 'w'").join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name", "src")
    flag = lambda src: F.coalesce(F.max(F.col("src") == src), F.lit(False)).alias(src)
    met = stored(fixpoint(seeds, step).groupBy("path", "block", "name").agg(*[flag(src) for src in "eofw"]), "met")
    bare = met.where("name = ''").select("path", "block", *[F.col(x).alias(f"{x}0") for x in "eof"])
    # Within the block: the last write before a read, or up to and with the node that leads out.
    none = F.lit(None).cast("boolean")
    marks = names.reads.select("path", "node", "name", "guarded", "quoted", F.lit(0).alias("rank"))
    marks = marks.unionByName(written.select("path", "node", "name", none.alias("guarded"), none.alias("quoted"), F.lit(1).alias("rank")))
    marks = marks.unionByName(flow.ends.join(wanted, "path").select("path", "node", "name", none.alias("guarded"), none.alias("quoted"), F.lit(2).alias("rank")))
    before = Window.partitionBy("path", "block", "name").orderBy("node", "rank").rowsBetween(Window.unboundedPreceding, -1)
    told = marks.join(of, ["path", "node"]).withColumn("own", F.coalesce(F.max((F.col("rank") == 1).cast("int")).over(before), F.lit(0)) > 0).where("rank <> 1")
    told = told.join(met, ["path", "block", "name"], "left").join(bare, ["path", "block"], "left").na.fill(False, ["e", "o", "f", "w", "e0", "o0", "f0"])
    told = stored(told, "told")
    ends = told.where("rank = 2")
    through = ends.where("name = ''").groupBy("path").agg(*[F.max(x).alias(x) for x in ("e0", "o0", "f0")])
    open_ = ends.where("name <> ''").groupBy("path", "name").agg(*[F.max(F.col(x) & ~F.col("own")).alias(x) for x in "eof"], F.max(F.col("w") | F.col("own")).alias("w"))
    marked = used.join(names.writes.select("path", "name", F.lit(True).alias("written")).distinct(), ["path", "name"], "left").join(open_, ["path", "name"], "left")
    reads = told.where("rank = 0").select("path", "node", "name", "guarded", "quoted", "own", "e", "o", "f", "w", "e0", "f0")
    return Spread(reads, marked.na.fill(False, ["written", "e", "o", "f", "w"]), through)


def unused(names: Names) -> DataFrame:
    """path, node, name and kind of writes that no path reads again before another write, or the end, comes.

    An append reads what it extends and keeps it alive. What functions read may be read wherever they are called, so
    it counts as read everywhere; exported names are read outside.
    """
    of, flow = names.of, names.flow
    inside = flow.roots.where("kind = 'function'").join(of, ["path", "node"]).select("path", "block").distinct()
    onward = names.between.select("path", F.col("a").alias("block"), F.col("b"))
    body = fixpoint(inside, lambda new: new.join(onward, ["path", "block"]).select("path", F.col("b").alias("block")))
    known = names.writes.where("kind = 'declaration'").join(flow.nodes.where("name = 'export'").select("path", "node"), ["path", "node"], "left_semi").select("path", "name")
    far = names.reads.join(of, ["path", "node"]).join(body, ["path", "block"], "left_semi").select("path", "name").unionByName(names.writes.where("kind = 'export'").select("path", "name")).unionByName(known).distinct()
    writes = names.writes.where("kind <> 'declaration'").join(far, ["path", "name"], "left_anti")
    uses = names.reads.select("path", "node", "name").distinct().join(writes.select("path", "name").distinct(), ["path", "name"], "left_semi")
    # In a command words are expanded before its names are written.
    marks = uses.withColumn("rank", F.lit(0)).unionByName(writes.groupBy("path", "node", "name").agg(F.min(F.when(F.col("append"), 1).otherwise(2)).alias("rank"))).join(of, ["path", "node"])
    w = Window.partitionBy("path", "block", "name").orderBy("node", "rank")
    told = stored(marks.withColumns({"next": F.lead("rank").over(w), "at": F.row_number().over(w)}), "uses")
    first_use = told.where("at = 1 AND rank < 2").select("path", "block", "name")
    kills = told.where("rank = 2").select("path", "block", "name").distinct()
    back = names.between.select("path", F.col("b").alias("block"), F.col("a"))
    # Live at the entry of a block: its first use is a read, or it is live behind it and not killed.
    step = lambda new: new.join(back, ["path", "block"]).select("path", F.col("a").alias("block"), "name").join(kills, ["path", "block", "name"], "left_anti")
    live = stored(fixpoint(first_use, step), "live")
    out = live.join(back, ["path", "block"]).select("path", F.col("a").alias("block"), "name").distinct().withColumn("out", F.lit(True))
    dead = told.where("rank > 0").join(out, ["path", "block", "name"], "left").where("next = 2 OR next IS NULL AND out IS NULL").select("path", "node", "name")
    return writes.join(dead, ["path", "node", "name"], "left_semi").select("path", "node", "name", "kind").distinct()


def reaching(names: Names) -> DataFrame:
    """path, node, name, quoted, guarded and def of each read and each write that may reach it; ``def`` is the node that writes."""
    of = names.of
    wanted = names.reads.select("path", "name").distinct()
    written = stored(names.writes.where("kind <> 'declaration'").join(wanted, ["path", "name"], "left_semi").groupBy("path", "node", "name").agg(F.min("append").alias("append")).join(of, ["path", "node"]), "written")
    later = Window.partitionBy("path", "block", "name").orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    leaves = written.withColumn("again", F.max((~F.col("append")).cast("int")).over(later)).where("again IS NULL OR again = 0")
    kills = written.where("NOT append").select("path", "block", "name").distinct()
    onward = names.between.select("path", F.col("a").alias("block"), "b")
    seed = leaves.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name", F.col("node").alias("def"))
    step = lambda new: new.join(kills, ["path", "block", "name"], "left_anti").join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "name", "def")
    entry = stored(fixpoint(seed, step), "reaching")
    uses = names.reads.join(of, ["path", "node"])
    # Within the block: the writes before the read, from the last one that overwrites on.
    own = uses.join(written.select("path", "block", "name", F.col("node").alias("def"), "append"), ["path", "block", "name"]).where("def < node")
    last = Window.partitionBy("path", "node", "name", "guarded")
    own = own.withColumn("from", F.max(F.when(~F.col("append"), F.col("def"))).over(last)).where("from IS NULL OR def >= from")
    cut = own.where("from IS NOT NULL").select("path", "node", "name", "guarded").distinct()
    far = uses.join(cut, ["path", "node", "name", "guarded"], "left_anti").join(entry, ["path", "block", "name"])
    keep = ["path", "node", "name", "quoted", "guarded", "def"]
    return own.select(*keep).unionByName(far.select(*keep)).distinct()


def plain_texts(names: Names) -> DataFrame:
    """path, def, name and text of each write that gives a name a plain text."""
    said = names.flow.nodes.where("kind = 'simple'").select("path", F.col("node").alias("def"), F.explode(F.concat(F.coalesce("assigned", F.array().cast("array<string>")), F.coalesce("args", F.array().cast("array<string>")))).alias("word"))
    texts = said.select("path", "def", F.regexp_extract("word", rf"^({_NAME})=", 1).alias("name"), F.regexp_extract("word", rf"(?s)^{_NAME}=(.*)$", 1).alias("text")).where("name <> ''")
    plain = F.col("text").rlike(r"^([^\s$`\x22\x27\\*?\[~(]*|\x22[^$`\x22\\]*+\x22|\x27[^\x27]*+\x27)$")
    known = texts.where(plain).select("path", "def", "name", F.regexp_replace("text", r"^[\x22\x27]|[\x22\x27]$", "").alias("text"))
    once = names.writes.where("NOT append").select("path", F.col("node").alias("def"), "name").distinct()
    return known.join(once, ["path", "def", "name"])


def values(names: Names) -> DataFrame:
    """path, node, name, quoted, literals, open and splits of each read.

    ``literals`` are the texts that it may have from assignments of plain text, sorted; ``open`` says that some path gives it
    another value, or none that the file knows of. ``splits``: unquoted, it may come apart at blanks or match file names.
    """
    reach = reaching(names).join(plain_texts(names), ["path", "def", "name"], "left")
    got = reach.groupBy("path", "node", "name", "guarded").agg(F.array_sort(F.collect_set("text")).alias("literals"), F.max(F.col("text").isNull()).alias("unknown"))
    return judged(states(names).join(got, ["path", "node", "name", "guarded"], "left"))


def judged(whole: DataFrame) -> DataFrame:
    """What ``values`` gives of ``states`` with ``literals``, and ``unknown`` if some value isn't one of them."""
    literals = F.coalesce("literals", F.array().cast("array<string>"))
    open_ = ~F.col("must") | F.coalesce("unknown", F.lit(True))
    splits = ~F.col("quoted") & (open_ | F.exists(literals, lambda t: t.rlike(r"[\s*?\[]") | (t == "")))
    return whole.select("path", "node", "name", "quoted", "guarded", literals.alias("literals"), open_.alias("open"), splits.alias("splits"))


def dominators(flow: Flow) -> DataFrame:
    """path, node and dominator: nodes that every path from the file's root to ``node`` runs through, itself among them.

    By deletion over blocks: each block stands for all candidates until a path comes by without one. Pairs of blocks are
    expanded to nodes only for those that dominate.
    """
    of, between = blocks(flow)
    roots = flow.roots.where("kind = 'file'").join(of, ["path", "node"]).select("path", F.col("block")).distinct()
    onward = between.select("path", F.col("a").alias("block"), "b")
    reached = stored(fixpoint(roots, lambda new: new.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"))), "reached")
    candidates = reached.select("path", F.col("block").alias("by"))
    # (block, by) is gone once some path to the block avoids ``by``.
    gone = roots.join(candidates, "path").where("block <> by")
    inside = onward.join(reached, ["path", "block"], "left_semi")
    avoids = fixpoint(gone, lambda new: new.join(inside, ["path", "block"]).where("b <> by").select("path", F.col("b").alias("block"), "by"))
    pairs = reached.join(candidates, "path").join(avoids, ["path", "block", "by"], "left_anti")
    a = of.select("path", F.col("block").alias("by"), F.col("node").alias("dominator"))
    nodes = pairs.join(of, ["path", "block"]).join(a, ["path", "by"])
    return nodes.where("block <> by OR dominator <= node").select("path", "node", "dominator")


# ---- calls


def call_sites(flow: Flow) -> DataFrame:
    """path, node, name, caller and callee of each call of a function of its file; caller and callee are roots of bodies, a null caller is the file.

    Which of several definitions a call sees is the last one in front of it, else the first one behind it.
    """
    defined = flow.functions.select("path", "name", "named", F.col("root").alias("callee"))
    heads = defined.select("path", F.col("named").alias("node"))
    sites = flow.nodes.where("kind = 'simple' AND head IS NULL AND name IS NOT NULL").select("path", "node", "name").join(heads, ["path", "node"], "left_anti")
    seen = sites.join(defined, ["path", "name"]).groupBy("path", "node", "name").agg(F.max_by("callee", F.when(F.col("named") < F.col("node"), F.col("named"))).alias("before"), F.min_by("callee", "named").alias("first"))
    inside = regions(flow)
    return seen.join(inside, ["path", "node"], "left").select("path", "node", "name", F.col("root").alias("caller"), F.coalesce("before", "first").alias("callee"))


def regions(flow: Flow) -> DataFrame:
    """path, node and root of the nodes of functions: the root of the body that each is in, the innermost."""
    bodies = flow.functions.select("path", F.col("root").alias("node"))
    of, between = blocks(flow)
    seeds = bodies.join(of, ["path", "node"]).select("path", "block", F.col("node").alias("root"))
    onward = between.select("path", F.col("a").alias("block"), "b")
    step = lambda new: new.join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "root")
    found = fixpoint(seeds, step)
    return of.join(found, ["path", "block"]).groupBy("path", "node").agg(F.max("root").alias("root"))


def components(links: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, a and b of everything that links lead to, and keys, node and component of each node: those that lead to each other share one.

    The closure doubles in each round, so a chain of calls takes the logarithm of its length. A component is
    named after its least node.
    """
    known = stored(links.select(*keys, "a", "b").distinct(), "closure")
    while True:
        on = known.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        new = stored(known.join(on, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")).distinct().join(known, [*keys, "a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            break
        known = stored(known.unionByName(new), "closure")
    back = known.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    both = known.join(back, [*keys, "a", "b"], "left_semi")
    nodes = links.select(*keys, F.col("a").alias("node")).unionByName(links.select(*keys, F.col("b").alias("node"))).distinct()
    own = nodes.select(*keys, F.col("node").alias("a"), F.col("node").alias("b")).unionByName(both.select(*keys, "a", "b"))
    return known, own.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("component"))


def scope_reads(names: Names, sites: DataFrame) -> DataFrame:
    """path, root and name of what each function may read, itself or through what it calls, however they call each other."""
    own = names.reads.join(regions(names.flow), ["path", "node"]).select("path", "root", "name").distinct()
    links = sites.where("caller IS NOT NULL").select("path", F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    reach, _ = components(links, ["path"])
    through = reach.join(own.withColumnRenamed("root", "b"), ["path", "b"]).select("path", F.col("a").alias("root"), "name")
    return own.unionByName(through).distinct()


def provided(names: Names, sites: DataFrame) -> DataFrame:
    """path, root and name of what each function has written whichever way it comes to its end.

    Calls provide what their functions do. Rounds go up the graph of calls from those that call none, until no
    function provides more; functions that call each other provide what they would if the inner call gave nothing. A function that never
    comes to its end provides nothing.
    """
    flow, of = names.flow, names.of
    inside = stored(regions(flow), "regions")
    in_function = of.join(inside, ["path", "node"]).select("path", "block", "root").distinct()
    ends = flow.nodes.select("path", "node", "name", "kind", "head").join(inside, ["path", "node"])
    leads = flow.edges.select("path", F.col("a").alias("node")).distinct()
    exits = stored(ends.where("NOT (kind = 'simple' AND head IS NULL AND name <=> 'exit')").join(leads, ["path", "node"], "left_anti").join(of, ["path", "node"]).select("path", "block", "root").distinct(), "exits")
    own = names.writes.where("kind <> 'declaration' AND kind <> 'local'").select("path", "node", "name")
    calls = sites.select("path", "node", F.col("callee").alias("root"))
    seeds = flow.functions.select("path", F.col("root").alias("node")).join(of, ["path", "node"]).select("path", "block", F.col("node").alias("root"))
    onward = names.between.select("path", F.col("a").alias("block"), "b")
    have, n = None, -1
    while True:
        written = own if have is None else own.unionByName(calls.join(have, ["path", "root"]).select("path", "node", "name"))
        blocks_of = stored(written.join(of, ["path", "node"]).select("path", "block", "name").distinct(), "writing")
        candidates = stored(blocks_of.join(in_function, ["path", "block"]).select("path", "root", "name").distinct(), "candidates")
        gone = seeds.join(candidates, ["path", "root"]).select("path", "block", "root", "name")
        step = lambda new: new.join(blocks_of, ["path", "block", "name"], "left_anti").join(onward, ["path", "block"]).select("path", F.col("b").alias("block"), "root", "name")  # noqa: E731, B023
        avoided = fixpoint(gone, step).join(blocks_of, ["path", "block", "name"], "left_anti")
        open_ = avoided.join(exits, ["path", "block", "root"]).select("path", "root", "name").distinct()
        ending = exits.select("path", "root").distinct()
        have = stored(candidates.join(ending, ["path", "root"], "left_semi").join(open_, ["path", "root", "name"], "left_anti"), "provided")
        m = have.count()
        if m == n:
            return have
        n = m
