"""The flow of a script from those of its parts, of which each distinct one is analysed once.

A script is cut at line breaks between commands, where nothing is open. Scripts that all differ are mostly made of
the same parts, so the flow graph is laid out for distinct parts only; in a script it's moved to where the part begins,
and what may come last in one part leads to what the next one begins with. What holds across a whole script (what is reached, dominators,
names on paths) is found on the joined graph.

Where it isn't certain that a part means alone what it does in its script, there is no cut: a script with keywords
that match nothing is one part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.lexer import tokens, tokens_of
from corvid.operators import dataflow
from corvid.operators.copies import distinct_texts
from corvid.operators.graph import Flow, blocks, flow_graph
from corvid.operators.scopes import CLOSERS, DIVIDERS, LOOPS, OPENERS
from corvid.storage import stored

# Tokens of all distinct parts up to which what is found in them may be sent to all executors.
_FEW = 200_000
# Characters of lines, or of several, up to which what was found in them is kept by a worker.
_SHORT = 400
# What Python takes for ends of lines besides the line feed.
_ODD_BREAKS = re.compile(r"[\r\v\f\x1c-\x1e]")
_CLOSED_BY = {"if": "fi", "case": "esac", "{": "}"} | dict.fromkeys(LOOPS, "done")


class _Cut(NamedTuple):
    """Of lines that begin with nothing open: where further parts begin (None if keywords match nothing), the line of the first command's
    first token if it begins one (else -1), whether there is any token, whether one is never closed, and whether a part may begin behind them."""

    starts: tuple[int, ...] | None
    first: int
    said: bool
    unclosed: bool
    whole: bool


def _cut(text: str) -> _Cut:
    starts, opened, test, subject, last = [], [], False, 0, ""
    front, second, broken = ("operator", "\n"), ("operator", "\n"), False
    first, seen, found, arms = -1, False, tokens_of(text), False
    unclosed = any(stop is None for _, stop, _, _, _ in found)
    for at, _, nest, kind, said in found:
        if nest != -1 or kind in ("comment", "body") or kind == "nest" and said != "(":
            continue
        if kind == "operator" and said == "\n":
            broken = front[0] not in ("operator", "redirect") and (front[0] != "keyword" or front[1] in CLOSERS)
            continue
        begins = kind in ("word", "redirect", "nest") or kind == "keyword" and said in OPENERS
        # The lexer's own memory of a line must be empty as well: open tests, subjects of ``case``, names of functions.
        if broken and begins and not opened and not test and subject == 0 and last != "function" and second != ("keyword", "function"):
            starts.append(text.rfind("\n", 0, at) + 1)
        if begins and not seen:
            first = text.rfind("\n", 0, at) + 1
        seen = True
        # Arms of no open ``case``: from here on words may be patterns.
        arms = arms or (kind, said) == ("keyword", "in") and opened[-1:] != ["esac"]
        if kind == "keyword" and said in OPENERS:
            opened.append(_CLOSED_BY[said])
        elif kind == "keyword" and said in CLOSERS:
            if not opened or opened.pop() != said:
                return _Cut(None, first, seen, unclosed, False)
        elif kind == "keyword" and said in DIVIDERS and not opened:
            return _Cut(None, first, seen, unclosed, False)
        if kind in ("word", "keyword", "pattern") and not re.fullmatch(r"&&|\|\||[<>()]", said):
            subject, last = max(0, (3 if (kind, said) == ("keyword", "case") else subject) - 1), said
            test = said != "]]" and (test or said == "[[")
        front, second, broken = (kind, said), front, False
    ended = not unclosed and bool(found) and found[-1][0] == len(text) - 1 and found[-1][2:] == (-1, "operator", "\n")
    clear = broken and not arms and not opened and not test and subject == 0 and last != "function" and second != ("keyword", "function")
    return _Cut(tuple(starts), first, seen, unclosed, ended and (clear or not seen))


_known = lru_cache(50_000)(_cut)


def starts_of(text: str) -> list[int]:
    """Where the parts of a script begin: 0, and lines whose first command stands in nothing, behind a complete command.

    Lines are looked at alone, or with those behind them as long as something is open; short ones that come again aren't looked at again.
    """
    lines = text.splitlines(True) if text.isascii() and not _ODD_BREAKS.search(text) else [x for x in re.split(r"(?<=\n)", text) if x]
    starts, seen, at, i = [0], False, 0, 0
    while i < len(lines):
        n = 1
        while True:
            some = lines[i] if n == 1 else "".join(lines[i : i + n])
            cut = _known(some) if len(some) <= _SHORT else _cut(some)
            final = i + n >= len(lines)
            if cut.starts is None and (final or not cut.unclosed):
                return [0]
            if cut.whole or final:
                break
            n *= 2
        if seen and cut.first >= 0:
            starts.append(at + cut.first)
        starts += [at + start for start in cut.starts]
        seen, at, i = seen or cut.said, at + len(some), i + n
    return starts


def parted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct parts of ``texts`` (path, content) with their numbers, as path and content; and where they stand: path, seq (from 0), _at, _line and _text, the part's number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                paths, cut = [], []
                for k, text in enumerate(some.column(1).to_pylist()):
                    if text:
                        starts, line = starts_of(text), 0
                        paths += [k] * len(starts)
                        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
                            cut.append((n, a, line, text[a:b]))
                            line += text.count("\n", a, b)
                seq, at, line, content = zip(*cut, strict=True) if cut else ((), (), (), ())
                columns = [some.column(0).take(pa.array(paths, pa.int64())), pa.array(seq, pa.int32()), pa.array(at, pa.int64()), pa.array(line, pa.int32()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "seq", "_at", "_line", "content"])

    kind = texts.schema["path"].dataType.simpleString()
    cut = stored(texts.select("path", "content").mapInArrow(rows, f"path {kind}, seq int, _at long, _line int, content string"), "parts")
    copies = distinct_texts(cut.select(F.struct("path", "seq", "_at", "_line").alias("path"), "content"), once=True)
    return copies.texts, stored(copies.holders.select("path.*", "_text"), "places")


def in_texts(rows: DataFrame, places: DataFrame, few: bool = False) -> DataFrame:
    """``rows`` about parts in all texts that have them: places in the text (long) and lines are moved to where the part begins.

    If the parts are ``few``, they go to the places, however many of those have the same one.
    """

    def moved(name: str, kind: str) -> Column:
        if kind == "bigint":
            return F.when(F.col(name) >= 0, F.col(name) + F.col("_at")).otherwise(F.col(name)).alias(name)
        return (F.col(name) + F.col("_line")).alias(name) if name in ("line_no", "end_line") else F.col(name)

    columns = [moved(name, kind) for name, kind in rows.dtypes if name != "path"]
    named = rows.withColumnRenamed("path", "_text")
    return places.join(F.broadcast(named) if few else named, "_text").select("path", *columns)


def joined_flow(flow: Flow, places: DataFrame, few: bool = False) -> Flow:
    """The flow of whole texts; ``flow`` is of their parts."""
    turns = Window.partitionBy("path").orderBy("seq")
    ahead = stored(places.withColumns({"_next": F.lead("_text").over(turns), "_next_at": F.lead("_at").over(turns)}), "turns")
    linked, last = ahead.where("_next IS NOT NULL"), ahead.where("_next IS NULL")
    entries = flow.entries.select(F.col("path").alias("_next"), F.col("node").alias("_entry"))
    heads = flow.roots.where("kind = 'file'").select(F.col("path").alias("_next"), F.col("node").alias("_entry"))
    # Pairs of parts that follow each other are few if the parts are.
    pairs = linked.select("_text", "_next").distinct()
    between = pairs.join(flow.ends.select(F.col("path").alias("_text"), F.col("node").alias("a")), "_text").join(entries, "_next")
    past = pairs.join(flow.loose.select(F.col("path").alias("_text"), "a", "name"), "_text").join(heads, "_next")
    near = F.broadcast if few else (lambda rows: rows)
    across = lambda rows, *more: linked.join(near(stored(rows, "across")), ["_text", "_next"]).select("path", (F.col("a") + F.col("_at")).alias("a"), (F.col("_entry") + F.col("_next_at")).alias("b"), *more)
    first, later = ahead.where("seq = 0"), ahead.where("seq > 0")
    # What the part begins with is a root of the first part only.
    own = flow.roots.where("kind <> 'file'").join(flow.entries, ["path", "node"], "left_anti")
    return Flow(
        nodes=stored(in_texts(flow.nodes, places, few), "nodes"),
        edges=stored(in_texts(flow.edges, places, few).unionByName(across(between)), "edges"),
        roots=stored(in_texts(flow.roots, first, few).unionByName(in_texts(own, later, few)), "roots"),
        functions=stored(in_texts(flow.functions, places, few), "functions"),
        elements=in_texts(flow.elements, places, few),
        falls=in_texts(flow.falls, places, few).unionByName(across(past, "name")),
        finals=in_texts(flow.finals, last, few),
        shells=in_texts(flow.shells, places, few),
        ends=in_texts(flow.ends, last, few),
        loose=in_texts(flow.loose, last, few),
        entries=in_texts(flow.entries, first, few),
    )


class Parts(NamedTuple):
    """``tokens`` and ``flow`` of distinct parts, and ``places``: which of them stand where in texts; ``few``: they may go to all executors."""

    tokens: DataFrame
    flow: Flow
    places: DataFrame
    few: bool


def laid_out(texts: DataFrame) -> Parts:
    """The parts of ``texts`` (path, content) and their flow."""
    parts, places = parted(texts)
    found = stored(tokens(parts), "tokens")
    return Parts(found, flow_graph(found), places, found.count() <= _FEW)


def numbered(parts: Parts) -> tuple[DataFrame, DataFrame]:
    """path, node and number (from 1) of the nodes of each part; and the places (path, seq, _part) with ``_before``, how many nodes of the text stand in
    front of the part, ``_size``, how many it has, and ``_next``, the part that follows."""
    numbers = stored(parts.flow.nodes.select("path", "node", F.row_number().over(Window.partitionBy("path").orderBy("node")).alias("number")), "numbers")
    sizes = numbers.groupBy(F.col("path").alias("_text")).agg(F.count("*").cast("int").alias("_size"))
    turns = Window.partitionBy("path").orderBy("seq")
    known = parts.places.join(F.broadcast(sizes) if parts.few else sizes, "_text", "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    before = F.coalesce(F.sum("_size").over(turns.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return numbers, known.select("path", "seq", F.col("_text").alias("_part"), "_size", before.alias("_before"), F.lead("_text").over(turns).alias("_next"))


def numbered_edges(parts: Parts, numbers: DataFrame, places: DataFrame) -> DataFrame:
    """path, a and b of the edges of whole texts, by numbers of nodes; ``numbers`` and ``places`` are of ``numbered``."""
    near = F.broadcast if parts.few else (lambda rows: rows)
    flow, of = parts.flow, lambda column: numbers.select("path", F.col("node").alias(column), F.col("number").alias(f"n_{column}"))
    inner = flow.edges.join(of("a"), ["path", "a"]).join(of("b"), ["path", "b"]).select(F.col("path").alias("_part"), "n_a", "n_b")
    ends = flow.ends.join(numbers, ["path", "node"]).select(F.col("path").alias("_part"), F.col("number").alias("n_a"))
    entries = flow.entries.join(numbers, ["path", "node"]).select(F.col("path").alias("_next"), F.col("number").alias("n_b"))
    own = places.join(near(stored(inner, "inner")), "_part").select("path", (F.col("n_a") + F.col("_before")).alias("a"), (F.col("n_b") + F.col("_before")).alias("b"))
    linked = places.where("_next IS NOT NULL").join(near(stored(ends, "ends")), "_part").join(near(stored(entries, "entries")), "_next")
    return own.unionByName(linked.select("path", (F.col("n_a") + F.col("_before")).alias("a"), (F.col("n_b") + F.col("_before") + F.col("_size")).alias("b")))


def flow_of(texts: DataFrame) -> Flow:
    """The flow of ``texts`` (path, content), the same as that of their tokens."""
    parts = laid_out(texts)
    return joined_flow(parts.flow, parts.places, parts.few)


def names_in(texts: DataFrame) -> dataflow.Names:
    """Reads and writes of names in ``texts`` (path, content), on their flow."""
    return names_of_parts(laid_out(texts))


def names_of_parts(parts: Parts) -> dataflow.Names:
    """Reads and writes of names in the texts that have the parts, on their flow."""
    reads, writes = (stored(in_texts(rows, parts.places, parts.few), name) for rows, name in ((dataflow.reads(parts.tokens, parts.flow), "reads"), (dataflow.writes(parts.flow), "writes")))
    flow = joined_flow(parts.flow, parts.places, parts.few)
    return dataflow.Names(reads, writes, *blocks(flow), flow)


def part_names(parts: Parts) -> dataflow.Names:
    """Reads and writes of names in the parts themselves."""
    return dataflow.names_of(parts.tokens, parts.flow)


def states_by_number(names: dataflow.Names, numbers: DataFrame, places: DataFrame, few: bool) -> DataFrame:
    """What ``dataflow.states`` gives for whole texts, with numbers of nodes for ``node``; ``names`` is of ``part_names``, ``numbers`` and ``places`` of ``numbered``.

    A part sets what is true of a name behind it, takes it back, or passes on what was true in front of it. So how far names get is found
    in each distinct part, and in a text the last part that doesn't pass it on says what holds; only parts with the name, and the last of those without it, are looked at.
    """
    near = F.broadcast if few else (lambda rows: rows)
    found = dataflow.spread(names)
    of_part = lambda rows: near(stored(rows.withColumnRenamed("path", "_part"), "spread"))
    acts = lambda on, keep: F.when(on, True).when(~keep, False)
    whole = numbers.select("path").distinct().join(found.through, "path", "left").na.fill(False, ["e0", "o0", "f0"])
    # Without the name: open if it is written somewhere in the text, open if it isn't, and written on some path.
    e0, o0, f0 = (F.col(x) for x in ("e0", "o0", "f0"))
    whole = whole.withColumns({"known": acts(o0, e0), "unknown": acts(o0 | f0, e0), "some": acts(f0, e0)})
    turns = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda column: F.last(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("act"))), ignorenulls=True).over(turns)
    # A part without commands passes everything on.
    told = places.join(of_part(whole), "_part", "left").select("path", "seq", "_part", "_before", "e0", "f0", *[last(x).alias(x) for x in ("known", "unknown", "some")])
    rows = told.join(of_part(found.names), "_part")
    each = Window.partitionBy("path", "name")
    turn = each.orderBy("seq")
    rows = rows.withColumns({"anywhere": F.max("written").over(each), "behind": F.coalesce(F.lag("seq").over(turn), F.lit(-1))})
    far = lambda column: F.when(column["seq"] > F.col("behind"), column["act"])
    rows = rows.withColumns({
        "open_far": far(F.when(F.col("anywhere"), F.col("known")).otherwise(F.col("unknown"))), "some_far": far(F.col("some")),
        "open_own": acts(F.col("o") | F.col("f") & ~F.col("anywhere"), F.col("e")), "some_own": acts(F.col("w") | F.coalesce("f0", F.lit(False)) & F.col("anywhere"), F.coalesce("e0", F.lit(True))),
    })
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    held = lambda kind, at_first: F.coalesce(f"{kind}_far", F.last(F.coalesce(f"{kind}_own", f"{kind}_far"), ignorenulls=True).over(before), F.lit(at_first))
    rows = rows.select("path", "_part", "name", "_before", "anywhere", held("open", True).alias("open"), held("some", False).alias("some"))
    reads = found.reads.join(numbers, ["path", "node"]).drop("node")
    both = rows.join(of_part(reads), ["_part", "name"])
    may = F.expr("own OR w OR e0 AND some OR f0 AND anywhere")
    must = F.expr("own OR NOT (e AND open OR o OR f AND NOT anywhere)")
    return both.select("path", (F.col("number") + F.col("_before")).alias("node"), "name", "guarded", "quoted", may.alias("may"), must.alias("must"))
