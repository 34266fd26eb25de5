"""What holds across whole texts follows from their distinct parts as it does from their own graphs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.functions.lexer import tokens
from corvid.operators import dataflow, graph, whole
from corvid.operators.graph import flow_graph
from corvid.operators.parts import laid_out, names_of_parts, numbered
from corvid.storage import stored
from tests.test_parts import rows, scripts  # noqa: F401


@pytest.fixture(scope="module")
def both(scripts):  # noqa: F811
    """The names of whole texts, the numbers of their nodes, and the parts with theirs."""
    found = stored(tokens(scripts), "tokens")
    names = dataflow.names_of(found, flow_graph(found))
    numbers = stored(names.flow.nodes.select("path", "node", F.row_number().over(Window.partitionBy("path").orderBy("node")).alias("number")), "numbers")
    parts = laid_out(scripts)
    return names, numbers, parts, numbered(parts)


def by_number(found, numbers, *columns):
    for c in columns:
        found = found.join(numbers.select("path", F.col("node").alias(c), F.col("number").alias(f"n_{c}")), ["path", c]).drop(c).withColumnRenamed(f"n_{c}", c)
    return found


def test_unreachable(both):
    names, numbers, parts, placed = both
    want = by_number(graph.unreachable_nodes(names.flow).select("path", "node"), numbers, "node")
    assert rows(whole.unreachable(parts, *placed)) == rows(want) and want.count() > 300


def test_dead_lines(both):
    names, _, parts, _ = both
    want = graph.dead_code(names.flow)
    assert rows(whole.dead_lines(parts).select("path", "line_no")) == rows(want.select("path", "line_no")) and want.count() > 200


def test_dominators(both):
    names, numbers, parts, placed = both
    want = by_number(dataflow.dominators(names.flow), numbers, "node", "dominator")
    assert rows(whole.dominators(parts, *placed)) == rows(want) and want.count() > 1000


def test_unused(both):
    names, numbers, parts, placed = both
    want = by_number(dataflow.unused(names), numbers, "node")
    assert rows(whole.unused(parts, *placed)) == rows(want) and want.count() > 50


def test_values(both):
    names, numbers, parts, placed = both
    want = by_number(dataflow.values(names), numbers, "node")
    assert rows(whole.values(parts, *placed)) == rows(want) and want.count() > 100


@pytest.mark.parametrize("few", [32, 2])
def test_calls(spark, monkeypatch, few):
    monkeypatch.setattr(whole, "_FEW_LINKS", few)
    lines = ("f() { g; echo $a; }", "g() { f; echo $b; }", "h() { if t; then k; fi; }", "k() { h; return; echo $c; }", "f() { k; }", "while t; do m() { break; f; }; done", "g", "exit", "x=$(k $d)")
    made = [(k, "\n".join(random.Random(k).choices(lines, k=1 + k % 7))) for k in range(120)]
    texts = stored(spark.createDataFrame(made, "path long, content string"), "texts")
    parts = laid_out(texts)
    names = names_of_parts(parts)
    sites = stored(dataflow.call_sites(names.flow), "sites")
    roots = stored(names.flow.functions.select("path", "root").distinct().withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("root")) - 1), "roots")
    of = lambda df, c: df.join(roots.select("path", F.col("root").alias(c), F.col("n").alias(f"n_{c}")), ["path", c], "left").drop(c).withColumnRenamed(f"n_{c}", c)
    found = whole.calls(parts)
    assert rows(found.sites) == rows(of(of(sites.select("path", "caller", "callee"), "caller"), "callee"))
    _, want = dataflow.components(sites.where("caller IS NOT NULL").select("path", F.col("caller").alias("a"), F.col("callee").alias("b")), ["path"])
    assert rows(whole.called(found)[1]) == rows(of(of(want, "node"), "component")) and want.count() > 100
    reads = of(dataflow.scope_reads(names, sites).withColumnRenamed("root", "function"), "function")
    assert rows(whole.scope_reads(parts, found)) == rows(reads) and reads.count() > 100
