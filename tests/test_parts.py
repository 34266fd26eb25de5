"""The flow of scripts from that of their distinct parts is the same as that of their tokens."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.functions.lexer import tokens
from corvid.operators import dataflow
from corvid.operators.graph import Flow, flow_graph
from corvid.operators.parts import flow_of, laid_out, names_in, numbered, numbered_edges, part_names, parted, starts_of, states_by_number
from corvid.storage import stored
from tests.test_graph import SCRIPTS

LINES = (
    "a", "  b; exit", "x=$(p $(q); exit; r)", "cat <<E && c\nbody $(d) $x\nE", "f() {\n  x=1; return; y\n}", "f ()\n{ z; }", "function g\n{ z; }", "if t; then x=2; fi", "while t\ndo break; u; done | w", "a &&\n  b ||\n  exit",
    "a && b", "( x=3; exit; y ) && c", "( a )\n( b )", "case $k in\n a) p;;\n *) q;& c) ;;\nesac", "for i in 1 2; do while t; do continue 2; u; done; done", "exit | v", ">f", "[[ a &&\n b ]] && c", "# note", "", "  a \\\n  b", "{ a; } >f &\nb", "v=(1 $(s)\n 2)", "exit", "echo $x ${y:-d}",
    # What isn't cut, as it may mean something else alone.
    "fi", "else", "! a", "&& b", "| c", "echo function", "[[ a", "case\nesac\nin", "if t; then", "done", "cat <<\nE", "'", "echo \"", ")", "x `a`", "time a", "esac", "{",
)


@pytest.fixture(scope="module")
def scripts(spark):
    rng = random.Random(3)
    made = [("\n".join(rng.choices(LINES[:25] if k % 2 else LINES, k=rng.randint(1, 6)))) for k in range(400)]
    texts = dict.fromkeys([v[0] for v in SCRIPTS.values()] + made)
    return stored(spark.createDataFrame([*enumerate(texts), (-1, None)], "path long, content string"), "scripts")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_flow_of_parts(scripts):
    whole, joined = flow_graph(stored(tokens(scripts), "tokens")), flow_of(scripts)
    assert parted(scripts)[1].count() > 900
    for name in Flow._fields:
        got, want = (getattr(flow, name) for flow in (joined, whole))
        if name == "roots":
            # A node that is a root twice has either kind.
            got, want = got.select("path", "node"), want.select("path", "node")
        assert rows(got.distinct()) == rows(want.distinct()), name
        assert name not in ("nodes", "edges") or got.count() == want.count(), name


def test_names_of_parts(scripts):
    found = stored(tokens(scripts), "tokens")
    whole, joined = dataflow.names_of(found, flow_graph(found)), names_in(scripts)
    assert rows(joined.reads) == rows(whole.reads)
    assert rows(joined.writes.distinct()) == rows(whole.writes.distinct())


def test_equal_parts_once(spark):
    texts = spark.range(300).select("id", F.concat(F.lit("a\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda k: F.lit("if b; then c; fi")), "\n"), F.lit("\nd")).alias("content")).withColumnRenamed("id", "path")
    parts, places = parted(texts)
    assert sorted(r.content for r in parts.collect()) == ["a\n", "d", "if b; then c; fi\n"]
    assert places.count() == sum(3 + k % 7 for k in range(300))


def test_starts():
    assert starts_of("a\n\n# b\n  c; d\ne") == [0, 7, 14]
    assert starts_of("f() {\n a\n}\ng <<E\nx\nE\nh") == [0, 11, 21]
    for whole in ("if a\nthen b\nfi", "a\nfi\nb", "a &&\nb", "function f\n{ a; }", "[[ a\nb", "echo function\nb", "x $(\na\n)", "a\n! b", "cat <<\nb"):
        assert starts_of(whole) == [0], whole


def test_equal_lines_are_looked_at_once(monkeypatch):
    from corvid.operators import parts

    seen, whole = [], parts.tokens_of
    monkeypatch.setattr(parts, "tokens_of", lambda text: seen.append(text) or whole(text))
    lines = ("once a", "if once; then b; fi", "once() { c; }", "while once", "do d; done", "# once")
    texts = ["\n".join(random.Random(k).choices(lines, k=8)) for k in range(300)]
    # Loops over two lines are looked at with what comes behind them, all else by itself.
    texts = [t for t in texts if "while" not in t and "done" not in t] + ["while once\ndo d; done\nonce a"]
    assert [starts_of(t) for t in texts[-1:]] == [[0, 22]]
    for t in texts:
        starts_of(t)
    assert len(seen) == len(set(seen)) and set(seen) <= {x + end for x in lines for end in ("", "\n")} | {"while once\ndo d; done\n"}


def test_cuts_as_of_whole_texts():
    """What lines give together is what one look at the whole text gives."""
    from corvid.operators.parts import _cut

    rng = random.Random(5)
    odd = (*LINES, "a\\", "\\", "case", "in", "a) b", ";;", "(", "b )", "$(", "f()", "cat <<-E", "\tE", "E", "for", "a\rb", "[[ x ]] &&", "a\x0bc")
    for k in range(5000):
        text = "\n".join(rng.choices(odd if k % 3 else LINES[:25], k=rng.randint(1, 9)))
        want = _cut(text).starts
        assert starts_of(text) == [0, *(want or ())], text


def test_numbered_edges(scripts):
    whole = flow_graph(stored(tokens(scripts), "tokens"))
    numbers = whole.nodes.select("path", "node", F.row_number().over(Window.partitionBy("path").orderBy("node")).alias("number"))
    a, b = (numbers.select("path", F.col("node").alias(x), F.col("number").alias(f"n_{x}")) for x in "ab")
    want = whole.edges.join(a, ["path", "a"]).join(b, ["path", "b"]).select("path", F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    parts = laid_out(scripts)
    assert rows(numbered_edges(parts, *numbered(parts))) == rows(want)


def test_states_of_parts(scripts):
    names = names_in(scripts)
    numbers = names.flow.nodes.select("path", "node", F.row_number().over(Window.partitionBy("path").orderBy("node")).alias("number"))
    want = dataflow.states(names).join(numbers, ["path", "node"]).drop("node").withColumnRenamed("number", "node")
    parts = laid_out(scripts)
    got = states_by_number(part_names(parts), *numbered(parts), parts.few)
    assert rows(got) == rows(want) and got.count() > 100
