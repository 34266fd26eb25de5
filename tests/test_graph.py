"""Tokens, scopes, flow, names and calls across files on small scripts, each case by hand."""

import random

import pytest

from corvid.functions.lexer import tokens, tokens_of
from corvid.operators import dataflow, scopes, workspace
from corvid.operators.graph import dead_code, flow_graph, unreachable_nodes
from corvid.storage import stored


def shown(text):
    return [(kind, said) for _, _, _, kind, said in tokens_of(text) if kind != "nest"]


def test_tokens():
    assert shown("a 'x | y' \"z; $(b | c)\" | d >f 2>&1 # e") == [("word", "a"), ("word", "'x | y'"), ("word", '"z; $()"'), ("word", "b"), ("operator", "|"), ("word", "c"), ("operator", "|"), ("word", "d"), ("redirect", ">"), ("word", "f"), ("redirect", "2>&"), ("word", "1"), ("comment", "# e")]
    assert shown("case $x in a|b) p;; esac") == [("keyword", "case"), ("word", "$x"), ("keyword", "in"), ("pattern", "a"), ("pattern", "b"), ("operator", ")"), ("word", "p"), ("operator", ";;"), ("keyword", "esac")]
    assert shown("x=$(case y in z) w;; esac) v") == [("word", "x=$()"), ("keyword", "case"), ("word", "y"), ("keyword", "in"), ("pattern", "z"), ("operator", ")"), ("word", "w"), ("operator", ";;"), ("keyword", "esac"), ("word", "v")]
    assert shown("cat <<-E && x\n\tbody $(a)\n\tE\ny") == [("word", "cat"), ("redirect", "<<-"), ("word", "E"), ("operator", "&&"), ("word", "x"), ("operator", "\n"), ("body", "\tbody $(a)\n"), ("word", "y")]
    assert shown("[[ a && (b < c) ]]") == [("word", w) for w in "[[ a && ( b < c ) ]]".split()]
    assert shown("f() { x=(1 $(b)); }; echo if") == [("word", "f"), ("operator", "()"), ("keyword", "{"), ("word", "x=()"), ("word", "1"), ("word", "$()"), ("word", "b"), ("operator", ";"), ("keyword", "}"), ("operator", ";"), ("word", "echo"), ("word", "if")]


def test_tokens_of_broken_and_long_texts():
    rng = random.Random(7)
    parts = ["$(", "`", '"', "'", "${", "$((", "))", ")", "}", "(", "((", "case x in", "esac", "a) ", ";;", "<<E\n", "E\n", "#", "\\", "[[", "]]", "\n", " ", "w", "$x", ">(", "x=("]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        found = tokens_of(text)
        assert found == sorted(found, key=lambda t: (t[0], t[3] != "nest"))
        assert all(0 <= at <= len(text) and (stop is None or at < stop <= len(text)) for at, stop, _, _, _ in found), text
    assert tokens_of("") == []
    assert len(tokens_of("$(" * 5000 + ")" * 5000)) == 10_000
    assert sum(len(t[4]) for t in tokens_of('"$(a ' * 3000 + ')"' * 3000)) < 60_000


SCRIPTS = {
    "seq": ("a; b\nc", "a>b b>c", ""),
    "or": ("cd x || exit 1\necho main", "cd>exit cd>echo", ""),
    "chain": ("a && b || c; d", "a>b a>c b>c b>d c>d", ""),
    "if": ("if a; then b; elif c; then d; else e; fi; f", "a>b a>c b>fi c>d c>e d>fi e>fi fi>f", ""),
    "while": ("while a; do b; if c; then break; fi; d; done; e", "a>b a>e b>c c>break c>fi break>e fi>d d>done done>a", ""),
    "for": ("for x in 1 2; do b; continue; c; done >f\nd", "x>b x>d b>continue continue>x c>done done>x", "c done"),
    "case": ("case $x in a) p;; b) exit;; *) q;& c) ;; esac; z", "$x>p $x>exit $x>q $x>esac p>esac q>esac esac>z", ""),
    "function": ("f() { a; return; b; }\nc; f", "f>c a>return b>} c>f", "b }"),
    "shell": ("( a; exit; b ) || c; d", "a>exit exit>) b>) )>c )>d c>d", "b"),
    "substitution": ("a; x=$(b; exit; c); d", "a>x=$() a>b x=$()>d b>exit", "c"),
    "brace": ("a || { b; exit; }; c", "a>b a>c b>exit }>c", "}"),
    "condition": ("while while p; do q; done; do r; done; s", "p>q p>r p>s q>done done>p r>done done>p", ""),
    "pipe": ("exit 1 | cat; b", "exit>cat cat>b", ""),
    "two": ("for i in 1; do while t; do break 2; u; done; v; done; w", "i>t i>w t>break t>v break>w u>done done>t v>done done>i", "u done"),
    "list": ("a && { b || exit; } && c; d", "a>b a>d b>exit b>} }>c }>d c>d", ""),
    "open": ("if a; then b", "a>b", ""),
    "empty": ("", "", ""),
}


@pytest.fixture(scope="module")
def flow(spark):
    files = spark.createDataFrame([*((k, v[0]) for k, v in SCRIPTS.items()), ("null", None)], "path string, content string")
    found = stored(tokens(files), "tokens")
    return found, flow_graph(found)


def test_edges_and_unreachable(flow):
    _, graph = flow
    names = {(r.path, r.node): r.name or (r.assigned and r.assigned[0]) for r in graph.nodes.collect()}
    edges, gone = {}, {}
    for r in graph.edges.collect():
        edges.setdefault(r.path, []).append(f"{names[r.path, r.a]}>{names[r.path, r.b]}")
    for r in unreachable_nodes(graph).collect():
        gone.setdefault(r.path, []).append(r.name)
    for path, (_, steps, dead) in SCRIPTS.items():
        assert sorted(edges.get(path, [])) == sorted(steps.split()), path
        assert sorted(gone.get(path, [])) == sorted(dead.split()), path


def test_dead_code(flow):
    dead = {(r.path, r.line_no, r.col) for r in dead_code(flow[1]).collect()}
    assert dead == {("function", 1, 18), ("shell", 1, 12), ("substitution", 1, 17)}


def test_scopes_and_chains(spark, flow):
    text = 'f() { a "$(b "$(c d)")"; }\nfunction g ( x=1 y )\n( cd z )\n'
    found = stored(tokens(spark.createDataFrame([("t", text)], "path string, content string")), "tokens")
    tree = {(r.at, r.kind, r.name, r.level, r.parent) for r in scopes.scopes(found).collect()}
    assert tree == {(-1, "file", None, 0, None), (4, "function", "f", 1, -1), (9, "substitution", None, 2, 4), (14, "substitution", None, 3, 9), (38, "function", "g", 1, -1), (48, "subshell", None, 1, -1)}
    points = spark.createDataFrame([("t", 18), ("t", 12), ("t", 0)], "path string, pos long")
    chains = scopes.selection_chains(points, found.where("kind = 'nest'").select("path", "at", "stop"), ["path"])
    assert sorted((r.pos, r.step, r.at) for r in chains.collect()) == [(12, 0, 9), (12, 1, 8), (18, 0, 14), (18, 1, 13), (18, 2, 9), (18, 3, 8)]
    deep = spark.createDataFrame([("t", i, 400 - i) for i in range(150)], "path string, at long, stop long")
    assert scopes.lineage(scopes.nested(deep, ["path"]), ["path"]).count() == 150 * 149 // 2


def test_names_on_paths(spark):
    cases = {
        "a": "x=1\necho $x\nx=2\n",
        "b": "if t; then x=1; fi\necho \"$x\" ${y:-d} '$z' $((w+1))\n",
        "c": "while t; do echo $x; x=1; done\n",
        "d": "f() { echo $x; }\nx=1\nf\nx=2\n",
        "e": "x=a\nx+=b\necho \"$x\"\n",
        "f": "read -r x y\necho $y\nfor i in 1 2; do :; done\n",
        "g": "x='a b'; y=plain; t && y=$(cmd); echo $x $y \"$x\"\n",
    }
    found = stored(tokens(spark.createDataFrame(list(cases.items()), "path string, content string")), "tokens")
    names = dataflow.names_of(found, flow_graph(found))
    states = {(r.path, r.name, r.guarded): (r.may, r.must) for r in dataflow.states(names).collect()}
    assert states == {("a", "x", False): (True, True), ("b", "x", False): (True, False), ("b", "y", True): (False, False), ("b", "w", False): (False, False), ("c", "x", False): (True, False), ("d", "x", False): (True, True), ("e", "x", False): (True, True), ("f", "y", False): (True, True), ("g", "x", False): (True, True), ("g", "y", False): (True, True)}
    lines = {(r.path, r.node): r.line_no for r in names.flow.nodes.collect()}
    assert sorted((r.path, r.name, lines[r.path, r.node]) for r in dataflow.unused(names).collect()) == [("a", "x", 3), ("f", "i", 3), ("f", "x", 1)]
    got = {(r.path, r.name): (list(r.literals), r.open, r.splits) for r in dataflow.values(names).where("path = 'g'").collect()}
    assert got == {("g", "x"): (["a b"], False, True), ("g", "y"): (["plain"], True, True)}


FILES = [
    ("p/main.sh", 'if r; then source a.sh; else source b.sh; fi\nhelper\nsource "$P"\nhelper\nmissing'), ("p/a.sh", "helper() { :; }"), ("p/b.sh", "helper() { :; }"),
    ("q/one.sh", "f() { :; }\n. lib/../lib/c.sh\nf\n"), ("q/two.sh", "g() { :; }\n. ./lib/c.sh\nf\ng"), ("q/lib/c.sh", "f\ng\nt && f() { x; }"),
    ("r/x.sh", "f() { :; }\n( f() { y; }; f )\nreturn\nf() { z; }"), ("r/y.sh", "source x.sh\nf"),
    ("s/m.sh", "source n.sh\nh"), ("s/n.sh", "source m.sh\nh() { 1; }\nh"), ("t/l.sh", "load() { source u.sh; }\nk"), ("t/u.sh", "k() { 1; }"),
]


def test_calls_across_files(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    flow = flow_graph(stored(tokens(files), "tokens"))
    got = {(r.path, r.node, r.name): ([(d.path, d.node) for d in r.definitions], r.may_be_absent, r.incomplete) for r in workspace.function_index(flow, files).collect()}
    assert got == {
        ("p/main.sh", 45, "helper"): ([("p/a.sh", 0), ("p/b.sh", 0)], False, False),
        ("p/main.sh", 64, "helper"): ([("p/a.sh", 0), ("p/b.sh", 0)], False, True),
        ("q/lib/c.sh", 0, "f"): ([("q/one.sh", 0)], True, False),
        ("q/lib/c.sh", 2, "g"): ([("q/two.sh", 0)], True, False),
        ("q/one.sh", 29, "f"): ([("q/lib/c.sh", 9), ("q/one.sh", 0)], False, False),
        ("q/two.sh", 24, "f"): ([("q/lib/c.sh", 9)], True, False),
        ("q/two.sh", 26, "g"): ([("q/two.sh", 0)], False, False),
        ("r/x.sh", 25, "f"): ([("r/x.sh", 13)], False, False),
        ("r/y.sh", 12, "f"): ([("r/x.sh", 0)], False, False),
        ("s/m.sh", 12, "h"): ([("s/n.sh", 12)], False, False),
        ("s/n.sh", 23, "h"): ([("s/n.sh", 12)], False, False),
        ("t/l.sh", 24, "k"): ([], True, False),
    }
