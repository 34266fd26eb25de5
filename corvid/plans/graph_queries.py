"""Scopes, nested commands, flow, names and dominators over a generated script for each order.

An item of the order is a piece of script, chosen by its keys. SQL knows of each piece how many nodes it has, which
leads to which, and where it is entered and left, and works out what follows for the whole script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.lexer import tokens
from corvid.operators import dataflow, scopes, whole
from corvid.operators.copies import Copies, distinct_texts, held
from corvid.operators.graph import Flow
from corvid.operators.lint import RULES, diagnostics, select
from corvid.operators.parts import Parts, laid_out, names_of_parts, numbered, numbered_edges, part_names, states_by_number
from corvid.plans.registry import query
from corvid.sources.tables import table
from corvid.storage import remembered, stored

# Text, how many nodes it has, steps between them (None is what follows the piece), nodes that it is entered at.
PIECES = (
    ("cd /srv || exit 1", 2, ((0, 1), (0, None)), (0,)),
    ("a && b || c", 3, ((0, 1), (0, 2), (1, 2), (1, None), (2, None)), (0,)),
    ("if t; then x; elif u; then y; else z; fi", 6, ((0, 1), (0, 2), (1, 5), (2, 3), (2, 4), (3, 5), (4, 5), (5, None)), (0,)),
    ("while t; do x; break; y; done", 5, ((0, 1), (0, None), (1, 2), (2, None), (3, 4), (4, 0)), (0,)),
    ("case $k in a) p;; b) return 3;; *) q;; esac", 5, ((0, 1), (0, 2), (0, 3), (1, 4), (3, 4), (4, None)), (0,)),
    ("f() { a; return; b; }\nf", 6, ((0, 5), (1, 2), (3, 4), (5, None)), (0,)),
    ("( a; exit; b ) && c", 5, ((0, 1), (1, 3), (2, 3), (3, 4), (3, None), (4, None)), (0,)),
    ("x=$(p; exit; q)", 4, ((0, None), (1, 2)), (0, 1)),
    ("until t; do continue; y; done >/dev/null", 4, ((0, 1), (0, None), (1, 0), (2, 3), (3, 0)), (0,)),
    ("v=1", 1, ((0, None),), (0,)),
    ("{ a; b; } | c", 4, ((0, 1), (1, 2), (2, 3), (3, None)), (0,)),
    ("for i in 1 2; do while t; do break 2; done; y; done", 6, ((0, 1), (0, None), (1, 2), (1, 4), (2, None), (3, 1), (4, 5), (5, 0)), (0,)),
    ("exit 0", 1, (), (0,)),
)
#: Nodes that are entered though nothing leads to them: those of functions' bodies.
_BODIES = ((5, 1),)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_KEYS = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax"
_CHOICE = f"(l_partkey + 3 * l_suppkey + l_linenumber) % {len(PIECES)}"
_PIECED = f"""pieces(k, n) AS (VALUES {", ".join(f"({k}, {n})" for k, (_, n, _, _) in enumerate(PIECES))}),
steps(k, a, b) AS (VALUES {", ".join(f"({k}, {a}, {'NULL' if b is None else b})" for k, (_, _, s, _) in enumerate(PIECES) for a, b in s)}),
entries(k, e) AS (VALUES {", ".join(f"({k}, {e})" for k, (_, _, _, entered) in enumerate(PIECES) for e in entered)}),
bodies(k, e) AS (VALUES {", ".join(f"({k}, {e})" for k, e in _BODIES)}),
items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS}) AS item, {_CHOICE} AS k FROM lineitem),
placed AS (SELECT concat('order-', l_orderkey, '.sh') AS path, item, k, n, (1 + coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS first FROM items JOIN pieces USING (k)),
flow AS (SELECT path, first + a AS a, first + b AS b FROM placed JOIN steps USING (k) WHERE b IS NOT NULL
  UNION SELECT p.path, p.first + s.a, q.first + e.e FROM placed p JOIN steps s ON s.k = p.k AND s.b IS NULL JOIN placed q ON q.path = p.path AND q.item = p.item + 1 JOIN entries e ON e.k = q.k),
roots AS (SELECT path, first + e AS node FROM placed JOIN entries USING (k) WHERE item = 1 UNION SELECT path, first + e FROM placed JOIN bodies USING (k))"""


def _scripts(spark: SparkSession, sf_dir: str, choice: str, texts: list[str]) -> DataFrame:
    """path and content of a script for each order, whose lines ``choice`` picks from ``texts`` for each item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_KEYS.split(", "), F.expr(choice).cast("int").alias("k")).alias("item"))
    said = F.transform(F.sort_array(F.collect_list("item")), lambda x: F.get(F.array(*[F.lit(t) for t in texts]), x["k"]))
    return items.groupBy("l_orderkey").agg(F.array_join(said, "\n").alias("content")).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit(".sh")).alias("path"), "content")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[Parts, DataFrame, DataFrame, Copies]:
    """The parts of all texts, the numbers of their nodes, where they stand, and which scripts have which text."""

    def make() -> tuple[Parts, DataFrame, DataFrame, Copies]:
        copies = distinct_texts(stored(_scripts(spark, sf_dir, _CHOICE, [p[0] for p in PIECES]), "scripts"))
        parts = laid_out(copies.texts)
        numbers, places = numbered(parts)
        return parts, numbers, stored(places, "numbered"), copies

    return remembered(spark, ("parts", sf_dir), make)


@query(f"WITH {_PIECED} SELECT path, a, b FROM flow")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which command may run after which: lists, branches, loops, arms, functions, subshells and substitutions."""
    parts, numbers, places, copies = _parts(spark, sf_dir)
    return numbered_edges(parts, numbers, held(places, copies))


@query(f"""WITH RECURSIVE {_PIECED}, reached(path, node) AS (SELECT path, node FROM roots UNION SELECT r.path, f.b FROM reached r JOIN flow f ON f.path = r.path AND f.a = r.node)
SELECT path, (first + i)::INTEGER AS node FROM placed, unnest(range(n)) AS t(i) WHERE (path, first + i) NOT IN (SELECT (path, node) FROM reached)""")
def graph_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that no path reaches, as those behind ``exit``, ``return``, ``break`` and ``continue``."""
    parts, numbers, places, copies = _parts(spark, sf_dir)
    return held(whole.unreachable(parts, numbers, places), copies)


@query(f"""WITH RECURSIVE {_PIECED}, start AS (SELECT path, min(node) AS node FROM roots GROUP BY path),
reached(path, node) AS (SELECT path, node FROM start UNION SELECT r.path, f.b FROM reached r JOIN flow f ON f.path = r.path AND f.a = r.node),
avoids(path, node, dom) AS (SELECT s.path, s.node, r.node FROM start s JOIN reached r ON r.path = s.path WHERE r.node <> s.node
  UNION SELECT v.path, f.b, v.dom FROM avoids v JOIN flow f ON f.path = v.path AND f.a = v.node WHERE f.b <> v.dom)
SELECT a.path, a.node::INTEGER AS node, b.node::INTEGER AS dominator FROM reached a JOIN reached b ON a.path = b.path WHERE (a.path, a.node, b.node) NOT IN (SELECT (path, node, dom) FROM avoids)""")
def graph_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that every path to a command runs through."""
    parts, numbers, places, copies = _parts(spark, sf_dir)
    return held(whole.dominators(parts, numbers, places), copies)


# A name in each piece: written or read, once or in a branch. Nodes that write (w) or read (r), how they lead on.
NAMED = (
    ("v{v}=1", "w", (), ((0, None),)),
    ('echo "$v{v}"', "r", (), ((0, None),)),
    ("if t; then v{v}=2; fi", "", ((1, "w"),), ((0, 1), (0, 2), (1, 2), (2, None))),
    ("if t; then v{v}=3; else v{v}=4; fi", "", ((1, "w"), (2, "w")), ((0, 1), (0, 2), (1, 3), (2, 3), (3, None))),
    ("while t; do echo $v{v}; v{v}=5; done", "", ((1, "r"), (2, "w")), ((0, 1), (0, None), (1, 2), (2, 3), (3, 0))),
    ("t && v{v}=6", "", ((1, "w"),), ((0, 1), (0, None), (1, None))),
    ("case $1 in a) v{v}=7;; *) exit;; esac", "", ((1, "w"),), ((0, 1), (0, 2), (1, 3), (3, None))),
    ("( v{v}=8; echo $v{v} )", "", ((0, "w"), (1, "r")), ((0, 1), (1, 2), (2, None))),
    ("echo ${{v{v}:-none}}", "", ((0, "g"),), ((0, None),)),
)
_N_NAMES = 3
_NAME_CHOICE = f"(l_partkey + l_suppkey + l_linenumber) % {len(NAMED)} * {_N_NAMES} + l_suppkey % {_N_NAMES}"
_ACTS = [(k, i, act) for k, (_, whole, acts, _) in enumerate(NAMED) for i, act in ([(0, whole)] if whole else acts)]
_SIZES = [max([a for a, _ in steps] + [b for _, b in steps if b is not None]) + 1 for _, _, _, steps in NAMED]
_NAMES = f"""pieces(k, n) AS (VALUES {", ".join(f"({k}, {n})" for k, n in enumerate(_SIZES))}),
steps(k, a, b) AS (VALUES {", ".join(f"({k}, {a}, {'NULL' if b is None else b})" for k, (_, _, _, s) in enumerate(NAMED) for a, b in s)}),
acts(k, i, act) AS (VALUES {", ".join(f"({k}, {i}, '{act}')" for k, i, act in _ACTS)}),
items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS}) AS item, (l_partkey + l_suppkey + l_linenumber) % {len(NAMED)} AS k, l_suppkey % {_N_NAMES} AS v FROM lineitem),
placed AS (SELECT concat('order-', l_orderkey, '.sh') AS path, item, k, v, (1 + coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS first FROM items JOIN pieces USING (k)),
flow AS (SELECT path, first + a AS a, first + b AS b FROM placed JOIN steps USING (k) WHERE b IS NOT NULL
  UNION SELECT p.path, p.first + s.a, q.first FROM placed p JOIN steps s ON s.k = p.k AND s.b IS NULL JOIN placed q ON q.path = p.path AND q.item = p.item + 1),
acting AS (SELECT path, (first + i)::INTEGER AS node, v, act, item AS line_no FROM placed JOIN acts USING (k))"""


def _named_parts(spark: SparkSession, sf_dir: str) -> tuple[Parts, Copies]:

    def make() -> tuple[Parts, Copies]:
        texts = [text.format(v=v) for text, _, _, _ in NAMED for v in range(_N_NAMES)]
        copies = distinct_texts(stored(_scripts(spark, sf_dir, _NAME_CHOICE, texts), "scripts"))
        return laid_out(copies.texts), copies

    return remembered(spark, ("named-parts", sf_dir), make)


@query(f"""WITH RECURSIVE {_NAMES}, vs AS (SELECT DISTINCT path, v FROM acting),
open(path, node, v) AS (SELECT path, 1, v FROM vs UNION SELECT o.path, f.b, o.v FROM open o JOIN flow f ON f.path = o.path AND f.a = o.node
  WHERE NOT EXISTS (SELECT 1 FROM acting w WHERE w.path = o.path AND w.node = o.node AND w.v = o.v AND w.act = 'w')),
may(path, node, v) AS (SELECT w.path, f.b, w.v FROM acting w JOIN flow f ON f.path = w.path AND f.a = w.node WHERE act = 'w' UNION SELECT m.path, f.b, m.v FROM may m JOIN flow f ON f.path = m.path AND f.a = m.node)
SELECT path, node, concat('v', v) AS name, act = 'g' AS guarded, (path, node, v) IN (SELECT (path, node, v) FROM may) AS may, (path, node, v) NOT IN (SELECT (path, node, v) FROM open) AS must
FROM acting WHERE act IN ('r', 'g')""")
def graph_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some, and whether every, path to a read of a name writes it."""
    parts, copies = _named_parts(spark, sf_dir)
    found = states_by_number(part_names(parts), *numbered(parts), parts.few)
    return held(found.where("name LIKE 'v%'").select("path", "node", "name", "guarded", "may", "must"), copies)


@query(f"""WITH RECURSIVE {_NAMES},
live(path, node, v) AS (SELECT path, node, v FROM acting WHERE act IN ('r', 'g') UNION SELECT l.path, f.a, l.v FROM live l JOIN flow f ON f.path = l.path AND f.b = l.node
  WHERE NOT EXISTS (SELECT 1 FROM acting w WHERE w.path = l.path AND w.node = f.a AND w.v = l.v AND w.act = 'w'))
SELECT path, node, concat('v', v) AS name FROM acting w WHERE act = 'w' AND NOT EXISTS (SELECT 1 FROM flow f JOIN live l ON l.path = f.path AND l.node = f.b AND l.v = w.v WHERE f.path = w.path AND f.a = w.node)""")
def graph_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of names that no path reads before they are written again."""
    parts, copies = _named_parts(spark, sf_dir)
    return held(whole.unused(parts, *numbered(parts)).select("path", "node", "name").distinct(), copies)


_N_LINES = [1 + text.count("\n") for text, _, _, _ in PIECES]
_ENDS = [k for k, (text, _, _, _) in enumerate(PIECES) if text == "exit 0"][0]
# Pieces with a command behind ``exit`` or ``return``, on their first line.
_CUT = [k for k, (text, _, _, _) in enumerate(PIECES) if "return; b" in text or "exit; " in text]


@query(f"""WITH {_PIECED}, heights(k, h) AS (VALUES {", ".join(f"({k}, {h})" for k, h in enumerate(_N_LINES))}),
tall AS (SELECT path, item, k, h, (1 + coalesce(sum(h) OVER (PARTITION BY path ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS top, min(CASE WHEN k = {_ENDS} THEN item END) OVER (PARTITION BY path) AS last FROM placed JOIN heights USING (k))
SELECT path, (top + i)::INTEGER AS line_no, 'C124' AS code FROM tall, unnest(range(h)) AS t(i) WHERE item > last OR i = 0 AND k IN ({", ".join(map(str, _CUT))})""")
def dead_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can't be reached because of ``exit`` or ``return``."""
    files = stored(_scripts(spark, sf_dir, _CHOICE, [p[0] for p in PIECES]), "scripts")
    return diagnostics(files, select(RULES, ("C124",))).select("path", "line_no", "code")


@query(f"""WITH RECURSIVE {_NAMES},
live(path, node, v) AS (SELECT path, node, v FROM acting WHERE act IN ('r', 'g') UNION SELECT l.path, f.a, l.v FROM live l JOIN flow f ON f.path = l.path AND f.b = l.node
  WHERE NOT EXISTS (SELECT 1 FROM acting w WHERE w.path = l.path AND w.node = f.a AND w.v = l.v AND w.act = 'w')),
may(path, node, v) AS (SELECT w.path, f.b, w.v FROM acting w JOIN flow f ON f.path = w.path AND f.a = w.node WHERE act = 'w' UNION SELECT m.path, f.b, m.v FROM may m JOIN flow f ON f.path = m.path AND f.a = m.node)
SELECT path, max(line_no)::INTEGER AS line_no, 'C001' AS code FROM acting w WHERE act = 'w' AND NOT EXISTS (SELECT 1 FROM flow f JOIN live l ON l.path = f.path AND l.node = f.b AND l.v = w.v WHERE f.path = w.path AND f.a = w.node) GROUP BY path, v
UNION SELECT path, line_no::INTEGER, 'C006' FROM acting r WHERE act = 'r' AND (path, node, v) NOT IN (SELECT (path, node, v) FROM may) AND NOT EXISTS (SELECT 1 FROM acting g WHERE g.path = r.path AND g.v = r.v AND g.act = 'g')""")
def flow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that no path reads again, and reads that no path writes before, in scripts with branches and loops."""
    texts = [text.format(v=v) for text, _, _, _ in NAMED for v in range(_N_NAMES)]
    files = stored(_scripts(spark, sf_dir, _NAME_CHOICE, texts), "scripts")
    return diagnostics(files, select(RULES, ("C001", "C006"))).select("path", "line_no", "code").where("code = 'C001' OR code = 'C006'").distinct()


# Each item opens a scope within that of the item before it, and says its number there.
_NESTING = f"""items AS (SELECT concat('order-', l_orderkey, '.sh') AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS})::INTEGER AS item, (l_partkey + l_suppkey) % 3 AS k FROM lineitem),
kinds(k, kind) AS (VALUES (0, 'function'), (1, 'subshell'), (2, 'substitution')), nest AS (SELECT path, item, kind FROM items JOIN kinds USING (k))"""


def _nesting(spark: SparkSession, sf_dir: str) -> Copies:
    """A script for each order that nests as deep as the order has items."""
    items = table(spark, sf_dir, "lineitem").withColumn("item", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS.split(", "))))
    k, i = ((F.col("l_partkey") + F.col("l_suppkey")) % 3).cast("int"), F.col("item").cast("string")
    opening = F.get(F.array(F.concat(F.lit("f"), i, F.lit("() {")), F.lit("("), F.lit("x=$(")), k)
    line = F.concat(opening, F.lit("\necho "), i)
    rows = F.array_sort(F.collect_list(F.struct("item", line.alias("open"), F.get(F.array(F.lit("}"), F.lit(")"), F.lit(")")), k).alias("close"))))
    said = items.groupBy("l_orderkey").agg(rows.alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda r: r["open"]), "\n"), F.lit("\n"), F.array_join(F.reverse(F.transform("rows", lambda r: r["close"])), "\n"))
    return distinct_texts(stored(said.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit(".sh")).alias("path"), text.alias("content")), "scripts"))


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Copies]:

    def make() -> tuple[DataFrame, DataFrame, Copies]:
        copies = _nesting(spark, sf_dir)
        found = stored(tokens(copies.texts), "tokens")
        tree = scopes.scopes(found)
        return found, stored(tree.withColumn("scope", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1), "scopes"), copies

    return remembered(spark, ("scoped", sf_dir), make)


@query(f"""WITH {_NESTING} SELECT path, 0 AS scope, 'file' AS kind, NULL::VARCHAR AS name, 0 AS level, NULL::INTEGER AS parent FROM (SELECT DISTINCT path FROM nest)
UNION ALL SELECT path, item, kind, CASE WHEN kind = 'function' THEN concat('f', item) END, item, item - 1 FROM nest""")
def scope_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope of nested scripts, with its parent and how deep it is."""
    _, tree, copies = _scoped(spark, sf_dir)
    numbers = tree.select("path", F.col("at").alias("parent"), F.col("scope").alias("of"))
    return held(tree.join(numbers, ["path", "parent"], "left").select("path", "scope", "kind", "name", "level", F.col("of").alias("parent")), copies)


@query(f"""WITH {_NESTING} SELECT a.path, a.item AS scope, b.item AS ancestor, (a.item - b.item)::INTEGER AS distance FROM nest a JOIN nest b ON a.path = b.path AND b.item < a.item
UNION ALL SELECT path, item, 0, item FROM nest""")
def scope_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scopes around each scope, and how far out they are."""
    _, tree, copies = _scoped(spark, sf_dir)
    a, b = (tree.select("path", F.col("at").alias(x), F.col("scope").alias(f"n_{x}")) for x in ("at", "ancestor"))
    return held(scopes.lineage(tree, ["path"]).join(a, ["path", "at"]).join(b, ["path", "ancestor"]).select("path", F.col("n_at").alias("scope"), F.col("n_ancestor").alias("ancestor"), "distance"), copies)


@query(f"""WITH {_NESTING} SELECT path, item AS said, (2 * item)::INTEGER AS line_no, item AS scope, max(CASE WHEN kind = 'function' THEN concat('f', item) END) OVER (PARTITION BY path ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL AS in_function,
  last_value(CASE WHEN kind = 'function' THEN concat('f', item) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caller FROM nest""")
def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of every level, with the innermost scope around each and the nearest function."""
    found, tree, copies = _scoped(spark, sf_dir)
    said = stored(scopes.nested_commands(found).where("name = 'echo'"), "said")
    inner = tree.where("kind <> 'file'")
    inside = scopes.innermost(said.select("path", F.col("at").alias("pos")), inner, ["path"]).withColumnRenamed("inside", "at")
    placed = inside.join(tree.select("path", "at", "scope"), ["path", "at"])
    every = tree.select("path", "at", F.col("at").alias("around"), F.lit(0).alias("distance")).unionByName(scopes.lineage(tree, ["path"]).select("path", "at", F.col("ancestor").alias("around"), "distance"))
    functions = every.join(tree.where("kind = 'function'").select("path", F.col("at").alias("around"), "name"), ["path", "around"]).groupBy("path", "at").agg(F.min_by("name", "distance").alias("caller"))
    rows = said.select("path", F.col("at").alias("pos"), "line_no", F.get("args", F.lit(0)).cast("int").alias("said")).join(placed, ["path", "pos"]).join(functions, ["path", "at"], "left")
    return held(rows.select("path", "said", "line_no", "scope", F.col("caller").isNotNull().alias("in_function"), "caller"), copies)


@query(f"""WITH {_NESTING} SELECT a.path, a.item AS said, (row_number() OVER (PARTITION BY a.path, a.item ORDER BY b.item DESC) - 1)::INTEGER AS step, b.kind = 'function' AS braces
FROM nest a JOIN nest b ON a.path = b.path AND b.item <= a.item""")
def selection_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of brackets around each command, the innermost first."""
    found, _, copies = _scoped(spark, sf_dir)
    said = stored(scopes.nested_commands(found).where("name = 'echo'").select("path", F.col("at").alias("pos"), F.get("args", F.lit(0)).cast("int").alias("said")), "said")
    braces = scopes.compounds(scopes.statements(found)).where("kind = '{'").select("path", "at", "stop", F.lit(True).alias("braces"))
    brackets = stored(found.where("kind = 'nest' AND text IN ('(', '$(')").select("path", "at", "stop", F.lit(False).alias("braces")).unionByName(braces), "brackets")
    chains = scopes.selection_chains(said, brackets, ["path"]).join(brackets.select("path", "at", "braces"), ["path", "at"])
    return held(chains.join(said, ["path", "pos"]).select("path", "said", "step", "braces"), copies)


@query(f"""WITH RECURSIVE {_NAMES}, texts(k, i, said) AS (VALUES (0, 0, '1'), (2, 1, '2'), (3, 1, '3'), (3, 2, '4'), (4, 2, '5'), (5, 1, '6'), (6, 1, '7'), (7, 0, '8')),
vs AS (SELECT DISTINCT path, v FROM acting), said AS (SELECT path, first + i AS node, v, said FROM placed JOIN texts USING (k)),
open(path, node, v) AS (SELECT path, 1, v FROM vs UNION SELECT o.path, f.b, o.v FROM open o JOIN flow f ON f.path = o.path AND f.a = o.node
  WHERE NOT EXISTS (SELECT 1 FROM acting w WHERE w.path = o.path AND w.node = o.node AND w.v = o.v AND w.act = 'w')),
reach(path, node, v, said) AS (SELECT s.path, f.b, s.v, s.said FROM said s JOIN flow f ON f.path = s.path AND f.a = s.node
  UNION SELECT r.path, f.b, r.v, r.said FROM reach r JOIN flow f ON f.path = r.path AND f.a = r.node WHERE NOT EXISTS (SELECT 1 FROM acting w WHERE w.path = r.path AND w.node = r.node AND w.v = r.v AND w.act = 'w'))
SELECT path, node, name, literals, open, k IN (4, 7) AND open AS splits FROM (SELECT a.path, a.node, concat('v', a.v) AS name, (SELECT coalesce(string_agg(said, ',' ORDER BY said), '') FROM reach r WHERE r.path = a.path AND r.node = a.node AND r.v = a.v) AS literals,
  (a.path, a.node, a.v) IN (SELECT (path, node, v) FROM open) AS open, k
FROM (SELECT acting.*, placed.k FROM acting JOIN placed ON placed.path = acting.path AND placed.item = acting.line_no) a WHERE act = 'r')""")
def graph_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a read may have, whether they are all that it may have, and whether it may come apart if unquoted."""
    parts, copies = _named_parts(spark, sf_dir)
    found = whole.values(parts, *numbered(parts)).where("name LIKE 'v%' AND NOT guarded")
    return held(found.select("path", "node", "name", F.array_join("literals", ",").alias("literals"), "open", "splits"), copies)


# An item is a function f1 to f7 of its order: it writes or reads a name of its own and calls another one, always or perhaps.
_CALLS = f"""items AS (SELECT concat('order-', l_orderkey, '.sh') AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS})::INTEGER AS item, (1 + (l_partkey + l_linenumber) % 7)::INTEGER AS callee, (l_suppkey % 4)::INTEGER AS k FROM lineitem),
n AS (SELECT path, count(*) AS n FROM items GROUP BY path), called AS (SELECT items.*, callee <= n AS there FROM items JOIN n USING (path))"""
_BODIES_OF = ("f{i}() {{ w{i}=1; f{c}; }}", "f{i}() {{ echo \"$r{i}\"; t && f{c}; }}", "f{i}() {{ t || return; w{i}=1; f{c}; }}", "f{i}() {{ if t; then w{i}=1; else f{c}; w{i}=2; fi; echo $r{i}; }}")


def _calling_parts(spark: SparkSession, sf_dir: str) -> tuple[Parts, whole.Calls, Copies]:

    def make() -> tuple[Parts, whole.Calls, Copies]:
        items = table(spark, sf_dir, "lineitem").withColumn("item", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS.split(", "))))
        i, c = F.col("item").cast("string"), (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("string")
        text = F.get(F.array(*[F.lit(x.replace("{{", "{").replace("}}", "}")) for x in _BODIES_OF]), (F.col("l_suppkey") % 4).cast("int"))
        said = F.replace(F.replace(text, F.lit("{i}"), i), F.lit("{c}"), c)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", said.alias("text")))), lambda x: x["text"]), "\n")
        files = items.groupBy("l_orderkey").agg(body.alias("content")).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit(".sh")).alias("path"), "content")
        copies = distinct_texts(stored(files, "scripts"))
        parts = laid_out(copies.texts)
        return parts, whole.calls(parts), copies

    return remembered(spark, ("calling-parts", sf_dir), make)


def _calling(spark: SparkSession, sf_dir: str) -> tuple[dataflow.Names, DataFrame, Copies]:

    def make() -> tuple[dataflow.Names, DataFrame, Copies]:
        parts, _, copies = _calling_parts(spark, sf_dir)
        names = names_of_parts(parts)
        return names, stored(dataflow.call_sites(names.flow), "sites"), copies

    return remembered(spark, ("calling", sf_dir), make)


def _named(rows: DataFrame, functions: DataFrame, column: str) -> DataFrame:
    return rows.join(functions.select("path", F.col("number").alias(column), F.col("name").alias(f"{column}_name")), ["path", column])


def _by_name(rows: DataFrame, flow: Flow, column: str) -> DataFrame:
    return rows.join(flow.functions.select("path", F.col("root").alias(column), F.col("name").alias(f"{column}_name")), ["path", column])


@query(f"""WITH RECURSIVE {_CALLS}, reach(path, a, b) AS (SELECT path, item, callee FROM called WHERE there UNION SELECT r.path, r.a, c.callee FROM reach r JOIN called c ON c.path = r.path AND c.item = r.b WHERE c.there)
SELECT c.path, concat('f', c.item) AS function, concat('f', coalesce((SELECT min(least(r.b, c.item)) FROM reach r JOIN reach s ON s.path = r.path AND s.a = r.b AND s.b = r.a WHERE r.path = c.path AND r.a = c.item), c.item)) AS component FROM called c
WHERE there OR EXISTS (SELECT 1 FROM called d WHERE d.path = c.path AND d.there AND d.callee = c.item)""")
def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that call each other, directly or through others."""
    _, calls, copies = _calling_parts(spark, sf_dir)
    found, functions = whole.called(calls)[1], stored(calls.functions, "functions")
    return held(_named(_named(found, functions, "node"), functions, "component").select("path", F.col("node_name").alias("function"), F.col("component_name").alias("component")), copies)


@query(f"""WITH RECURSIVE {_CALLS}, reach(path, a, b) AS (SELECT path, item, item FROM called UNION SELECT r.path, r.a, c.callee FROM reach r JOIN called c ON c.path = r.path AND c.item = r.b WHERE c.there)
SELECT DISTINCT r.path, concat('f', r.a) AS function, concat('r', r.b) AS name FROM reach r JOIN called c ON c.path = r.path AND c.item = r.b WHERE c.k IN (1, 3)""")
def call_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that functions read, themselves or through the functions that they call."""
    parts, calls, copies = _calling_parts(spark, sf_dir)
    found = _named(whole.scope_reads(parts, calls).where("name RLIKE '^r[0-9]'"), calls.functions, "function")
    return held(found.select("path", F.col("function_name").alias("function"), "name"), copies)


@query(f"""WITH RECURSIVE {_CALLS}, gives(path, a, b) AS (SELECT path, item, item FROM called WHERE k IN (0, 3) UNION SELECT c.path, c.item, g.b FROM called c JOIN gives g ON g.path = c.path AND g.a = c.callee WHERE c.k = 0 AND c.there)
SELECT path, concat('f', a) AS function, concat('w', b) AS name FROM gives""")
def call_provides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that functions have written whichever way they end."""
    names, sites, copies = _calling(spark, sf_dir)
    found = _by_name(dataflow.provided(names, sites), names.flow, "root")
    return held(found.select("path", F.col("root_name").alias("function"), "name"), copies)


# Lines that say how a script is built badly or well, one for each item of an order; ends of files are for the last item.
_BUILT = (
    ("x; fi", ("C016",)), ("if x; then y; fi", ()), ("case $x in a*) y;; ab) z;; esac", ("C128", "C129")), ("case $x in ab) y;; a*) z;; esac", ()), ("until x; done", ("C146",)),
    ("if x; then y; else fi", ("C143",)), ("for i in a; do y; done", ("S020",)), ("for i in *.c; do y; done", ()), ("for i in a b; do y; done", ()), ("case $x in x|x) ;; esac", ("C128", "C129")),
)
_BUILT_CHOICE = f"(l_partkey + 3 * l_suppkey) % {len(_BUILT)}"


@query(f"""WITH built(k, code) AS (VALUES {", ".join(f"({k}, '{c}')" for k, (_, codes) in enumerate(_BUILT) for c in codes)}),
items AS (SELECT concat('order-', l_orderkey, '.sh') AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS})::INTEGER AS line_no, {_BUILT_CHOICE} AS k FROM lineitem)
SELECT path, line_no, code FROM items JOIN built USING (k)""")
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that match nothing, branches that are empty, loops over one word, and arms that never match."""
    files = stored(_scripts(spark, sf_dir, _BUILT_CHOICE, [text for text, _ in _BUILT]), "scripts")
    codes = tuple(sorted({c for _, found in _BUILT for c in found}))
    return diagnostics(files, select(RULES, codes)).select("path", "line_no", "code")
