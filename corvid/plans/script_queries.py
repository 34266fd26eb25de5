"""Rules, names and flow over thousands of generated scripts: an order is a script, and its items are its lines.

The scripts' text comes from the tables by a rule, and SQL says from the same tables what is to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.shell import commands
from corvid.operators import semantic
from corvid.operators.copies import Copies, distinct_texts, held
from corvid.operators.facts import options
from corvid.operators.fixes import fixed_lines
from corvid.operators.flow import edges, nodes, unreachable
from corvid.operators.lint import RULES, diagnostics, select
from corvid.plans.registry import query
from corvid.sources.tables import table
from corvid.storage import stored

# One line each; an item's is told by its keys.
SNIPPETS = (
    "cd /srv/data", "cd /srv/data || exit 1", "grep error log | wc -l", "grep -c error log", "read line", "read -r line", "x=`date`", "x=$(date)", "rm $file", 'rm "$file"',
    "[[ -n $x ]]", '[ "$x" == y ]', "local v=1", "let n=1", "exit no", "exit 3", "ps | grep ssh", "echo -n done", "find . -name x | xargs rm", ": # TODO fix this", "expr 1 + 2",
    "egrep x f", "source /lib/x", "set -o pipefail", "cd /tmp # lint: ignore=C004", "rm -rf /", "trap 'x' 2", "su root", "tr a-z b", "sudo echo x >/etc/f",
)
# What SQL looks for: code, whether in scripts for sh only, a pattern, and one that excuses.
EXPECTED = (
    ("C004", False, r"^cd [^|&]*$", r"\|\|"), ("P002", False, r"^grep .*\| wc -l$", r"grep -[co]"), ("S002", False, r"^read ", r" -r"), ("S005", False, r"`", "^$"),
    ("S001", False, r"^rm \$", "^$"), ("X001", True, r"^\[\[", "^$"), ("X002", True, r"^\[ .* == ", "^$"), ("C014", False, r"^local ", "^$"), ("X003", True, r"^local ", "^$"),
    ("X015", True, r"^let ", "^$"), ("C047", False, r"^exit [a-z]", "^$"), ("S012", False, r"^ps \| grep", "^$"), ("X027", True, r"^echo -[neE]", "^$"), ("C007", False, r"^find .*\| xargs", r"-0"),
    ("S082", False, r"# TODO", r"TODO\("), ("P001", False, r"^expr .* [+*/-] ", "^$"), ("S060", False, r"^egrep ", "^$"), ("X031", True, r"^source ", "^$"), ("X021", True, r"pipefail", "^$"),
    ("K006", False, r"^rm -rf /$", "^$"), ("S068", False, r"^trap .* [0-9]+$", "^$"), ("S054", False, r"^su ", r" -"), ("X028", False, r"^tr a-z", "^$"), ("S049", False, r"^tr [a-z]-", "^$"),
    ("C015", False, r"^sudo .* >/etc", "^$"),
)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_ITEM = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax)"
_LINES = f"""snippets(k, line) AS (VALUES {", ".join(f"({k}, {_quoted(x)})" for k, x in enumerate(SNIPPETS))}),
items AS (SELECT l_orderkey, {_ITEM} AS item, (l_partkey + l_suppkey + l_linenumber) % {len(SNIPPETS)} AS k FROM lineitem),
lines AS (SELECT concat('order-', l_orderkey, '.sh') AS path, (item + 1)::INTEGER AS line_no, line, k, o_orderstatus = 'F' AS posix FROM items JOIN snippets USING (k) JOIN orders ON o_orderkey = l_orderkey)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").withColumn("item", F.row_number().over(order))


def _joined(lines: DataFrame, text: str, marker: str) -> DataFrame:
    """``path`` and ``content`` of one script for each order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", F.col(text).alias("text")))), lambda x: x["text"]), "\n")
    return lines.groupBy("l_orderkey").agg(body.alias("body"), F.first(marker).alias("marker")).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit(".sh")).alias("path"), F.concat("marker", F.lit("\n"), "body", F.lit("\n")).alias("content"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each order, for sh if it is filled and else for bash; each item is a snippet."""
    marked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "#!/bin/sh").otherwise("#!/bin/bash").alias("marker"))
    snippets = F.array(*[F.lit(x) for x in SNIPPETS])
    text = F.get(snippets, ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(SNIPPETS)).cast("int"))
    return stored(_joined(_numbered(spark, sf_dir).withColumn("text", text).join(marked, "l_orderkey"), "text", "marker"), "scripts")


_FOUND = f"""{_LINES}, expected(code, only_posix, pattern, excuse) AS (VALUES {", ".join(f"('{c}', {str(p).lower()}, {_quoted(a)}, {_quoted(b)})" for c, p, a, b in EXPECTED)}),
hits AS (SELECT k, code, only_posix FROM snippets, expected WHERE regexp_matches(line, pattern) AND NOT regexp_matches(line, excuse) AND NOT regexp_matches(line, concat('lint: ignore=', code))),
found AS (SELECT path, line_no, code FROM lines JOIN hits USING (k) WHERE posix OR NOT only_posix)"""


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(generated(spark, sf_dir), select(RULES, tuple(sorted({c for c, _, _, _ in EXPECTED}))))


@query(f"WITH {_FOUND} SELECT * FROM found")
def script_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of 25 rules in a script for each order."""
    return _diagnosed(spark, sf_dir).select("path", "line_no", "code")


@query(f"WITH {_FOUND} SELECT path, count(*) AS n_found, count(*) FILTER (code IN ('C014', 'C047')) AS n_errors, CASE WHEN count(*) FILTER (code IN ('C014', 'C047')) > 0 THEN 2 ELSE 1 END::INTEGER AS status FROM found GROUP BY path")
def script_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each script with findings exits with: 2 with errors, else 1."""
    errors = F.count_if(F.col("severity") == "error")
    return _diagnosed(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_found"), errors.alias("n_errors"), F.when(errors > 0, 2).otherwise(1).alias("status"))


_MENDED = (("S002", "^read ", "read -r "), ("S005", "`([^`]*)`", "$(\\1)"), ("S049", "^tr ([a-z]-[a-z])", "tr '\\1'"), ("S060", "^egrep ", "grep -E "), ("S068", " 2$", " INT"), ("X002", " == ", " = "), ("X031", "^source ", ". "))


@query(f"""WITH {_FOUND}, mended(code, pattern, instead) AS (VALUES {", ".join(f"('{c}', {_quoted(p)}, {_quoted(i)})" for c, p, i in _MENDED)})
SELECT path, line_no, line AS before, regexp_replace(line, pattern, instead) AS after FROM found JOIN mended USING (code) JOIN lines USING (path, line_no)""")
def script_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fixes change, and what they become."""
    copies = distinct_texts(generated(spark, sf_dir), endings=True)
    found = diagnostics(copies.texts, select(RULES, tuple(c for c, _, _ in _MENDED)))
    return held(fixed_lines(copies.texts, found), copies)


@query(f"""WITH {_LINES}, given AS (SELECT path, line_no, regexp_extract(line, '(sudo |xargs )?([a-z]+)', 2) AS command, unnest(regexp_extract_all(line, '^[^|#]* -([a-zA-Z]+)', 1)) AS flag FROM lines WHERE regexp_matches(line, '^(grep|read|set|find|echo) -|^find ') OR regexp_matches(line, '^rm -')),
letters AS (SELECT path, line_no, command, unnest(CASE WHEN command = 'find' THEN [flag] ELSE string_split(flag, '') END) AS option FROM given)
SELECT DISTINCT path, line_no, command, option FROM letters""")
def script_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options that commands are given, letter by letter."""
    copies = distinct_texts(generated(spark, sf_dir))
    found = options(commands(copies.texts)).where(F.col("command").isin("grep", "read", "set", "find", "echo", "rm"))
    return held(found.select("path", "line_no", "command", "option").distinct(), copies)


@query(f"WITH {_LINES} SELECT path, line_no, regexp_extract(line, '^[a-z]+') AS name, regexp_replace(regexp_extract(line, '[|] (xargs )?([a-z]+)', 0), '[|] (xargs )?', '') AS next_name FROM lines WHERE regexp_matches(line, '[^|] [|] [^|]')")
def script_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that pipe into another."""
    copies = distinct_texts(generated(spark, sf_dir))
    return held(commands(copies.texts).where("next_name IS NOT NULL").select("path", "line_no", "name", "next_name"), copies)


_NAMED = f"""named AS (SELECT concat('order-', l_orderkey, '.sh') AS path, ({_ITEM} + 1)::INTEGER AS line_no, l_returnflag = 'N' AS writes, CASE WHEN l_returnflag = 'N' THEN l_suppkey % 7 ELSE l_partkey % 7 END AS v FROM lineitem)"""


@query(f"""WITH {_NAMED} SELECT path, max(line_no) AS line_no, 'C001' AS code FROM named n WHERE writes AND NOT EXISTS (SELECT 1 FROM named r WHERE r.path = n.path AND r.v = n.v AND NOT r.writes) GROUP BY path, v
UNION ALL SELECT path, line_no, 'C006' FROM named n WHERE NOT writes AND NOT EXISTS (SELECT 1 FROM named w WHERE w.path = n.path AND w.v = n.v AND w.writes)""")
def script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments that nothing reads and reads that nothing assigns, in a script for each order."""
    name = F.concat(F.lit("v"), (F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")).otherwise(F.col("l_partkey")) % 7).cast("string"))
    text = F.when(F.col("l_returnflag") == "N", F.concat(name, F.lit("=1"))).otherwise(F.concat(F.lit('echo "$'), name, F.lit('"')))
    files = stored(_joined(_numbered(spark, sf_dir).withColumns({"text": text, "marker": F.lit("#!/bin/bash")}), "text", "marker"), "scripts")
    copies = distinct_texts(files, endings=True)
    r = semantic.script_relations(copies.texts)
    # Where texts source files, it matters which file has them.
    alone = r["source_edges"].isEmpty()
    r = r if alone else semantic.script_relations(files)
    unused = semantic.unused_assignments(r["bindings"], r["references"], r["source_edges"]).select("path", "line_no", F.lit("C001").alias("code"))
    undefined = semantic.undefined_variables(r["bindings"], r["references"], r["source_edges"]).select("path", "line_no", F.lit("C006").alias("code"))
    # The line of a name that is never written is one finding, however many such names it has.
    found = unused.unionByName(undefined.distinct())
    return held(found, copies) if alone else found


# An item is five commands: a branch, a loop that is left, or five in a row.
_BLOCKS = {"A": "if t\nthen x\nelse y\nfi\n:", "R": "while t\ndo x\nbreak\ny\ndone", "N": "v=1\nx\ny\nz\n:"}
_STEPS = {"A": ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5)), "R": ((0, 1), (0, 5), (1, 2), (2, 5), (3, 4), (4, 0)), "N": ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5))}
_FLOW = f"""items AS (SELECT concat('order-', l_orderkey, '.sh') AS path, 5 * {_ITEM} - 4 AS first, 5 * count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS kind FROM lineitem),
steps(kind, a, b) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, steps in _STEPS.items() for a, b in steps)})"""


def flowing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Copies]:
    """path, node and what else ``nodes`` gives of each text of scripts with branches and loops, one for each order; and which has which."""
    text = F.create_map(*[F.lit(x) for kind in _BLOCKS.items() for x in kind])[F.col("l_returnflag")]
    files = _joined(_numbered(spark, sf_dir).withColumns({"text": text, "marker": F.lit("#!/bin/bash")}), "text", "marker")
    copies = distinct_texts(stored(files, "scripts"))
    return stored(nodes(commands(copies.texts)), "nodes"), copies


@query(f"WITH {_FLOW} SELECT path, (first + a)::INTEGER AS a, (first + b)::INTEGER AS b FROM items JOIN steps USING (kind) WHERE first + b <= n")
def script_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which command may run after which."""
    rows, copies = flowing(spark, sf_dir)
    return held(edges(rows), copies)


@query(f"WITH {_FLOW} SELECT path, (first + k)::INTEGER AS node FROM items, (VALUES (3), (4)) AS t(k) WHERE kind = 'R'")
def script_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that no path reaches, as those behind a ``break``."""
    rows, copies = flowing(spark, sf_dir)
    return held(unreachable(rows, stored(edges(rows), "edges")).select("path", "node"), copies)
