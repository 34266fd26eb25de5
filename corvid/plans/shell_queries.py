"""Shell rules and names over written scripts, with what each should give, dealt out over tables.

Each customer has one of the single scripts, and each supplier a project of files that source each other, in folders of
their own; what is to be found is known for each script and joined to its customers or suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.shell import commands
from corvid.operators.copies import distinct_texts, held
from corvid.operators.layout import embedded_scripts, folding_ranges, rendered
from corvid.operators.lint import RULES, diagnostics, select
from corvid.operators.semantic import followed_files, overwritten_functions, resolve_commands, resolved_calls, shared_relations, uncalled_functions, undefined_variables, untracked_sources, unused_assignments
from corvid.plans.registry import query
from corvid.sources.tables import table
from corvid.storage import remembered, stored

# Path, content, and the expected findings as code and line.
SCRIPTS = (
    ("count.sh", "#!/bin/bash\ngrep x f | wc -l\ngrep -c x f\ngrep -o x f | wc -l\n", [("P002", 2)]),
    ("cd.sh", "cd /tmp\ncd /tmp || exit\nif cd /x; then :; fi\n", [("C004", 1)]),
    ("posix.sh", "#!/bin/sh\n[[ -n x ]]\n[ \"$a\" == b ]\nf() { local v=1; }\nlet x=1\ndeclare y\n", [("X001", 2), ("X002", 3), ("X003", 4), ("X015", 5), ("X016", 6)]),
    ("bash.bash", "#!/usr/bin/env bash\n[[ -n x ]]\n[ \"$a\" == b ]\nlet x=1\n", []),
    ("quote.sh", "rm $file\nrm \"$file\"\necho 'cost: $HOME'\necho \"$HOME\"\n", [("S001", 1), ("C005", 3)]),
    ("find.sh", "find . -name x | xargs rm\nfind . -print0 | xargs -0 rm\nfor f in $(find .); do :; done\n", [("C007", 1), ("C013", 3)]),
    ("joined.sh", "grep x \\\n  f | wc -l\nexit no\nexit 3\n", [("P002", 1), ("C047", 3)]),
    ("quiet.sh", "# lint: disable=C\ncd /tmp\nexit no\nread x\n", [("S002", 4)]),
    ("line.sh", "cd /a\ncd /b # lint: ignore=C004\n# lint: ignore=C004\ncd /c\ncd /d\n", [("C004", 1), ("C004", 5)]),
    ("first.sh", "#!bin/sh\n: # TODO fix\n: # TODO(me) fix\n", [("C060", 1), ("S082", 2)]),
    ("test.sh", "[ ]\n[x = y ]\n[ x = y]\nelse if true\n/* no */\n", [("C022", 1), ("C030", 2), ("C031", 3), ("C038", 4), ("C041", 5)]),
    ("more.sh", "x=`date`\nread -r y\nps | kill\ntrap \"rm $t\" EXIT\n[[ a =~ \"b\" ]]\nn=$(expr 1 + 2)\nexpr 1 + 2\na && b || c\necho x > a > b\necho ${10} $10\n{{cmd}} x\n", [("S005", 1), ("C046", 3), ("C008", 4), ("C009", 5), ("X001", 5), ("P001", 7), ("C010", 8), ("C051", 9), ("C025", 10), ("S001", 10), ("C061", 11)]),
    ("none.sh", None, []),
    ("empty.sh", "", []),
)


# The rules that these scripts are about.
ABOUT = tuple("C004 C005 C007 C008 C009 C010 C013 C022 C025 C030 C031 C038 C041 C046 C047 C051 C060 C061 P001 P002 X001 X002 X003 X004 X015 X016 S001 S002 S005 S082".split())


def scripts(spark: SparkSession) -> DataFrame:
    """The scripts themselves."""
    return spark.createDataFrame([s[:2] for s in SCRIPTS], "path string, content string")


_quoted = lambda x: "NULL" if x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _rows(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS t({columns})"


def _of_customers(rows: list[tuple], columns: str) -> str:
    """SQL for rows of scripts, the first column of which is the path, for each customer who has the script."""
    numbers = {s[0]: k for k, s in enumerate(SCRIPTS)}
    names = columns.split(", ")
    return f"SELECT concat('c-', c_custkey, '/', file) AS path, {', '.join(names[1:])} FROM customer JOIN {_rows([(numbers[r[0]], *r) for r in rows], 'k, file, ' + ', '.join(names[1:]))} ON c_custkey % {len(SCRIPTS)} = k"


def _of_suppliers(rows: list[tuple], columns: str, path: str = "path") -> str:
    """SQL for rows of the project, for each supplier; ``path`` is what of a row names a file."""
    return f"SELECT * REPLACE (concat('s-', s_suppkey, '/', {path}) AS {path}) FROM (SELECT s_suppkey, t.* FROM supplier, {_rows(rows, columns)})"


def dealt_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the script that each customer has."""
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c, _ in SCRIPTS])
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(key, F.get(known, (key % len(SCRIPTS)).cast("int")).alias("own"))
    return stored(own.select(F.concat(F.lit("c-"), key.cast("string"), F.lit("/"), "own.p").alias("path"), F.col("own.c").alias("content")), "scripts")


@query(_of_customers([(p, line, code) for p, _, found in SCRIPTS for code, line in found], "path, line_no, code"))
def shell_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules in the script that each customer has."""
    return diagnostics(dealt_scripts(spark, sf_dir), select(RULES, ABOUT)).select("path", "line_no", "code")


@query(_of_customers([("count.sh", 2, "grep", "wc"), ("count.sh", 4, "grep", "wc"), ("find.sh", 1, "find", "rm"), ("find.sh", 2, "find", "rm"), ("joined.sh", 1, "grep", "wc"), ("more.sh", 3, "ps", "kill")], "path, line_no, name, next_name"))
def shell_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that pipe into another."""
    copies = distinct_texts(dealt_scripts(spark, sf_dir))
    return held(commands(copies.texts).where("next_name IS NOT NULL").select("path", "line_no", "name", "next_name"), copies)


PROJECT = (
    ("main.sh", "#!/bin/bash\n. ./lib.sh\nused=1\nunused=2\nexport shared=3\nf() {\n  g\n  echo $used $missing ${maybe:-x}\n}\ng() { :; }\nf() {\n  echo '$quoted' # $comment\n}\nh() {\n  h\n}\nalias ll=ls\nf\nll\nrm x\ncd /\nnosuch\n./run\n"),
    ("lib.sh", "libvar=$used\nsource main.sh\nsource \"$dir/x\"\nsource gone.sh\n"),
    ("loop.sh", "for i in a b; do\n  if test $i; then\n    echo $i\n  else\n    n+=1\n  fi\ndone\n"),
)
HOST = ("ci.yml", "jobs:\n  a:\n    steps:\n      - name: Build\n        run: |\n          make all\n          echo ${{ github.event.issue.title }}\n\n          ls\n      - name: One\n        run: make test\n        env: x\n      - uses: y\n")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the project's files in a folder for each supplier."""
    files = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in PROJECT])
    dealt = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("folder"), F.explode(files).alias("f"))
    return stored(dealt.select(F.concat("folder", "f.p").alias("path"), F.col("f.c").alias("content")), "projects")


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return remembered(spark, ("projects", sf_dir), lambda: {"files": (files := projects(spark, sf_dir)), **shared_relations(files)})


_without_key = lambda sql: f"SELECT * EXCLUDE (s_suppkey) FROM ({sql})"


@query(_without_key(_of_suppliers([("main.sh", "unused", 4), ("lib.sh", "libvar", 1), ("loop.sh", "n", 5)], "path, name, line_no")))
def shell_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments that nothing reads, over files that source each other."""
    r = _relations(spark, sf_dir)
    return unused_assignments(r["bindings"], r["references"], r["source_edges"])


@query(_without_key(_of_suppliers([("main.sh", "missing", 8)], "path, name, line_no")))
def shell_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of names that nothing writes."""
    r = _relations(spark, sf_dir)
    return undefined_variables(r["bindings"], r["references"], r["source_edges"])


@query(_without_key(_of_suppliers([("main.sh", "g", 7, 10), ("main.sh", "h", 15, 14), ("main.sh", "f", 18, 11)], "path, name, line_no, definition")))
def shell_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition that each call sees."""
    r = _relations(spark, sf_dir)
    return resolved_calls(r["calls"], r["functions"])


@query(_without_key(_of_suppliers([("main.sh", "h", "uncalled"), ("main.sh", "f", "overwritten")], "path, name, why")))
def shell_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that nothing reaches, and definitions that are replaced before a call."""
    r = _relations(spark, sf_dir)
    gone = overwritten_functions(r["calls"], r["functions"]).select("path", "name", F.lit("overwritten").alias("why"))
    return uncalled_functions(r["calls"], r["functions"]).withColumn("why", F.lit("uncalled")).unionByName(gone)


@query("SELECT CASE WHEN path = 'gone.sh' THEN path ELSE concat('s-', s_suppkey, '/', path) END AS path, what FROM supplier, " + _rows([("main.sh", "followed"), ("lib.sh", "followed")], "path, what") + " UNION ALL SELECT 'gone.sh', 'followed' UNION ALL SELECT 'gone.sh', 'untracked' FROM supplier")
def shell_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that sourcing reaches from the main scripts, and operands that name no input."""
    r = _relations(spark, sf_dir)
    lost = untracked_sources(r["source_edges"], r["files"]).select(F.col("target").alias("path"), F.lit("untracked").alias("what"))
    return followed_files(r["files"].where("path LIKE '%/main.sh'"), r["source_edges"]).withColumn("what", F.lit("followed")).unionByName(lost)


# A supplier's number of a folder decides which commands are executables there.
@query("SELECT concat('s-', s_suppkey, '/main.sh') AS path, name, kind, folder FROM supplier, " + _rows([(n, k, None) for n, k in (("f", "function"), ("g", "function"), ("h", "function"), ("ll", "alias"), ("cd", "builtin"), ("./run", "dynamic"), (".", "builtin"), ("echo", "builtin"), (":", "builtin"), ("alias", "builtin"), ("export", "builtin"))], "name, kind, folder") + """
UNION ALL SELECT concat('s-', s_suppkey, '/main.sh'), name, CASE WHEN k IS NULL THEN 'unknown' ELSE 'executable' END, 'n' || k FROM supplier, (SELECT t.name, min(n_nationkey) AS k FROM (VALUES ('rm', 1), ('nosuch', 99)) AS t(name, m) LEFT JOIN nation ON n_nationkey % 3 = m GROUP BY t.name)""")
def shell_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command names of the main scripts stand for; every third nation is a folder that has ``rm``."""
    r = _relations(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    host = nation.select(F.col("n_nationkey").alias("dir_idx"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), F.get(F.array(F.lit("ls"), F.lit("rm"), F.lit("x")), F.col("n_nationkey") % 3).alias("name"))
    return resolve_commands(r["commands"].where("path LIKE '%/main.sh'"), r["functions"].where("path LIKE '%/main.sh'"), host)


@query(_without_key(_of_suppliers([("loop.sh", 1, 7), ("loop.sh", 2, 4), ("loop.sh", 4, 6), ("main.sh", 6, 9), ("main.sh", 11, 13), ("main.sh", 14, 16)], 'path, "start", "end"')))
def shell_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of several lines."""
    return folding_ranges(_relations(spark, sf_dir)["files"])


@query("SELECT concat('s-', s_suppkey, '/', path) AS path, host_line, label, script, tainted FROM supplier, (VALUES ('ci.yml', 5::INTEGER, 'Build', 'make all' || chr(10) || 'echo ${{ github.event.issue.title }}' || chr(10) || chr(10) || 'ls', true), ('ci.yml', 11, 'One', 'make test', false)) AS t(path, host_line, label, script, tainted)")
def shell_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that a workflow file of each supplier embeds."""
    hosts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"), F.lit("/"), F.lit(HOST[0])).alias("path"), F.lit(HOST[1]).alias("content"))
    return embedded_scripts(hosts)


@query("SELECT concat(path, ':', line_no, ':1: warning: [', code, ']') AS value FROM (" + _of_customers([("count.sh", 2, "P002"), ("cd.sh", 1, "C004")], "path, line_no, code") + ")")
def shell_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics as compilers print them."""
    files = dealt_scripts(spark, sf_dir).where("path LIKE '%/count.sh' OR path LIKE '%/cd.sh'")
    return rendered(diagnostics(files, select(RULES, ABOUT)), "gcc")
