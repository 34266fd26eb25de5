"""Shell facts: lines, words, commands, selection and suppression."""

from pyspark.sql import functions as F

from corvid.functions.shell import commands, dialect_of, logical_lines
from corvid.operators.layout import formatted, rendered, with_ignores
from corvid.operators.lint import RULES, diagnostics, select
from corvid.operators.semantic import references
from corvid.plans.shell_queries import scripts


def facts(spark, text):
    return [(r.line_no, r.before, r["name"], list(r.args), list(r.redirects), list(r.assigned)) for r in commands(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("line_no", "seg_no").collect()]


def test_commands(spark):
    assert facts(spark, "a 'x | y' \"z; $(b | c)\" | d >f 2>&1 # e | f") == [(1, "", "a", ["'x | y'", '"z; $(b | c)"'], [], []), (1, "|", "d", [], [">f", "2>&1"], [])]
    assert facts(spark, "X=1 a b\nif c; then sudo -u x d; fi") == [(1, "", "a", ["b"], [], ["X=1"]), (2, "", "c", [], [], []), (2, ";", "sudo", ["-u", "x", "d"], [], []), (2, ";", None, [], [], [])]


def test_continued_lines_keep_their_numbers(spark):
    files = spark.createDataFrame([("f", "a \\\nb\nc\\\n\\\nd\ne"), ("g", None)], "path string, content string")
    assert [(r.line_no, r.line) for r in logical_lines(files).orderBy("line_no").collect()] == [(1, "a  b"), (3, "c  d"), (6, "e")]


def test_dialects(spark):
    rows = [("a.sh", "#!/usr/bin/env bash\n"), ("b", "#!/bin/dash"), ("c.zsh", ""), ("d", "x"), ("e", None)]
    df = spark.createDataFrame(rows, "p string, c string")
    assert [r[0] for r in df.select(dialect_of(F.col("p"), F.col("c"))).collect()] == ["bash", "dash", "zsh", "unknown", "unknown"]


def test_selection_only_removes(spark):
    all_ = {tuple(r) for r in diagnostics(scripts(spark)).collect()}
    some = {tuple(r) for r in diagnostics(scripts(spark), select(RULES, ("C", "P"), ("C0",))).collect()}
    assert some == {r for r in all_ if r[2].startswith(("P", "C1"))}
    assert len({r.code for r in RULES}) == len(RULES)


def test_formatting_indents_and_is_idempotent(spark):
    rows = [("a", "if x; then  \n      y\nelse\nz\nfi\n\n\n\nf() {\nw\n}\n"), ("b", "cat <<E\n   x\nE"), ("c", None), ("d", ""), ("e", "echo 'a\n  b'")]
    files = spark.createDataFrame(rows, "path string, content string")
    once = formatted(files)
    got = {r.path: (r.content, r.changed) for r in once.collect()}
    assert got["a"] == ("if x; then\n  y\nelse\n  z\nfi\n\nf() {\n  w\n}\n", True)
    assert got["b"] == (rows[1][1], False) and got["c"] == (None, None) and got["d"] == ("", False)
    assert {r.path: r.content for r in formatted(once.select("path", "content")).collect()} == {k: v[0] for k, v in got.items()}


def test_written_ignores_leave_nothing_to_report(spark):
    files = scripts(spark).where("path IN ('test.sh', 'quote.sh', 'cd.sh')")
    assert diagnostics(with_ignores(files, diagnostics(files))).count() == 0


def test_reports_are_in_order(spark):
    found = spark.createDataFrame([("b", 1, "C1", "error"), ("a<", 10, "C2", "hint"), ("a<", 9, "C2", "hint")], "path string, line_no int, code string, severity string")
    assert [r[0] for r in rendered(found, "tty").collect()] == ["a< line 9: C2 (hint)", "a< line 10: C2 (hint)", "b line 1: C1 (error)"]
    assert rendered(found, "json").first()[0] == '{"file":"a<","line":9,"level":"hint","code":"C2"}'
    assert rendered(found, "checkstyle").count() == rendered(found, "gcc").count() == 3


def test_words_of_a_megabyte(spark):
    m = 1_000_000
    texts = ['echo "' + "x" * m + '" $y', "echo " + "y" * m, "echo $(" + "z " * (m // 2) + ") w", "echo '" + "q" * m + "'", 'echo "' + r"\x" * (m // 2) + '"']
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string").repartition(4)
    got = {r.path: (r["name"], [len(a) for a in r.args]) for r in commands(files).collect()}
    assert got == {"0": ("echo", [m + 2, 2]), "1": ("echo", [m]), "2": ("echo", [m + 3, 1]), "3": ("echo", [m + 2]), "4": ("echo", [m + 2])}
    assert [tuple(r) for r in references(files).select("path", "name").collect()] == [("0", "y")]
