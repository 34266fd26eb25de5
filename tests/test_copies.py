"""Texts that several files have are analysed once, and every file gets what is found in its text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.functions.lexer import tokens
from corvid.operators.copies import distinct_texts, held
from corvid.storage import stored

FILES = [("a.sh", "x\ny"), ("b.sh", "x\ny"), ("c.bash", "x\ny"), ("d.sh", ""), ("e.sh", None), ("f.sh", None), ("g.sh", "x")]


def test_each_text_once(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    copies = distinct_texts(files)
    assert Counter(r.content for r in copies.texts.collect()) == Counter(["x\ny", "", None, "x"])
    assert sorted((r.path, r.content) for r in copies.holders.join(copies.texts.select(F.col("path").alias("_text"), "content"), "_text").collect()) == sorted(FILES)
    named = distinct_texts(files, endings=True)
    assert Counter((r.path.split(".")[-1], r.content) for r in named.texts.collect()) == Counter([("sh", "x\ny"), ("bash", "x\ny"), ("sh", ""), ("sh", None), ("sh", "x")])


def test_files_get_what_their_text_gives(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    copies = distinct_texts(files)
    keep = ["path", "at", "line_no", "kind", "text"]
    assert sorted(map(tuple, held(tokens(copies.texts), copies).select(*keep).collect())) == sorted(map(tuple, tokens(files).select(*keep).collect()))


def test_only_small_tables_go_to_all_executors(spark):
    # Keys that repeat make small files of many rows.
    many = stored(spark.range(1_000_000).select(F.concat(F.lit("order-"), (F.col("id") % 150_000).cast("string")).alias("path"), "id"), "many")
    few = stored(spark.range(10).select(F.concat(F.lit("order-"), F.col("id").cast("string")).alias("path")), "few")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    others = many.select("path", F.col("id").alias("other")).where("other % 7 = 0")
    assert "BroadcastHashJoin" not in plan(many.join(others, "path"))
    assert many.join(few, "path").count() == 70


def test_nested_scopes_of_equal_orders(spark, tmp_path):
    """Two hundred orders of the same five items: one text."""
    from corvid.plans.graph_queries import _nesting, scope_ancestors

    row = "CAST(id AS long) AS l_orderkey, CAST(k AS long) AS l_partkey, 1L AS l_suppkey, CAST(k AS int) AS l_linenumber, 1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax"
    spark.range(200).crossJoin(spark.range(5).toDF("k")).selectExpr(*row.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert _nesting(spark, str(tmp_path)).texts.count() == 1
    got = scope_ancestors(spark, str(tmp_path)).groupBy("scope", "ancestor", "distance").count().collect()
    assert sorted(map(tuple, got)) == [(a, b, a - b, 200) for a in range(1, 6) for b in range(a)]


def test_findings_of_equal_files(spark):
    """Rules see each text once, by ending; where texts source files, it matters which file has them."""
    from corvid.operators.lint import RULES, diagnostics, select

    text, other = "cd /a\n[[ -n x ]]\n", "cd /b\nv=1\n"
    rows = [("a.sh", text), ("b.sh", text), ("c.bash", text), ("d.sh", other), ("e.sh", other), ("f.sh", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    got = lambda files, *codes: sorted((r.path, r.line_no, r.code) for r in diagnostics(files, select(RULES, codes)).collect())
    assert got(files, "C004", "X001") == [("a.sh", 1, "C004"), ("a.sh", 2, "X001"), ("b.sh", 1, "C004"), ("b.sh", 2, "X001"), ("c.bash", 1, "C004"), ("d.sh", 1, "C004"), ("e.sh", 1, "C004")]
    assert got(files, "C001") == [("d.sh", 2, "C001"), ("e.sh", 2, "C001")]
    tied = spark.createDataFrame([*rows, ("g.sh", ". d.sh\necho $v\n")], "path string, content string")
    assert got(tied, "C001") == [("e.sh", 2, "C001")]
    assert got(files, "nothing") == []


def test_written_scripts_are_looked_into_once(spark, tmp_path, monkeypatch):
    """A thousand customers have fourteen written scripts: that many texts go to the rules, whatever the customers."""
    from corvid.operators import lint
    from corvid.operators.lint import RULES, select
    from corvid.plans.shell_queries import SCRIPTS, dealt_scripts

    spark.range(1000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    seen, whole = [], lint._diagnosed
    monkeypatch.setattr(lint, "_diagnosed", lambda files, *rest: seen.append(files.count()) or whole(files, *rest))
    found = lint.diagnostics(dealt_scripts(spark, str(tmp_path)), select(RULES, ("C004", "P002")))
    assert found.where("code = 'P002'").count() > 100
    assert seen == [len(SCRIPTS)]


ITEM = ("id AS l_orderkey", "k AS l_partkey", "1L AS l_suppkey", "CAST(k AS int) AS l_linenumber", "1D AS l_extendedprice", "IF(k = 2, 0.1D, 0D) AS l_discount", "0D AS l_tax", "IF(k = 1, 'A', 'N') AS l_returnflag", "'O' AS l_linestatus")


@pytest.fixture(scope="module")
def equal_orders(spark, tmp_path_factory):
    """Two hundred filled orders of the same five items."""
    folder = tmp_path_factory.mktemp("equal")
    spark.range(200).crossJoin(spark.range(5).toDF("k")).selectExpr(*ITEM).write.parquet(str(folder / "lineitem.parquet"))
    spark.range(200).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus").write.parquet(str(folder / "orders.parquet"))
    return str(folder)


def test_flow_of_equal_functions(spark, equal_orders):
    """One shape: its blocks are there once, and every function has what follows from them."""
    from corvid.plans import flow_queries

    blocks, edges, holders = flow_queries.blocks_and_edges(spark, equal_orders)
    assert sorted((r.block, r.n, r.covers) for r in blocks.collect()) == [(k + 1, 5, k == 2) for k in range(5)]
    assert sorted((r.a, r.b) for r in edges.collect()) == [(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)]
    assert holders.count() == 200
    assert Counter((r.block, r["def"]) for r in flow_queries.reaching_cfg(spark, equal_orders).collect()) == Counter({(b, d): 200 for b, d in ((2, 1), (3, 1), (4, 1), (3, 2), (4, 2), (4, 3), (5, 2), (5, 4))})
    assert Counter(r.covered for r in flow_queries.cover_paths(spark, equal_orders).collect()) == Counter({False: 200})


def test_equal_workflows_and_cases(spark, equal_orders, monkeypatch):
    from corvid.plans import workflow_queries, workspace_queries

    seen, taints, arms = [], workflow_queries.taints, workspace_queries.patterns.case_arms
    monkeypatch.setattr(workflow_queries, "taints", lambda hosts: (seen.append(hosts.count()), taints(hosts))[1])
    monkeypatch.setattr(workspace_queries.patterns, "case_arms", lambda found: (seen.append(found.select("path").distinct().count()), arms(found))[1])
    assert set(Counter((r.address, r.taint) for r in workflow_queries.workflow_taints(spark, equal_orders).collect()).values()) == {200}
    assert {r.path.split("-")[0] for r in workspace_queries.case_reachability(spark, equal_orders).collect()} <= {"order"}
    assert seen == [1, 1]


def test_equal_invocations(spark, equal_orders, monkeypatch):
    from corvid.plans import grammar_queries

    seen, validated = [], grammar_queries.validated
    monkeypatch.setattr(grammar_queries, "validated", lambda asked, grammars: (seen.append(asked.count()), validated(asked, grammars))[1])
    assert grammar_queries.grammar_verdicts(spark, equal_orders).count() == 200
    assert seen == [len(set(grammar_queries.ASKED))]


def test_projects_are_looked_into_once(spark, tmp_path, monkeypatch):
    """Three files for each supplier, whatever the suppliers; what they source is found in each folder."""
    from corvid.operators import semantic
    from corvid.plans.shell_queries import PROJECT, projects, shell_undefined

    spark.range(300).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    seen, commands = [], semantic.commands
    monkeypatch.setattr(semantic, "commands", lambda files: seen.append(files.count()) or commands(files))
    assert {(r.path, r.name, r.line_no) for r in shell_undefined(spark, str(tmp_path)).collect()} == {(f"s-{k}/main.sh", "missing", 8) for k in range(300)}
    assert seen == [len(PROJECT)]
    files = projects(spark, str(tmp_path)).where("path LIKE 's-1%'")
    shared, whole = semantic.shared_relations(files), semantic.script_relations(files)
    assert shared.keys() == whole.keys()
    for name in whole:
        assert Counter(map(str, shared[name].select(*whole[name].columns).collect())) == Counter(map(str, whole[name].collect())), name
