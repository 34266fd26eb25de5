"""Findings that directives leave, in a script for each order; an item is a few lines, of which SQL knows what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.lint import RULES, diagnostics, select
from corvid.plans.registry import query
from corvid.plans.script_queries import _ITEM, _joined, _numbered
from corvid.sources.tables import table
from corvid.storage import stored

# Lines of an item, and the line (from 0) and code of what is left of its findings.
PIECES = (
    ("cd /a", ((0, "C004"),)),
    ("# shellcheck disable=SC2164\ncd /b\ncd /c", ((2, "C004"),)),
    ("# shellcheck disable=SC2162,2164\n# why\nif t; then\n  cd /d\n  read x\nfi\nread y", ((6, "S002"),)),
    ("# shellcheck source=/dev/null disable=all\n\nwhile t; do\n  { read x; cd /e; }\ndone", ()),
    ("cd /f # shellcheck disable=SC2164", ((0, "C004"),)),
    ("# shellcheck disable=SC9999\nread z", ((1, "S002"),)),
    ("# lint: disable=S,SC2164\nread x \\\n  y\nread z\ncd /z", ((3, "S002"), (4, "C004"))),
    ("read v # lint: ignore=2162", ()),
)
_FOUND = f"""WITH pieces(kind, n_lines) AS (VALUES {", ".join(f"({k}, {t.count(chr(10)) + 1})" for k, (t, _) in enumerate(PIECES))}),
left_(kind, line, code) AS (VALUES {", ".join(f"({k}, {line}, '{code}')" for k, (_, found) in enumerate(PIECES) for line, code in found)}),
items AS (SELECT l_orderkey, {_ITEM} AS item, (l_partkey + l_suppkey + l_linenumber) % {len(PIECES)} AS kind FROM lineitem),
placed AS (SELECT l_orderkey, kind, 4 + coalesce(sum(n_lines) OVER (PARTITION BY l_orderkey ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM items JOIN pieces USING (kind))
SELECT concat('order-', l_orderkey, '.sh') AS path, (first + line)::INTEGER AS line_no, code FROM placed JOIN left_ USING (kind) JOIN orders ON o_orderkey = l_orderkey WHERE NOT (code = 'S002' AND o_orderstatus = 'F')"""


@query(_FOUND)
def directive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What directives of two notations leave; filled orders' scripts begin with one for the whole file."""
    said = F.when(F.col("o_orderstatus") == "F", "# shellcheck disable=SC2162").otherwise("# a script")
    marked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("#!/bin/bash\n"), said, F.lit("\n:")).alias("marker"))
    text = F.get(F.array(*[F.lit(t) for t, _ in PIECES]), ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(PIECES)).cast("int"))
    files = stored(_joined(_numbered(spark, sf_dir).withColumn("text", text).join(marked, "l_orderkey"), "text", "marker"), "scripts")
    return diagnostics(files, select(RULES, ("C004", "S002"))).select("path", "line_no", "code")
