"""Taint of expressions in a workflow file for each order, whose steps are its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.copies import distinct_texts, held
from corvid.operators.workflows import taints
from corvid.plans.registry import query
from corvid.plans.script_queries import _ITEM, _joined, _numbered
from corvid.sources.tables import table
from corvid.storage import stored

# A step for each kind of item; K is its number, P the one before, and the second part its only expression.
STEPS = (
    ("      - id: sK\n        env:\n          V: ${{ github.event.issue.title }}\n        run: echo \"o=$V\" >> $GITHUB_OUTPUT", "github.event.issue.title", "env.V"),
    ("      - id: sK\n        env:\n          V: ${{ steps.sP.outputs.o }}\n        run: |\n          : first\n          echo \"o=${V}\" >> \"$GITHUB_OUTPUT\"", "steps.sP.outputs.o", "env.V"),
    ("      - id: sK\n        run: echo \"o=${{ github.sha }}\" >> $GITHUB_OUTPUT", "github.sha", "run"),
    ("      - id: sK # the first one's\n        env:\n          V: \"${{ format('inputs.x {0}', steps['s0'].outputs.o) }}\"\n        run: echo \"o=$V\" >> $GITHUB_OUTPUT", "format('inputs.x {0}', steps['s0'].outputs.o)", "env.V"),
    ("      - run: echo \"W=${{ env.W }}x\" >> $GITHUB_ENV", "env.W", "run"),
    ("      - run: >-\n          echo \"W=ok\"\n          >> $GITHUB_ENV", None, None),
)
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_FOUND = f"""WITH RECURSIVE kinds(kind, expression, place) AS (VALUES {", ".join(f"({k}, {_quoted(e)}, {_quoted(p)})" for k, (_, e, p) in enumerate(STEPS))}),
items AS (SELECT l_orderkey, {_ITEM} - 1 AS k, (l_partkey + l_suppkey + l_linenumber) % {len(STEPS)} AS kind, o_orderstatus = 'F' AS open FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
states AS (SELECT l_orderkey, k, kind, open AS w, kind = 0 AS out, kind < 4 AS has, kind = 0 AS out0, kind < 4 AS has0, false AS out1, false AS has1 FROM items WHERE k = 0
UNION ALL SELECT i.l_orderkey, i.k, i.kind, s.w AND s.kind <> 5, CASE i.kind WHEN 0 THEN true WHEN 1 THEN s.out WHEN 3 THEN s.out0 ELSE false END, i.kind < 4, s.out0, s.has0, s.out, s.has
FROM states s JOIN items i ON i.l_orderkey = s.l_orderkey AND i.k = s.k + 1),
told AS (SELECT l_orderkey, k, CASE kind WHEN 0 THEN 'user' WHEN 2 THEN 'trusted' WHEN 4 THEN CASE WHEN w THEN 'user' ELSE 'trusted' END
WHEN 1 THEN CASE WHEN NOT has1 THEN 'unknown' WHEN out1 THEN 'user' ELSE 'trusted' END
ELSE CASE WHEN k = 0 OR NOT has0 THEN 'unknown' WHEN out0 THEN 'user' ELSE 'trusted' END END AS taint, kind FROM states)
SELECT concat('order-', l_orderkey, '.yml') AS path, concat('jobs.b.steps[', k, '].', place) AS address, 0::INTEGER AS seq, replace(expression, 'sP', concat('s', k - 1)) AS expression, taint FROM told JOIN kinds USING (kind) WHERE expression IS NOT NULL
UNION ALL SELECT DISTINCT concat('order-', l_orderkey, '.yml'), 'env.W', 0::INTEGER, 'github.head_ref', 'user' FROM items WHERE open"""


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the workflow of each order; its environment is of outsiders if the order is filled."""
    top = F.when(F.col("o_orderstatus") == "F", "${{ github.head_ref }}").otherwise("fixed")
    marked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("on: push\nenv:\n  W: "), top, F.lit("\njobs:\n  b:\n    runs-on: x\n    steps:")).alias("marker"))
    kind = ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(STEPS)).cast("int")
    text = F.get(F.array(*[F.lit(t) for t, _, _ in STEPS]), kind)
    number = lambda k: F.concat(F.lit("s"), k.cast("string"))
    steps = _numbered(spark, sf_dir).withColumn("text", F.replace(F.replace(text, F.lit("sK"), number(F.col("item") - 1)), F.lit("sP"), number(F.col("item") - 2)))
    return stored(_joined(steps.join(marked, "l_orderkey"), "text", "marker").withColumn("path", F.regexp_replace("path", "sh$", "yml")), "workflows")


@query(_FOUND)
def workflow_taints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expressions carry what outsiders write, through environments and outputs of steps."""
    copies = distinct_texts(workflows(spark, sf_dir))
    return held(taints(copies.texts).select("path", "address", "seq", "expression", "taint"), copies)
