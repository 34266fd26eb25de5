"""Control flow and data flow: an order is a function, and its lines are blocks.

Lines are numbered in order. Each leads to the next; a line whose flag is ``A`` also skips one, and
the last line of an order that holds an open line leads back to the first. A line writes the name
of its flag and reads that of its status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators.copies import distinct_texts
from corvid.operators.fixpoint import live, reachable, reaching
from corvid.plans.interval_queries import events
from corvid.plans.registry import query
from corvid.sources.tables import table
from corvid.storage import stored

_BLOCKS = """b AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax)::INTEGER AS block,
  l_returnflag AS name, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS used, l_discount, count(*) OVER (PARTITION BY l_orderkey)::INTEGER AS n, bool_or(l_linestatus = 'O' AND l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS loops FROM lineitem),
e AS (SELECT fn, block AS a, block + 1 AS b FROM b WHERE block < n UNION SELECT fn, block, block + 2 FROM b WHERE name = 'A' AND block + 2 <= n UNION SELECT fn, n, 1 FROM b WHERE loops AND block = n)"""


def blocks_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks and edges of functions, each shape of one once; and which function (``fn``) has which shape (``shape``, which is ``fn`` of the others).

    A shape is all that blocks have, in order, so functions of one shape have the same flow, names and cover.
    """
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    used = F.when(F.col("l_linestatus") == "O", "N").otherwise("R")
    told = F.struct(*keys, F.col("l_returnflag").alias("name"), used.alias("used"), (F.col("l_discount") >= 0.09).alias("covers"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("open"))
    rows = F.transform(F.array_sort(F.collect_list(told)), lambda x: F.struct(x["name"].alias("name"), x["used"].alias("used"), x["covers"].alias("covers"), x["open"].alias("open")))
    functions = stored(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fn")).agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("content")).withColumnRenamed("fn", "path"), "functions")
    copies = distinct_texts(functions)
    one = F.from_json("content", "array<struct<name:string,used:string,covers:boolean,open:boolean>>")
    laid = copies.texts.select(F.col("path").alias("fn"), one.alias("rows"))
    blocks = laid.select("fn", F.posexplode("rows").alias("block", "r"), F.size("rows").alias("n"), F.exists("rows", lambda r: r["open"]).alias("loops")).select("fn", (F.col("block") + 1).alias("block"), "r.name", "r.used", "r.covers", "n", "loops")
    blocks = stored(blocks, "blocks")
    ahead = F.array(F.when(F.col("block") < F.col("n"), F.col("block") + 1), F.when((F.col("name") == "A") & (F.col("block") + 2 <= F.col("n")), F.col("block") + 2), F.when(F.col("loops") & (F.col("block") == F.col("n")), F.lit(1)))
    edges = blocks.select("fn", F.col("block").alias("a"), F.explode(F.array_distinct(F.filter(ahead, lambda x: x.isNotNull()))).alias("b"))
    return blocks, edges, copies.holders.select(F.col("path").alias("fn"), F.col("_text").alias("shape"))


def _of_functions(found: DataFrame, holders: DataFrame) -> DataFrame:
    """``found`` (fn, a shape, and more) for every function that has the shape."""
    return holders.join(found.withColumnRenamed("fn", "shape"), "shape").drop("shape")


@query(f"""WITH RECURSIVE {_BLOCKS}, named AS (SELECT e.*, b.name AS written FROM e JOIN b ON e.fn = b.fn AND e.a = b.block),
r(fn, block, def, name) AS (SELECT fn, b, a, written FROM named UNION SELECT r.fn, named.b, r.def, r.name FROM r JOIN named ON named.fn = r.fn AND named.a = r.block WHERE named.written <> r.name)
SELECT fn, block, def FROM r""")
def reaching_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that reach each block's entry."""
    blocks, edges, holders = blocks_and_edges(spark, sf_dir)
    return _of_functions(reaching(blocks, edges, "fn").select("fn", "block", "def"), holders)


@query(f"""WITH RECURSIVE {_BLOCKS}, back AS (SELECT e.*, b.name AS written FROM e JOIN b ON e.fn = b.fn AND e.a = b.block),
r(fn, block, name) AS (SELECT fn, block, used FROM b UNION SELECT r.fn, back.a, r.name FROM r JOIN back ON back.fn = r.fn AND back.b = r.block WHERE back.written <> r.name)
SELECT fn, block, name FROM r""")
def liveness_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are live at each block's entry."""
    blocks, edges, holders = blocks_and_edges(spark, sf_dir)
    return _of_functions(live(blocks, edges, "fn").select("fn", "block", "name"), holders)


@query(f"""WITH RECURSIVE {_BLOCKS}, cover AS (SELECT fn, block FROM b WHERE l_discount >= 0.09), open AS (SELECT * FROM e WHERE (fn, a) NOT IN (SELECT fn, block FROM cover) AND (fn, b) NOT IN (SELECT fn, block FROM cover)),
r(fn, node) AS (SELECT fn, block FROM b WHERE block = 1 AND (fn, block) NOT IN (SELECT fn, block FROM cover) UNION SELECT r.fn, open.b FROM r JOIN open ON open.fn = r.fn AND open.a = r.node)
SELECT DISTINCT fn, NOT EXISTS (SELECT 1 FROM r WHERE r.fn = b.fn AND r.node = b.n) AS covered FROM b""")
def cover_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every path through a function passes a block of the cover."""
    blocks, edges, holders = blocks_and_edges(spark, sf_dir)
    covers = blocks.where("covers").select("fn", "block")
    free = edges.join(covers.withColumnRenamed("block", "a"), ["fn", "a"], "left_anti").join(covers.withColumnRenamed("block", "b"), ["fn", "b"], "left_anti").select("fn", "a", "b")
    roots = blocks.where("block = 1").join(covers, ["fn", "block"], "left_anti").select("fn", F.col("block").alias("node"))
    ends = blocks.where("block = n").select("fn", F.col("block").alias("node"))
    open_ = reachable(roots, free, ["fn"]).join(ends, ["fn", "node"], "left_semi").select("fn", F.lit(True).alias("open"))
    return _of_functions(ends.join(open_, "fn", "left").select("fn", F.col("open").isNull().alias("covered")), holders)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reaching FROM events""")
def reaching_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last definition before each event of a user, on a straight line."""
    before = Window.partitionBy("user_id").orderBy("pos", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events(spark, sf_dir).select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(before).alias("reaching"))


@query("""SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events WHERE event_type IN ('click', 'view')) WHERE event_type = 'click' AND (after = 'click' OR after IS NULL)""")
def dead_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks (writes) that the next click overwrites before any view (read), or that nothing reads."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("pos", "event_id"))
    return events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).withColumn("after", after).where("event_type = 'click' AND (after = 'click' OR after IS NULL)").select("event_id", "user_id")


@query("""SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS may, bool_and(o_orderstatus = 'F') AS must FROM orders GROUP BY o_custkey, o_orderpriority""")
def must_may(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some, and whether all, of the paths to a name set it."""
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.bool_or(done).alias("may"), F.bool_and(done).alias("must"))


_CALLS = """calls AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_returnflag = 'R' AND x.l_quantity = 50 AND y.l_quantity >= 40),
roots AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey = 0)"""


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls between suppliers, from a large returned line to a large next one, and those called at the top."""
    lines = table(spark, sf_dir, "lineitem")
    x = lines.where("l_returnflag = 'R' AND l_quantity = 50").select("l_orderkey", F.col("l_suppkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    y = lines.where("l_quantity >= 40").select("l_orderkey", F.col("l_suppkey").alias("b"), "l_linenumber")
    edges = x.join(y, ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()
    return table(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("node")), edges


@query(f"WITH RECURSIVE {_CALLS}, r(node) AS (SELECT node FROM roots UNION SELECT calls.b FROM r JOIN calls ON calls.a = r.node) SELECT node FROM r")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that calls reach."""
    return reachable(*_calls(spark, sf_dir))


@query(f"WITH RECURSIVE {_CALLS}, r(node) AS (SELECT node FROM roots UNION SELECT calls.b FROM r JOIN calls ON calls.a = r.node) SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM r)")
def unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that no call reaches."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")).join(reachable(*_calls(spark, sf_dir)), "node", "left_anti")


@query("""SELECT o_orderkey, next FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL""")
def overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that a later one of the same name replaces."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", after.alias("next")).where("next IS NOT NULL")
