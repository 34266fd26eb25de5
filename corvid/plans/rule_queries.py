"""Rules as queries over facts, and which rules apply where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.plans.registry import query
from corvid.sources.tables import table


@query("""SELECT DISTINCT p_brand AS rule FROM part WHERE (starts_with(p_brand, 'Brand#1') OR p_brand = 'Brand#20') EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_brand IN ('Brand#13', 'Brand#1')""")
def rule_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that selectors name, by prefix, less those that are ignored."""
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule")).distinct()
    return rules.where(F.col("rule").startswith("Brand#1") | (F.col("rule") == "Brand#20")).where(~F.col("rule").isin("Brand#13", "Brand#1"))


_CODES = {"long": "n_chars > 5000", "marks": "text LIKE '%###%'", "digits": "text LIKE '%0%'"}
_IGNORES = (("src1[0-9]", "long"), ("src[2-4]$", "marks"), ("^src0$", "digits"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{code}' AS code FROM documents WHERE {test}" + "".join(f" AND NOT regexp_matches(source, '{p}')" for p, c in _IGNORES if c == code) for code, test in _CODES.items()))
def per_file_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three rules, without those that a file's name turns off; one scan."""
    codes = F.array(*[F.when(F.expr(test) & ~reduce(lambda a, b: a | b, (F.col("source").rlike(p) for p, c in _IGNORES if c == code), F.lit(False)), F.lit(code)) for code, test in _CODES.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


@query("""SELECT conv_id, turn, role, next_role FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'assistant' AND next_role = 'user'""")
def pipeline_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a pipeline that one segment directly follows."""
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", after.alias("next_role")).where("role = 'assistant' AND next_role = 'user'")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER w AS a1, lead(event_type, 2) OVER w AS a2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND a1 = 'view' AND a2 = 'purchase'""")
def mixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that chain two unlike operators in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_type").over(w).alias("a1"), F.lead("event_type", 2).over(w).alias("a2")).where("event_type = 'click' AND a1 = 'view' AND a2 = 'purchase'").select("event_id")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k > 1""")
def duplicate_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the last redirect of one stream of one command."""
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_suppkey"), F.desc("l_partkey"), F.desc("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", k.alias("k")).where("k > 1").drop("k")


@query("""WITH arms AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size > 45 THEN split_part(p_name, ' ', 1) || '*' ELSE p_name END AS pattern FROM part)
SELECT b.p_partkey, min(a.p_partkey) AS shadowed_by FROM arms b JOIN arms a ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND (a.pattern = b.pattern OR a.pattern = split_part(b.p_name, ' ', 1) || '*') GROUP BY b.p_partkey""")
def case_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that an earlier arm of the same case subsumes, and the first that does.

    The first arm with each pattern is enough, so each arm meets two rows, not all earlier arms.
    """
    star = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("*"))
    arms = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 45, star).otherwise(F.col("p_name")).alias("own"), star.alias("star"))
    first = arms.groupBy("p_brand", F.col("own").alias("pattern")).agg(F.min("p_partkey").alias("first"))
    wanted = arms.withColumn("pattern", F.explode(F.array_distinct(F.array("own", "star"))))
    return wanted.join(first, ["p_brand", "pattern"]).where("first < p_partkey").groupBy("p_partkey").agg(F.min("first").alias("shadowed_by"))


@query("""WITH declared AS (SELECT DISTINCT c_mktsegment || n_regionkey AS option FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500),
handled AS (SELECT DISTINCT c_mktsegment || n_regionkey AS option FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -500)
SELECT option, 'undeclared' AS problem FROM (SELECT option FROM handled EXCEPT SELECT option FROM declared) UNION ALL SELECT option, 'unhandled' FROM (SELECT option FROM declared EXCEPT SELECT option FROM handled)""")
def getopts_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that are declared but not handled, or handled but not declared: one pass, one aggregate."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    options = rows.groupBy(F.concat("c_mktsegment", F.col("n_regionkey").cast("string")).alias("option")).agg(F.bool_or(F.col("c_acctbal") > 9500).alias("declared"), F.bool_or(F.col("c_acctbal") < -500).alias("handled"))
    return options.where("declared <> handled").select("option", F.when(F.col("handled"), "undeclared").otherwise("unhandled").alias("problem"))


@query("""SELECT o_custkey, count(*)::BIGINT AS n_findings, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END)::INTEGER AS severity FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each file and the worst severity among them."""
    worst = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n_findings"), worst.alias("severity"))


@query("""SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 5""")
def keep_first_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five foremost findings of each family."""
    k = F.row_number().over(Window.partitionBy("l_returnflag", "l_linestatus").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").withColumn("k", k).where("k <= 5").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
