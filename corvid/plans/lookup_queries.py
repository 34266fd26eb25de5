"""Name resolution, typos, command lookup and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators.fixpoint import chain_ends
from corvid.plans.registry import query
from corvid.sources.tables import table


#: Known names of a block.
MOST_KNOWN = 10_000


@query("""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents), d AS (SELECT DISTINCT source, nullif(regexp_extract(text, '[A-Za-z]+', 0), '') AS name FROM documents)
SELECT source, name FROM d WHERE name IS NOT NULL AND EXISTS (SELECT 1 FROM w WHERE w.name = d.name AND w.source <> d.source)""")
def workspace_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one source defines (its documents' first words) and another uses."""
    docs = table(spark, sf_dir, "documents")
    used = docs.select("source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("name")).groupBy("name").agg(F.min("source").alias("least"), F.max("source").alias("most"))
    defined = docs.select("source", F.regexp_extract("text", "[A-Za-z]+", 0).alias("name")).where("name <> ''").distinct()
    # A name is used elsewhere if the least or the most of its users isn't the one that defines it.
    return defined.join(used, "name").where("least <> source OR most <> source").select("source", "name")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name, b.name AS candidate, levenshtein(a.name, b.name)::INTEGER AS distance FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) <= 2""")
def misspelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names within two edits.

    Two edits leave one of three pieces of a name in place, up to a shift of two; names meet by those.
    Names of less than three characters can't be cut in three: they meet by length alone.
    """
    return within_two_edits(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct())


def within_two_edits(names: DataFrame) -> DataFrame:
    """name, candidate and distance of the pairs of ``names``, which are distinct."""
    # Piece i goes from character n * i / 3 to n * (i + 1) / 3, so lengths differ by one at most.
    cut = F.expr("array_distinct(transform(sequence(0, 2), i -> substring(name, length(name) * i div 3 + 1, length(name) * (i + 1) div 3 - length(name) * i div 3)))")
    pieces = names.where("length(name) > 2").withColumn("piece", F.explode(cut))
    # The pieces of names that are up to two characters shorter or longer.
    widths = F.expr("sequence(greatest(1, (length(name) - 2) div 3), (length(name) + 4) div 3)")
    runs = F.expr("array_distinct(transform(sequence(1, length(candidate)), i -> substring(candidate, i, width)))")
    grams = names.where("name <> ''").select(F.col("name").alias("candidate"), F.explode(widths).alias("width")).select("candidate", F.explode(runs).alias("piece")).distinct()
    met = pieces.join(grams, "piece").where("name <> candidate AND abs(length(name) - length(candidate)) <= 2")
    sizes = F.sequence(F.greatest(F.length("name") - 2, F.lit(0)), F.length("name") + 2)
    short = names.where("length(name) < 3").select("name", F.explode(sizes).alias("size"))
    near = short.join(names.where("length(name) < 5").select(F.col("name").alias("candidate"), F.length("name").alias("size")), "size").where("name <> candidate")
    both = met.select("name", "candidate").unionByName(near.select("name", "candidate"))
    pairs = both.select(F.least("name", "candidate").alias("name"), F.greatest("name", "candidate").alias("candidate")).distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "candidate", 2)).where("distance >= 0")


@query("""WITH asked AS (SELECT DISTINCT replace(p_type, 'O', '') AS name FROM part), known AS (SELECT DISTINCT p_type AS candidate FROM part),
d AS (SELECT name, candidate, levenshtein(name, candidate)::INTEGER AS distance FROM asked, known) SELECT name, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, candidate) AS k FROM d) WHERE k <= 3""")
def typo_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three known names nearest to each unknown one.

    The unknown names are a stated set, held against all known ones in blocks: each block of at most ``MOST_KNOWN`` names gives
    its three nearest, and the nearest of those are the answer.
    """
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    asked = types.select(F.replace("p_type", F.lit("O"), F.lit("")).alias("name")).distinct()
    return nearest(asked, types.withColumnRenamed("p_type", "candidate"), 3)


def nearest(asked: DataFrame, known: DataFrame, k: int, most: int = MOST_KNOWN) -> DataFrame:
    """name, candidate and distance of the ``k`` of ``known`` nearest to each of ``asked``; ties go by candidate."""
    blocks = known.agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).alias("blocks"))
    dealt = known.join(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("candidate"), "blocks"))
    copied = asked.join(F.broadcast(blocks)).select("name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    met = copied.join(dealt, "block").select("name", "block", "candidate", F.levenshtein("name", "candidate").alias("distance"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("name", *keys).orderBy("distance", "candidate"))
    few = met.withColumn("k", rank("block")).where(F.col("k") <= k).drop("k", "block")
    return few.withColumn("k", rank()).where(F.col("k") <= k).drop("k")


@query("""SELECT l_partkey, min(l_linenumber)::INTEGER AS dir_idx, (arg_min(l_suppkey, l_linenumber * 1000000000::BIGINT + l_suppkey))::BIGINT AS found FROM lineitem GROUP BY l_partkey""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first folder of the search path that has a command keeps it."""
    best = F.min(F.struct(F.col("l_linenumber").alias("dir_idx"), F.col("l_suppkey").alias("found"))).alias("best")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(best).select("l_partkey", "best.dir_idx", "best.found")


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS node, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey + 1 ELSE c_custkey // 2 END AS next FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')),
r(node, goal, n) AS (SELECT node, next, 1 FROM a UNION ALL SELECT r.node, a.next, r.n + 1 FROM r JOIN a ON a.node = r.goal WHERE r.n < 200)
SELECT a.node, e.goal AS "end" FROM a LEFT JOIN (SELECT node, goal FROM r WHERE goal NOT IN (SELECT node FROM a)) e ON e.node = a.node""")
def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each alias stands for in the end; nothing if it runs in a circle."""
    key = F.col("c_custkey")
    links = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))
    return chain_ends(links.select(key.alias("node"), F.when(F.col("c_mktsegment") == "BUILDING", key + 1).otherwise(F.floor(key / 2)).alias("next")))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM conversations),
v AS (SELECT conv_id, CASE WHEN n IS NULL THEN 'unknown' WHEN coalesce(before, 'start') || '>' || role IN ('start>user', 'start>system', 'system>user', 'user>assistant', 'assistant>user') THEN 'valid' ELSE 'invalid' END AS answer FROM t)
SELECT conv_id, CASE WHEN bool_or(answer = 'unknown') THEN 'unknown' WHEN bool_or(answer = 'invalid') THEN 'invalid' ELSE 'valid' END AS answer, count(*) FILTER (answer = 'invalid')::BIGINT AS n_issues FROM v GROUP BY conv_id""")
def grammar_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations against a grammar of what may follow what; missing evidence makes the answer unknown."""
    before = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("start"))
    fits = F.concat(before, F.lit(">"), "role").isin("start>user", "start>system", "system>user", "user>assistant", "assistant>user")
    steps = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("text").isNull(), "unknown").when(fits, "valid").otherwise("invalid").alias("step"))
    answer = F.when(F.bool_or(F.col("step") == "unknown"), "unknown").when(F.bool_or(F.col("step") == "invalid"), "invalid").otherwise("valid")
    return steps.groupBy("conv_id").agg(answer.alias("answer"), F.count_if(F.col("step") == "invalid").alias("n_issues"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events WHERE (props::JSON ->> '$.k')::INTEGER >= 50")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of serialised records."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 50")
