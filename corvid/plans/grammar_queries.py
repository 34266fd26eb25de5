"""Verdicts on an invocation for each order, whose words are its items; SQL runs them through a table of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.copies import distinct_texts, held
from corvid.operators.grammar import SCHEMA, as_of, newest, validated
from corvid.plans.registry import query
from corvid.plans.script_queries import _ITEM, _numbered
from corvid.sources.tables import table
from corvid.storage import stored

WORDS = ("-v", "-o", "--fast", "--", "send", "list", "--level=mid", "--level", "x", "low", "-vo", "--to", "-n", "--level=low", "send")
_none, _value = ("none", None), ("required", None)
_PACK = {"-v": _none, "-o": _value, "--out": _value, "--level": ("required", ["low", "high"]), "--color": ("attached", None)}
GRAMMARS = (
    ("pack", "1.2", "", _PACK, [], True, None, False, True, True, False),
    ("pack", "1.10", "", _PACK | {"--fast": _none}, [], True, None, False, True, True, False),
    ("ship", "2.0", "", {"-v": _none}, [], True, ["send", "list"], True, False, True, False),
    ("ship", "2.0", "send", {"--to": _value, "-n": _none}, [], True, None, False, True, True, False),
)
# Tool and version of an order, by its key.
ASKED = (("pack", "1.2"), ("pack", "1.10"), ("ship", "2.0"), ("pack", "1.9"), ("ship", "2.0"), ("ship", None))
# From a state, a word leads to another state, or to an answer: ! is invalid, ? unknown. * is any other word.
_FROM = {
    "a": {"-v": "a", "-o": "av", "--fast": "!flag", "--": "any", "--level=mid": "!value", "--level": "al", "-vo": "av", "--to": "!flag", "-n": "!flag", "*": "a"},
    "av": {"*": "a"},
    "al": {"low": "a", "*": "!value"},
    "b": {"-v": "b", "-o": "bv", "--fast": "b", "--": "any", "--level=mid": "!value", "--level": "bl", "-vo": "bv", "--to": "!flag", "-n": "!flag", "*": "b"},
    "bv": {"*": "b"},
    "bl": {"low": "b", "*": "!value"},
    "any": {"*": "any"},
    "s": {"-v": "s", "--": "t", "send": "p", "list": "q", "x": "!subcommand", "low": "!subcommand", "*": "!flag"},
    "t": {"send": "p", "list": "q", "*": "!subcommand"},
    "p": {"--to": "pv", "-n": "p", "--": "any", "send": "p", "list": "p", "x": "p", "low": "p", "*": "!flag"},
    "pv": {"*": "p"},
    "q": {"--": "r", "send": "?positional", "list": "?positional", "x": "?positional", "low": "?positional", "*": "?flags"},
    "r": {"*": "?positional"},
}
_STARTS = {("pack", "1.2"): "a", ("pack", "1.10"): "b", ("ship", "2.0"): "s"}
_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_STEPS = [(state, word, there.get(word, there.get("*"))) for state, there in _FROM.items() for word in dict.fromkeys(WORDS)]
_SQL = f"""WITH RECURSIVE steps(state, word, next) AS (VALUES {", ".join(f"('{s}', '{w}', '{n}')" for s, w, n in _STEPS)}),
words(k, word) AS (VALUES {", ".join(f"({k}, '{w}')" for k, w in enumerate(WORDS))}),
asked(a, start) AS (VALUES {", ".join(f"({a}, {_quoted(_STARTS.get(pair))})" for a, pair in enumerate(ASKED))}),
items AS (SELECT l_orderkey, {_ITEM} AS item, word FROM lineitem JOIN words ON (l_partkey + l_suppkey + l_linenumber) % {len(WORDS)} = k),
runs AS (SELECT o_orderkey, 0 AS item, coalesce(start, '?grammar') AS state, NULL::VARCHAR AS word FROM orders JOIN asked ON o_orderkey % {len(ASKED)} = a WHERE EXISTS (SELECT 1 FROM items WHERE l_orderkey = o_orderkey)
UNION ALL SELECT o_orderkey, i.item, next, i.word FROM runs r JOIN items i ON i.l_orderkey = r.o_orderkey AND i.item = r.item + 1 JOIN steps s ON s.state = r.state AND s.word = i.word)
SELECT o_orderkey, CASE left(state, 1) WHEN '!' THEN 'invalid' WHEN '?' THEN 'unknown' ELSE 'valid' END AS answer, CASE WHEN left(state, 1) IN ('!', '?') AND item > 0 THEN item END::INTEGER AS pos,
CASE WHEN left(state, 1) IN ('!', '?') THEN word END AS word, CASE WHEN left(state, 1) IN ('!', '?') THEN substring(state, 2) END AS why FROM runs QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY item DESC) = 1"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.get(F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(v).cast("string").alias("version")) for t, v in ASKED]), (F.col("o_orderkey") % len(ASKED)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pair.alias("pair")).select(F.col("o_orderkey").alias("key"), "pair.*")


@query(_SQL)
def grammar_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's words fit the grammar of its tool's version, and the first that doesn't."""
    kind = ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(WORDS)).cast("int")
    words = _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("key"), F.struct("item", F.get(F.array(*[F.lit(w) for w in WORDS]), kind).alias("word")).alias("w"))
    lists = words.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["word"]).alias("words"))
    # Orders that ask the same of the same tool are held against its grammar once.
    asked = _asked(spark, sf_dir).join(lists, "key").select(F.col("key").alias("path"), F.to_json(F.struct("tool", "version", "words"), {"ignoreNullFields": "false"}).alias("content"))
    copies = distinct_texts(stored(asked, "asked"))
    once = copies.texts.select(F.col("path").alias("key"), F.from_json("content", "tool string, version string, words array<string>").alias("x")).select("key", "x.*")
    found = validated(once, spark.createDataFrame(GRAMMARS, SCHEMA))
    return held(found.withColumnRenamed("key", "path"), copies).withColumnRenamed("path", "o_orderkey")


@query("""WITH sizes AS (SELECT p_brand AS tool, concat(p_size // 5, '.', p_size, 'p', p_partkey % 3) AS version, [p_size // 5, p_size, p_partkey % 3] AS numbers FROM part),
asked AS (SELECT DISTINCT p_brand AS tool, concat(p_retailprice::BIGINT % 11, '.', p_size) AS version, [p_retailprice::BIGINT % 11, p_size] AS numbers FROM part WHERE p_retailprice IS NOT NULL)
SELECT a.tool, a.version, arg_max(s.version, s.numbers) AS known, max(n.version) AS newest FROM asked a LEFT JOIN sizes s ON s.tool = a.tool AND s.numbers <= a.numbers
LEFT JOIN (SELECT tool, arg_max(version, numbers) AS version FROM sizes GROUP BY tool) n ON n.tool = a.tool GROUP BY a.tool, a.version""")
def grammar_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tool and version the newest grammar that isn't newer, and the newest of the tool."""
    part = table(spark, sf_dir, "part")
    text = lambda *parts: F.concat(*[p.cast("string") for p in parts])
    fifth = F.floor(F.col("p_size") / 5)
    have = part.select(F.col("p_brand").alias("tool"), text(fifth, F.lit("."), F.col("p_size"), F.lit("p"), F.col("p_partkey") % 3).alias("version"))
    wanted = part.where("p_retailprice IS NOT NULL").select(F.col("p_brand").alias("tool"), text(F.rint("p_retailprice").cast("bigint") % 11, F.lit("."), F.col("p_size")).alias("version"))
    return as_of(wanted, have).join(newest(have).withColumnRenamed("version", "newest"), "tool", "left")
