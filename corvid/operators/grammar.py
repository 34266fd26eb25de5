"""Invocations held against grammars of tools and versions, as windows over their words.

A grammar is a row for each context of a tool's version: ``context`` is empty at the top and then the subcommands
chosen so far, with ``/`` between them. Columns beside tool, version and context:

* ``flags``, a map of names to structs of ``takes`` (``none``, ``required`` or ``attached``: an optional value, behind
  ``=`` only) and ``allowed`` (values, or null for any);
* ``opaque``, names of options behind which something else is read;
* ``flags_complete``, ``subcommands`` (names, or null if words are no subcommands) and ``subcommands_complete``;
* ``positional`` (other words are known to be allowed), ``clusters`` (``-al``) and ``abbreviations`` (``--verb``).

Which words are values of the option before them follows from the length of the run of options that want one: values and
options alternate along it. So no word waits for another, and an invocation may be as long as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import stored

SCHEMA = (
    "tool string, version string, context string, flags map<string, struct<takes: string, allowed: array<string>>>, opaque array<string>, flags_complete boolean, "
    "subcommands array<string>, subcommands_complete boolean, positional boolean, clusters boolean, abbreviations boolean"
)


def version_key(version: Column) -> Column:
    """The numbers in a version, in order, so that ``1.10`` comes behind ``1.9p2``."""
    return F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), 1), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(2**63 - 1)))


def newest(grammars: DataFrame) -> DataFrame:
    """tool and version of the newest grammar of each tool; of versions with equal numbers the greatest text."""
    return grammars.groupBy("tool").agg(F.max_by("version", F.struct(version_key(F.col("version")), "version")).alias("version"))


def as_of(wanted: DataFrame, grammars: DataFrame) -> DataFrame:
    """tool, version and ``known``, the newest version with a grammar that isn't above ``version``, or null.

    A null tool or version has none. Pairs are made distinct before they meet grammars.
    """
    pairs = wanted.select("tool", "version").distinct()
    have = grammars.select("tool", F.col("version").alias("known")).distinct()
    fits = version_key(F.col("known")) <= version_key(F.col("version"))
    found = pairs.join(have, "tool").where(fits).groupBy("tool", "version").agg(F.max_by("known", F.struct(version_key(F.col("known")), "known")).alias("known"))
    return pairs.join(found, ["tool", "version"], "left")


def _told(words: DataFrame, grammars: DataFrame) -> DataFrame:
    """key, pos, word and what it decides, if anything: answer, why, and child (the subcommand that it chooses).

    ``words`` (key, tool, version, context, pos, word) of a key are all in one context and follow each other.
    """
    none = F.array().cast("array<string>")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    rows = words.join(grammars, ["tool", "version", "context"], "left").select(
        "key", "pos", "word", F.coalesce("flags", F.create_map().cast("map<string, struct<takes: string, allowed: array<string>>>")).alias("flags"), F.coalesce("opaque", none).alias("opaque"),
        "subcommands", yes("flags_complete"), yes("subcommands_complete"), yes("positional"), yes("clusters"), yes("abbreviations"),
    )
    name, value = F.substring_index("word", "=", 1), F.expr("substring(word, instr(word, '=') + 1)")
    letters = F.transform(F.split(F.expr("substring(word, 2)"), ""), lambda x, k: F.struct((k + 1).alias("k"), F.concat(F.lit("-"), x).alias("name")))
    ends = F.filter(letters, lambda x: F.array_contains("opaque", x["name"]) | F.coalesce(F.element_at("flags", x["name"])["takes"] != "none", F.lit(True)))
    rows = rows.withColumns({"dashed": F.col("word").startswith("-") & ~F.col("word").isin("-", "--"), "name": name, "value": F.when(F.contains("word", F.lit("=")), value)})
    rows = rows.withColumn("spec", F.when(F.col("dashed"), F.element_at("flags", F.col("name"))))
    single = F.col("clusters") & F.col("dashed") & F.col("spec").isNull() & ~F.array_contains("opaque", F.col("name")) & ~F.col("word").startswith("--") & (F.length("word") > 2)
    rows = rows.withColumns({"single": single, "end": F.when(single, F.get(ends, F.lit(0)))}).withColumn("end_spec", F.element_at("flags", F.col("end.name")))
    # What is behind the last letter that is looked at is its value.
    rest = F.expr("substring(word, end.k + 2)")
    of, given = F.coalesce("spec", "end_spec"), F.when(F.col("spec").isNotNull(), F.col("value")).when(rest != "", rest)
    rows = rows.withColumns({"of": of, "given": given}).withColumn("wants", F.coalesce(F.col("dashed") & (F.col("of.takes") == "required") & F.col("given").isNull(), F.lit(False)))

    order = Window.partitionBy("key").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.coalesce(F.max(F.when(~F.col("wants"), F.col("pos"))).over(before), F.min("pos").over(Window.partitionBy("key")) - 1)
    rows = rows.withColumns({"is_value": (F.col("pos") - 1 - settled) % 2 == 1, "allowed": F.lag("of.allowed").over(order)})
    closed = F.min(F.when((F.col("word") == "--") & ~F.col("is_value"), F.col("pos"))).over(Window.partitionBy("key"))
    behind = F.coalesce(F.col("pos") > closed, F.lit(False))
    rows = rows.withColumns({"behind": behind, "is_value": F.col("is_value") & ~behind})

    no, unsure = (lambda why: F.lit(f"invalid {why}")), (lambda why: F.lit(f"unknown {why}"))
    outside = lambda x, allowed: x.isNotNull() & allowed.isNotNull() & ~F.array_contains(allowed, x)
    missing = F.when(F.col("flags_complete"), no("flag")).otherwise(unsure("flags"))
    flag = (
        F.when(F.array_contains("opaque", F.col("name")) | F.array_contains("opaque", F.col("end.name")), unsure("opaque"))
        .when((F.col("of.takes") == "none") & F.col("given").isNotNull(), unsure("attached"))
        .when(F.col("of").isNotNull(), F.when(outside(F.col("given"), F.col("of.allowed")), no("value")))
        .when(F.col("abbreviations") & F.col("word").startswith("--") & F.exists(F.map_keys("flags"), lambda x: x.startswith(F.col("name"))), unsure("abbreviated"))
        .when(F.col("single") & F.col("end").isNull(), F.lit(None).cast("string"))
        .otherwise(missing)
    )
    other = (
        F.when(F.col("subcommands").isNull(), F.when(~F.col("positional"), unsure("positional")))
        .when(F.array_contains("subcommands", F.col("word")), F.lit("child"))
        .otherwise(F.when(F.col("subcommands_complete"), no("subcommand")).otherwise(unsure("subcommands")))
    )
    told = F.when(F.col("is_value"), F.when(outside(F.col("word"), F.col("allowed")), no("value"))).when((F.col("word") == "--") & ~F.col("behind"), F.lit(None).cast("string")).when(F.col("dashed") & ~F.col("behind"), flag).otherwise(other)
    return rows.select("key", "pos", "word", told.alias("told"))


def validated(invocations: DataFrame, grammars: DataFrame) -> DataFrame:
    """key, answer (valid, invalid or unknown), pos, word and why, for each of ``invocations`` (key, tool, version, words).

    The first word that decides is ``word``, at ``pos`` from 1; they are null if none does. Tools and versions without a
    grammar give ``unknown``, with why ``grammar``; null words are ``unknown``, with why ``words``. A value
    that is still missing at the end is no fault. Rows of one key are expected once.
    """
    top = grammars.where("context = ''").select("tool", "version", F.lit(True).alias("known"))
    asked = invocations.select("key", "tool", "version", "words").join(top, ["tool", "version"], "left")
    null = lambda kind: F.lit(None).cast(kind)
    bad = F.when(F.col("known").isNull(), "grammar").when(F.col("words").isNull() | F.exists("words", lambda w: w.isNull()), "words")
    asked = stored(asked.withColumn("bad", bad), "invocations")
    parts = [asked.where("bad IS NOT NULL").select("key", F.lit("unknown").alias("answer"), null("int").alias("pos"), null("string").alias("word"), F.col("bad").alias("why"))]
    good = asked.where("bad IS NULL")
    words = good.select("key", "tool", "version", F.lit("").alias("context"), F.posexplode("words").alias("at", "word")).select("key", "tool", "version", "context", (F.col("at") + 1).alias("pos"), "word")
    decided = []
    # A round for each level of subcommands: what follows the chosen one is held against its own grammar.
    while True:
        words = stored(words, "words")
        first = stored(_told(words, grammars).where("told IS NOT NULL").groupBy("key").agg(F.min(F.struct("pos", "word", "told")).alias("f")).select("key", "f.*"), "first")
        decided.append(first.where("told <> 'child'"))
        chosen = first.where("told = 'child'").select("key", F.col("pos").alias("from"), F.col("word").alias("child"))
        if chosen.isEmpty():
            break
        context = F.when(F.col("context") == "", F.col("child")).otherwise(F.concat_ws("/", "context", "child"))
        words = words.join(chosen, "key").where("pos > from").select("key", "tool", "version", context.alias("context"), "pos", "word")
    found = decided[0]
    for more in decided[1:]:
        found = found.unionByName(more)
    answers = good.select("key").join(found, "key", "left")
    kind = F.coalesce(F.substring_index("told", " ", 1), F.lit("valid"))
    parts.append(answers.select("key", kind.alias("answer"), "pos", "word", F.substring_index("told", " ", -1).alias("why")))
    return parts[0].unionByName(parts[1])
