"""Words that one edit parts, found by asymmetric chunks, and the form that each is a variant of.

Of two words, the shorter (of equally long ones, the lesser) gives two disjoint chunks, its halves; the other gives
the grams that are as long, wherever a chunk can have come to lie in it. One edit leaves one of the two chunks as
it was, shifted by at most one place, so the two words meet there, within shift one. The edit is in the
other half then, and by the same argument one of that half's own two chunks is left as well: a chunk goes with one
of these, so that words meet on three quarters of their letters and frequent syllables make no long lists.
What has met is verified by its edit distance.

The chunks of a word are as many as its places for one edit, whatever the number of words, and nothing is
collected: words, chunks and links are rows, joined and added up by hash.

Edge cases: null and empty texts have no words; a null word or count has no part. Equal words that come as several
rows count together. Words under four letters can't be cut in four, so ``least_length`` is at least 4.
Ties of a form go to the first word in code-point order. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.storage import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, least_length: int, text: str = "text", letters: str = r"A-Za-zÀ-ÿ") -> DataFrame:
    """``docs`` with a row and ``run`` for each maximal run of at least so many letters; only A to Z are lower-cased."""
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"[{letters}]{{{least_length},}}"), F.lit(0))
    return docs.withColumn("run", F.explode(runs)).withColumn("run", F.translate("run", _UPPER, _LOWER))


def counted(words: DataFrame, least_length: int = 7, least_count: int = 2, word: str = "word") -> DataFrame:
    """word and n of what is long and frequent enough."""
    return words.where(F.length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, length: Column, moved: int) -> list[Column]:
    """What is left of a word of ``length`` if one of its four pieces goes; pieces behind that lie ``moved`` places further on."""
    half = (length / 2).cast("int")
    cuts = [F.lit(0), (half / 2).cast("int"), half, half + ((length - half) / 2).cast("int"), length]
    keys = []
    for gone in range(4):
        pieces = [F.substr(word, cuts[k] + 1 + (moved if k > gone else 0), cuts[k + 1] - cuts[k]) for k in range(4) if k != gone]
        keys.append(F.xxhash64(F.concat(*pieces), length, F.lit(gone)))
    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """shorter, n_shorter, longer, n_longer of each pair one edit apart, once; ``words`` (word, n) are distinct."""
    length = F.length("word")
    chunks = words.select(F.explode(F.array(*_keys(F.col("word"), length, 0))).alias("key"), F.col("word").alias("shorter"), F.col("n").alias("n_shorter"))
    placed = F.array(*_keys(F.col("word"), length, 0), *_keys(F.col("word"), length - 1, 1))
    grams = words.select(F.explode(placed).alias("key"), F.col("word").alias("longer"), F.col("n").alias("n_longer"))
    longer = F.length("longer") - F.length("shorter")
    met = chunks.join(grams, "key").where((longer == 1) | (longer == 0) & (F.col("shorter") < F.col("longer")))
    return met.where(F.levenshtein("shorter", "longer", 1) == 1).select("shorter", "n_shorter", "longer", "n_longer").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """word and root: ``forms`` (word, form) followed to their ends by doubling, a stored table a round.

    A form is ``times`` as frequent as its word, so a few rounds do, whatever the number of words.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ends = steps.select(F.col("word").alias("root"), F.col("root").alias("end"))
        steps = stored(steps.join(ends, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "forms")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of ``words`` (word, n).

    ``form`` is the most frequent near word if it has ``times`` the word's count, else null; ``root`` is where
    forms lead in the end.
    """
    words = stored(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(words)
    near = F.explode(F.array(F.struct(F.col("shorter").alias("word"), F.col("longer").alias("other"), F.col("n_longer").alias("of")), F.struct(F.col("longer").alias("word"), F.col("shorter").alias("other"), F.col("n_shorter").alias("of"))))
    links = pairs.select(near.alias("link")).select("link.*")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("less"), F.col("other"))).alias("best"))
    judged = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "variants")
    roots = _followed(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
