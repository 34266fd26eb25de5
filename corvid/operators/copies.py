"""Each distinct text is analysed once, and what is found in it goes to every file that has it."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import stored


class Copies(NamedTuple):
    """``texts``: path (the text's own number or name) and content, each once; ``holders``: path of each file and _text, that of its content."""

    texts: DataFrame
    holders: DataFrame


def distinct_texts(files: DataFrame, endings: bool = False, once: bool = False) -> Copies:
    """The distinct contents of ``files`` (path, content), and which file has which.

    A text's number is a hash under the first seed that gives no two of them the same, so equal numbers mean equal texts. With
    ``endings`` it becomes a name with the ending of its files' paths, and files of different endings share no text.
    If each path is there ``once``, holders are what ``files`` gives, and aren't written.
    """
    ending = F.regexp_extract("path", r"\.[A-Za-z0-9]+$", 0)
    for seed in count():
        number = F.xxhash64(F.lit(seed), F.col("content"))
        text = F.concat(F.hex(number), ending) if endings else number
        numbered = files.select("path", text.alias("text"), "content")
        texts = stored(numbered.select("text", "content").distinct(), "texts")
        if texts.groupBy("text").count().where("count > 1").isEmpty():
            holders = numbered.select("path", F.col("text").alias("_text"))
            return Copies(texts.withColumnRenamed("text", "path"), holders if once else stored(holders.distinct(), "holders"))


def held(found: DataFrame, copies: Copies) -> DataFrame:
    """``found`` (path of a text, and more) for every file that has the text."""
    columns = [c for c in found.columns if c != "path"]
    return copies.holders.join(found.withColumnRenamed("path", "_text"), "_text").select("path", *columns)
