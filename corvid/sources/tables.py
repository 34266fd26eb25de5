"""Readers of source tables and of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


IGNORED = (".git", ".hg", ".svn", "node_modules", "vendor")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def discovered(paths: DataFrame, ignored: tuple[str, ...] = IGNORED, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``paths`` (path, content) with ``status`` (included, ignored, excluded) and ``kind``.

    Ignored are paths below ignored folders, excluded those that match one of the patterns ``excluded``. The kind is
    ``shell`` by ending or marker line, ``workflow`` for files that may embed scripts, else ``other``.
    """
    skipped = F.exists(F.split("path", "/"), lambda part: part.isin(*ignored))
    out = F.lit(False)
    for pattern in excluded:
        out = out | F.col("path").rlike(pattern)
    marker = F.coalesce(F.col("content").rlike(r"^#![^\n]*?(/|env +)(ba|da|k|mk|z|fi)?sh\b"), F.lit(False))
    kind = F.when(F.col("path").rlike(r"\.(sh|bash|dash|ksh|zsh|fish)$") | marker, "shell").when(F.col("path").rlike(r"(^|/)\.github/.*\.ya?ml$|(^|/)action\.ya?ml$"), "workflow").otherwise("other")
    return paths.withColumns({"status": F.when(skipped, "ignored").when(out, "excluded").otherwise("included"), "kind": kind})


def source_files(spark: SparkSession, root: str, glob: str = "*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``path`` and ``content`` of the text files below ``root``, without ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.where(~F.exists(F.split("path", "/"), lambda part: part.isin(*ignored))).select("path", F.col("content").cast("string").alias("content"))
