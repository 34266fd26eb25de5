"""Fixes of findings: each changes one line, so a file is mended line by line and its diff is those lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import lines

#: Code, what its fix looks for, and what it puts there.
FIXES = (
    ("C038", r"^(\s*)else +if ", "$1elif "),
    ("S002", r"\bread\b", "read -r"),
    ("S005", r"`([^`]*)`", r"\$($1)"),
    ("S049", r"\btr ([A-Za-z0-9]-[A-Za-z0-9])", "tr '$1'"),
    ("S060", r"\begrep\b", "grep -E"),
    ("S061", r"\bfgrep\b", "grep -F"),
    ("S068", r"\b2$", "INT"),
    ("S074", r"([^&>]&) *;", "$1"),
    ("X002", r" == ", " = "),
    ("X031", r"^(\s*)source\b", "$1."),
    ("X069", r"\bSIG([A-Z]+)\b", "$1"),
)


def fixed_lines(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, line_no, before and after of each line of ``files`` that fixes of ``found`` change, all its fixes in order of code."""
    codes = found.where(F.col("code").isin(*[c for c, _, _ in FIXES])).groupBy("path", "line_no").agg(F.collect_set("code").alias("codes"))
    rows = lines(files, "path", "content").select("path", "line_no", F.col("line").alias("before")).join(codes, ["path", "line_no"])
    after = F.col("before")
    for code, pattern, instead in FIXES:
        after = F.when(F.array_contains("codes", code), F.regexp_replace(after, pattern, instead)).otherwise(after)
    return rows.withColumn("after", after).where("before <> after").select("path", "line_no", "before", "after")


def with_fixes(files: DataFrame, changed: DataFrame) -> DataFrame:
    """``files`` (path, content) with the lines of ``changed`` in place; a file's lines meet in one task."""
    rows = lines(files, "path", "content").join(changed.select("path", "line_no", "after"), ["path", "line_no"], "left")
    line = F.struct("line_no", F.coalesce("after", "line").alias("line"))
    whole = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("fixed"))
    return files.join(whole, "path", "left").select("path", F.coalesce("fixed", "content").alias("content"))


def diff(changed: DataFrame) -> DataFrame:
    """Changed lines as a unified diff without context: ``value``, in order of path and line."""
    head = F.format_string("@@ -%d +%d @@", "line_no", "line_no")
    first = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) == 1
    text = F.concat_ws("\n", F.when(first, F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path")), head, F.concat(F.lit("-"), "before"), F.concat(F.lit("+"), "after"))
    return changed.withColumn("value", text).orderBy("path", "line_no").select("value")
