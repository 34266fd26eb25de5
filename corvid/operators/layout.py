"""Text to text and regions of text: formatting, folding, embedded scripts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.shell import logical_lines

_OPENS = r"(^|[;&|]\s*|\s)(then|do|case\s.*\sin)\s*(#.*)?$|\{\s*(#.*)?$"
_CLOSES = r"^\s*(fi|done|esac|\}|else|elif)\b?"


def nested(files: DataFrame) -> DataFrame:
    """path, line_no, line, opens, closes, and the depth that each line stands at."""
    lines = logical_lines(files)
    opens = (F.col("line").rlike(_OPENS) | F.col("line").rlike(r"^\s*else\b")).cast("int")
    closes = F.col("line").rlike(_CLOSES).cast("int")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select("path", "line_no", "line", opens.alias("opens"), closes.alias("closes"))
    depth = F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(before), F.lit(0)) - F.col("closes")
    return marked.withColumn("depth", F.greatest(depth, F.lit(0)).cast("int"))


def formatted(files: DataFrame, indent: str = "  ") -> DataFrame:
    """``path``, ``content`` and ``changed``: lines indented by depth, no blanks at their ends, no double blank lines.

    Files with here-documents or multi-line quotes stay as they are: their lines aren't ours to move.
    """
    fixed = F.col("content").rlike(r"<<") | (F.pmod(F.length(F.regexp_replace("content", r"[^\"]", "")), F.lit(2)) == 1) | (F.pmod(F.length(F.regexp_replace("content", "[^']", "")), F.lit(2)) == 1) | F.col("content").contains("\\\n")
    movable = files.where(F.col("content").isNotNull() & ~fixed)
    rows = nested(movable)
    bare = F.trim(F.regexp_replace("line", r"[ \t]+$", ""), F.lit(" \t"))
    order = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("bare", bare).withColumn("double", (F.col("bare") == "") & (F.lag("bare").over(order) == ""))
    text = F.when(F.col("bare") == "", "").otherwise(F.concat(F.expr(f"repeat('{indent}', depth)"), "bare"))
    joined = rows.where("NOT coalesce(double, false)").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))), lambda x: x["text"]), "\n").alias("new"))
    return files.join(joined, "path", "left").select("path", F.coalesce("new", "content").alias("content"), (F.coalesce("new", "content") != F.col("content")).alias("changed"))


def folding_ranges(files: DataFrame) -> DataFrame:
    """path, start and end line of each compound of several lines: a closer meets the last opener of its depth."""
    rows = nested(files)
    same = Window.partitionBy("path", "depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.last(F.when(F.col("opens") == 1, F.col("line_no")), ignorenulls=True).over(same)
    return rows.withColumn("start", opener).where("closes = 1 AND start IS NOT NULL").select("path", "start", F.col("line_no").alias("end"))


def embedded_scripts(hosts: DataFrame) -> DataFrame:
    """path, host_line, label, script and tainted of the ``run`` blocks of workflow files.

    A block goes on while lines are blank or indented deeper than its key. ``tainted`` says that an
    expression of outside input is spliced into the script.
    """
    lines = hosts.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    depth = F.when(F.trim("line") != "", F.length(F.regexp_extract("line", r"^( *)", 1)))
    key = F.col("line").rlike(r"^\s*(- +)?run:\s*")
    block = F.col("line").rlike(r"^\s*(- +)?run:\s*[|>][+-]?\s*$")
    order = Window.partitionBy("path").orderBy("line_no")
    own_depth = F.length(F.regexp_extract("line", r"^(\s*(?:- +)?)run:", 1))
    rows = lines.select("path", "line_no", "line", depth.alias("depth"), key.alias("key"), block.alias("block"), own_depth.alias("own"))
    rows = rows.withColumn("label", F.last(F.when(F.col("line").rlike(r"^\s*(- +)?name:"), F.trim(F.regexp_extract("line", r"name:(.*)$", 1))), ignorenulls=True).over(order))
    rows = rows.withColumn("start", F.last(F.when(F.col("key"), F.struct("line_no", "own", "block")), ignorenulls=True).over(order))
    # A block ends at the first line that isn't deeper; what follows it belongs to nothing.
    broken = F.max(F.when((F.col("line_no") > F.col("start.line_no")) & (F.col("depth") <= F.col("start.own")), 1).otherwise(0)).over(Window.partitionBy("path", "start.line_no").orderBy("line_no"))
    inside = rows.withColumn("broken", broken).where("start IS NOT NULL AND broken = 0 AND (line_no = start.line_no OR start.block)")
    own = inside.where("line_no > start.line_no OR NOT start.block").withColumn("text", F.when(F.col("key"), F.trim(F.regexp_extract("line", r"run:(.*)$", 1))).otherwise(F.expr("substring(line, start.own + 3)")))
    joined = own.groupBy("path", F.col("start.line_no").alias("host_line")).agg(F.min_by("label", "line_no").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("script"))
    return joined.withColumn("tainted", F.col("script").rlike(r"\$\{\{\s*(github\.(event|head_ref)|inputs)\."))


def rendered(found: DataFrame, style: str) -> DataFrame:
    """Diagnostics (path, line_no, code, severity) as text lines in report order: gcc, json, checkstyle or tty."""
    line = {
        "gcc": F.format_string("%s:%d:1: %s: [%s]", "path", "line_no", "severity", "code"),
        "json": F.to_json(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("severity").alias("level"), "code")),
        "checkstyle": F.format_string('<error file="%s" line="%d" severity="%s" source="%s"/>', F.replace(F.replace("path", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), "line_no", "severity", "code"),
        "tty": F.format_string("%s line %d: %s (%s)", "path", "line_no", "code", "severity"),
    }[style]
    return found.orderBy("path", "line_no", "code").select(line.alias("value"))


def with_ignores(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` with a directive behind each line that has findings, so that they are suppressed."""
    codes = found.groupBy("path", "line_no").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    marked = lines.join(codes, ["path", "line_no"], "left").withColumn("line", F.when(F.col("codes").isNotNull(), F.concat("line", F.lit("  # lint: ignore="), "codes")).otherwise(F.col("line")))
    return marked.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
