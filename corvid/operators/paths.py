"""Paths of scripts, and the files that operands name.

An operand names the first of its candidates that is an input file: relative to the folder of the file that has it, then
to each root, then as it stands. Paths are compared once ``.`` and ``..`` are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """``path`` without empty parts and ``.``, and with ``..`` folded; what goes beyond the beginning stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def fold(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.regexp_replace(joined, r"^(\.\./?)+", ""))).otherwise(joined)


def candidates(path: Column, operand: Column, roots: tuple[str, ...] = ()) -> Column:
    """The paths that an operand of ``path`` may name, in order."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return F.when(operand.startswith("/"), F.array(normalized(operand))).otherwise(F.array_distinct(F.array(normalized(F.concat(folder, operand)), *[normalized(F.concat(F.lit(r + "/"), operand)) for r in roots], normalized(operand))))


def resolved_sources(edges: DataFrame, files: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` (path, target, kind and more) whose literal targets are the paths of input files where a candidate is one."""
    inputs = files.select(F.col("path").alias("found"), normalized(F.col("path")).alias("candidate"))
    literal = edges.where("kind = 'literal'").select("path", "target").distinct()
    tried = literal.select("path", "target", F.posexplode(candidates(F.col("path"), F.col("target"), roots)).alias("pos", "candidate"))
    first = tried.join(inputs, "candidate").groupBy("path", "target").agg(F.min(F.struct("pos", "found")).alias("first")).select("path", "target", F.col("first.found").alias("found"))
    return edges.join(first, ["path", "target"], "left").withColumn("target", F.coalesce("found", "target")).select(*edges.columns)
