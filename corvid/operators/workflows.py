"""Expressions in workflow files, and which of them carry what outsiders may write.

A file is cut once into its scalars by address (``jobs.build.steps[2].env.TITLE``). What each scalar defines (a name of
the environment, an output of a step or job) and what its expressions read are relations; a read goes to the nearest
definition that it can see, and taint spreads from outside input along those links as a fixpoint, within a file.

Block mappings, block sequences and plain, quoted, literal and folded scalars are understood; flow mappings and
anchors stay text, and each further line of a plain scalar is one of the same address. Expressions are taken as text: what they read are the dotted names in them, outside quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators.fixpoint import fixpoint
from corvid.storage import stored

# Contexts that someone outside of the project writes.
OUTSIDE = (
    r"github\.head_ref", r"github\.event\.(issue|pull_request|discussion)\.(title|body)", r"github\.event\.(comment|review|review_comment)\.body",
    r"github\.event\.pull_request\.head\.(ref|label)", r"github\.event\.pull_request\.head\.repo\.default_branch", r"github\.event\.pages\..*page_name",
    r"github\.event\.(head_commit|commits.*)\.(message|author\.(name|email))", r"github\.event\.workflow_run\.(head_branch|head_commit\.message)",
    r"github\.event\.(inputs|client_payload)\..*", r"inputs\..*",
)
_LINE = re.compile(r"^( *)((?:- +)*)(?:(\"[^\"]*\"|'[^']*'|[^\s#'\"\[{&*!|>%@`-][^:]*?|-[^\s:][^:]*?)\s*:(?=\s|$))?\s*(.*)$", re.S)


def _plain(value: str) -> str:
    """A scalar without its quotes or the comment behind it."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] == "'":
        return value[1:-1].replace("''", "'")
    if len(value) > 1 and value[0] == value[-1] == '"':
        return value[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    return re.split(r"\s#", value, maxsplit=1)[0].rstrip() if not value.startswith("#") else ""


def scalars_of(text: str) -> Iterator[tuple[int, str, str]]:
    """Line, address and value of each scalar of ``text``, in order."""
    open_: list[list] = []  # indent, name or number of the item
    block: list | None = None  # line, address, indent of its key, style, lines
    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        indent = len(line) - len(line.lstrip(" "))
        if block is not None:
            if not line.strip() or indent > block[2]:
                block[4].append(line)
                continue
            yield _ended(block)
            block = None
        if not line.strip() or line.lstrip().startswith("#") or line.startswith(("---", "...")):
            continue
        found = _LINE.match(line)
        if found is None:
            continue
        at, dashes, key, value = len(found[1]), found[2], found[3], found[4]
        bare = line.strip() == "-"
        if bare:
            dashes, key, value = "- ", None, ""
        for step in re.findall(r"- +", dashes):
            while open_ and (open_[-1][0] > at or open_[-1][0] == at and not isinstance(open_[-1][1], int)):
                # A sequence may stand as far out as the key that it belongs to.
                if open_[-1][0] == at and not isinstance(open_[-1][1], int):
                    break
                open_.pop()
            if open_ and open_[-1][0] == at and isinstance(open_[-1][1], int):
                open_[-1][1] += 1
            else:
                open_.append([at, 0])
            at += len(step)
        if key is not None:
            while open_ and (open_[-1][0] > at or open_[-1][0] == at):
                open_.pop()
            open_.append([at, _plain(key)])
        address = "".join(f"[{name}]" if isinstance(name, int) else f".{name}" for _, name in open_).lstrip(".")
        style = re.match(r"^([|>])[0-9+-]*\s*(#.*)?$", value)
        if style:
            block = [number, address, open_[-1][0] if open_ else -1, style[1], []]
        elif _plain(value):
            yield number, address, _plain(value)
    if block is not None:
        yield _ended(block)


def _ended(block: list) -> tuple[int, str, str]:
    number, address, _, style, lines = block
    own = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
    cut = [x[own:] for x in lines]
    while cut and not cut[-1].strip():
        cut.pop()
    return number, address, ("\n" if style == "|" else " ").join(cut)


def scalars(hosts: DataFrame) -> DataFrame:
    """path, line_no, address and value of each scalar of ``hosts`` (path, content); a null or empty content has none."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = ["path", "line_no", "address", "value"], []
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                for row in scalars_of(content):
                    rows.append((path, *row))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return hosts.where("content IS NOT NULL").select("path", "content").mapInPandas(cut, f"path {hosts.schema['path'].dataType.simpleString()}, line_no int, address string, value string")


def expressions(values: DataFrame) -> DataFrame:
    """``values`` (of ``scalars``) with seq and expression: what stands in each ``${{ }}``, as it is written."""
    found = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)\$\{\{\s*(.*?)\s*\}\}"), 1)).alias("seq", "expression")
    return values.select("path", "line_no", "address", found)


def definitions(values: DataFrame) -> DataFrame:
    """path, def, name, scope and rank, line_no and value of all that expressions can name.

    ``name`` is what reads say (``env.X``; ``steps.id.outputs.k`` and ``needs.job.outputs.k`` with the job in front
    of the first), ``scope`` the address whose inside sees it, and a greater ``rank`` hides lesser ones. Scripts define outputs and
    names of later steps by ``echo "k=..." >> $GITHUB_OUTPUT`` or ``$GITHUB_ENV``; their ``value`` is that line.
    """
    held = values.where(F.col("address").rlike(r"(^|\.)env\.[^.\[\]]+$"))
    scope = F.regexp_replace("address", r"(^|\.)env\.[^.\[\]]+$", "")
    step = F.col("scope").rlike(r"\.steps\[[0-9]+\]$")
    env = held.select("path", F.col("address").alias("def"), F.concat(F.lit("env."), F.regexp_extract("address", r"([^.]+)$", 1)).alias("name"), scope.alias("scope"), "line_no", "value")
    env = env.withColumn("rank", F.when(F.col("scope") == "", 0).when(step, F.lit(2**31 - 1)).otherwise(1))
    job = values.where(F.col("address").rlike(r"^jobs\.[^.]+\.outputs\.[^.]+$"))
    needs = F.concat(F.lit("needs."), F.regexp_extract("address", r"^jobs\.([^.]+)", 1), F.lit(".outputs."), F.regexp_extract("address", r"([^.]+)$", 1))
    outputs = job.select("path", F.col("address").alias("def"), needs.alias("name"), F.lit("").alias("scope"), "line_no", "value", F.lit(0).alias("rank"))

    runs = values.where(F.col("address").rlike(r"\.steps\[[0-9]+\]\.run$")).withColumn("step", F.regexp_replace("address", r"\.run$", ""))
    lines = runs.select("path", "step", "line_no", F.explode(F.split("value", "\n")).alias("value"))
    said = lines.withColumns({"key": F.regexp_extract("value", r"echo\s+[\"']?([A-Za-z_][\w-]*)=.*>>\s*\"?\$\{?GITHUB_(OUTPUT|ENV)\}?", 1), "kind": F.regexp_extract("value", r">>\s*\"?\$\{?GITHUB_(OUTPUT|ENV)\}?", 1)}).where("key <> ''")
    ids = values.where(F.col("address").rlike(r"\.steps\[[0-9]+\]\.id$")).select("path", F.regexp_replace("address", r"\.id$", "").alias("step"), F.col("value").alias("id"))
    owner = F.regexp_replace("step", r"\.?steps\[[0-9]+\]$", "")
    number = F.regexp_extract("step", r"\[([0-9]+)\]$", 1).cast("int")
    name = F.when(F.col("kind") == "OUTPUT", F.concat(F.lit("steps."), "id", F.lit(".outputs."), "key")).otherwise(F.concat(F.lit("env."), "key"))
    written = said.join(ids, ["path", "step"], "left").select("path", F.concat_ws("#", "step", "kind", "key").alias("def"), name.alias("name"), owner.alias("scope"), "line_no", "value", (number + 2).alias("rank"))
    return env.unionByName(outputs).unionByName(written.where("name IS NOT NULL"))


def _reads(values: DataFrame, defs: DataFrame) -> DataFrame:
    """path, reader, address, name and outside: the dotted names in the expressions of scalars, and of definitions.

    A definition that a script makes reads its line's expressions and, by ``$X`` or ``${X}``, names of its environment.
    """
    # Names in brackets are the same as behind a dot.
    dotted = F.regexp_replace(F.regexp_replace("expression", r"\['([^']*)'\]", ".$1"), r"'[^']*'", "")
    names = F.explode(F.regexp_extract_all(dotted, F.lit(r"\b([A-Za-z_][\w-]*(?:\.[\w*-]+|\[[^\]]*\])+)"), 1)).alias("name")
    of_values = expressions(values).select("path", F.concat_ws(":", "address", "seq").alias("reader"), "address", names)
    text = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\$\{\{\s*(.*?)\s*\}\}"), 1)).alias("expression")
    step = F.split("def", "#")[0]
    of_defs = defs.select("path", F.col("def").alias("reader"), step.alias("address"), text).select("path", "reader", "address", names)
    shell = F.explode(F.regexp_extract_all("value", F.lit(r"\$\{?([A-Za-z_]\w*)"), 1)).alias("said")
    of_shell = defs.where("def LIKE '%#%'").select("path", F.col("def").alias("reader"), step.alias("address"), shell).select("path", "reader", "address", F.concat(F.lit("env."), "said").alias("name"))
    return of_values.unionByName(of_defs).unionByName(of_shell).distinct()


def taints(hosts: DataFrame) -> DataFrame:
    """path, line_no, address, seq, expression and taint of each expression of ``hosts`` (path, content).

    ``taint`` is ``user`` if it reads outside input, or a definition that outside input comes into; ``trusted`` if all that it
    names is neither; ``unknown`` if some output that it names has no definition in the file, and nothing of it is of users.
    A read in a step sees names written by earlier steps of its job only, and of one name the nearest definition. In
    a file equal step ids of a job are one name, of which the last step before the read counts.
    """
    values = stored(scalars(hosts), "scalars")
    defs = stored(definitions(values), "definitions")
    reads = stored(_reads(values, defs), "reads")
    outside = F.col("name").rlike("^(" + "|".join(OUTSIDE) + ")$")
    # The step a read stands in: what it may see of its job is what earlier steps wrote.
    number = F.regexp_extract("address", r"^(?:.*\.)?steps\[([0-9]+)\]", 1)
    seen = reads.where(~outside).withColumn("number", F.when(number != "", number.cast("int")))
    far = defs.select("path", "name", "def", "scope", "rank")
    inside = (F.col("scope") == "") | F.col("address").startswith(F.concat("scope", F.lit("."))) | (F.col("address") == F.col("scope"))
    # Ranks of what steps write are their numbers and two; those of a step's own names are beyond all of them.
    earlier = (F.col("rank") < 2) | (F.col("rank") == 2**31 - 1) | F.col("number").isNull() | (F.col("rank") < F.col("number") + 2)
    itself = F.col("def") == F.col("reader")
    links = seen.join(far, ["path", "name"]).where(inside & earlier & ~itself).groupBy("path", "reader", "name").agg(F.max_by("def", F.struct("rank", "def")).alias("def"))
    links = stored(links.select("path", "reader", "name", "def"), "links")
    seed = reads.where(outside).select("path", F.col("reader").alias("node"))
    step = lambda new: new.withColumnRenamed("node", "def").join(links, ["path", "def"]).select("path", F.col("reader").alias("node"))
    tainted = fixpoint(seed, step).withColumn("is_user", F.lit(True))
    loose = seen.where(F.col("name").rlike(r"^(steps|needs)\..*outputs")).join(links.select("path", "reader", "name"), ["path", "reader", "name"], "left_anti").select("path", F.col("reader").alias("node")).distinct().withColumn("is_loose", F.lit(True))
    told = expressions(values).withColumn("node", F.concat_ws(":", "address", "seq")).join(tainted, ["path", "node"], "left").join(loose, ["path", "node"], "left")
    return told.select("path", "line_no", "address", "seq", "expression", F.when(F.col("is_user"), "user").when(F.col("is_loose"), "unknown").otherwise("trusted").alias("taint"))
