"""Names in scripts as relations: bindings, references, functions, calls, sourced files, and what follows from them.

Positions are (line_no, seg_no). Functions span from their opening line to the next line that starts
with a closing brace. Everything joins on the file first, so files are independent until source edges
connect them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.shell import commands, logical_lines
from corvid.operators.copies import distinct_texts, held
from corvid.operators.fixpoint import reachable
from corvid.operators.paths import resolved_sources
from corvid.storage import stored

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
# Names that every shell or session provides, and builtins of the common shells.
PREDEFINED = "HOME PATH PWD OLDPWD USER SHELL TERM LANG IFS PS1 PS2 RANDOM SECONDS LINENO UID EUID PPID OPTARG OPTIND HOSTNAME TMPDIR EDITOR REPLY BASH_SOURCE FUNCNAME PIPESTATUS LOGNAME SUDO_USER DOAS_USER BASH_LINENO BASH_REMATCH READLINE_LINE READLINE_POINT BASH_VERSION BASH_VERSINFO BASH_COMMAND BASHPID BASHOPTS SHELLOPTS OSTYPE MACHTYPE HOSTTYPE HISTCONTROL HISTSIZE HISTFILE HISTFILESIZE HISTCMD PROMPT_COMMAND PS3 PS4 COLUMNS LINES GROUPS DIRSTACK SHLVL CDPATH ENV BASH_ENV BASH MAIL OPTERR EPOCHSECONDS EPOCHREALTIME SRANDOM COMP_WORDS COMP_CWORD COMP_LINE COMP_POINT COMPREPLY MAPFILE COPROC DISPLAY PAGER VISUAL TZ LC_ALL LC_CTYPE LC_COLLATE LC_MESSAGES LC_NUMERIC".split()
BUILTINS = ". : [ alias bg break cd command continue echo eval exec exit export false fg getopts hash jobs kill let local printf pwd read readonly return set shift source test times trap true type ulimit umask unalias unset wait declare typeset".split()
_WRITERS = ("read", "export", "local", "declare", "typeset", "readonly", "unset", "getopts")


def bindings(facts: DataFrame) -> DataFrame:
    """path, line_no, seg_no, name, append and kind of each write; ``facts`` is of ``commands``."""
    assigned = facts.select("path", "line_no", "seg_no", F.explode("assigned").alias("word")).select("path", "line_no", "seg_no", F.regexp_extract("word", rf"^({_NAME})", 1).alias("name"), F.col("word").rlike(rf"^{_NAME}(\[[^\]]*\])?\+=").alias("append"), F.lit("assignment").alias("kind"))
    listed = facts.where(F.col("name").isin(*_WRITERS)).select("path", "line_no", "seg_no", F.col("name").alias("kind"), F.explode("args").alias("word"))
    declared = listed.where(F.col("word").rlike(rf"^{_NAME}(=|$)")).select("path", "line_no", "seg_no", F.regexp_extract("word", rf"^({_NAME})", 1).alias("name"), F.lit(False).alias("append"), "kind")
    loops = facts.where((F.col("name") == "for") & F.get("args", F.lit(0)).rlike(rf"^{_NAME}$")).select("path", "line_no", "seg_no", F.get("args", F.lit(0)).alias("name"), F.lit(False).alias("append"), F.lit("loop").alias("kind"))
    return assigned.unionByName(declared).unionByName(loops)


def references(files: DataFrame) -> DataFrame:
    """path, line_no, name and guarded of each distinct read; single quotes and comments hide names."""
    bare = F.regexp_replace(F.regexp_replace("line", r"(?<![^\s;|&()])#.*", ""), r"""("[^"\\]*+(?:\\.[^"\\]*+)*+")|'[^']*+'""", "$1")
    lines = logical_lines(files).withColumn("bare", bare)
    found = lambda pattern, guarded: lines.select("path", "line_no", F.explode(F.regexp_extract_all("bare", F.lit(pattern), F.lit(1))).alias("name"), F.lit(guarded).alias("guarded"))
    return found(rf"\$({_NAME})", False).unionByName(found(rf"\$\{{#?({_NAME})(?![A-Za-z0-9_]*:?[-=?+])", False)).unionByName(found(rf"\$\{{({_NAME}):?[-=?+]", True)).distinct()


def functions(files: DataFrame) -> DataFrame:
    """path, name, start and end line of each function definition."""
    lines = logical_lines(files)
    opening = rf"^\s*(?:function\s+)?({_NAME})\s*\(\)\s*\{{?|^\s*function\s+({_NAME})\b"
    name = F.coalesce(F.nullif(F.regexp_extract("line", opening, 1), F.lit("")), F.nullif(F.regexp_extract("line", opening, 2), F.lit("")))
    one_line = F.col("line").rlike(r"\}\s*;?\s*(#.*)?$")
    closing = F.when(F.col("line").rlike(r"^\}"), F.col("line_no"))
    after = F.min(closing).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing))
    last = F.max("line_no").over(Window.partitionBy("path"))
    marked = lines.select("path", "line_no", name.alias("name"), F.when(one_line, F.col("line_no")).otherwise(F.coalesce(after, last)).alias("end"))
    return marked.where("name IS NOT NULL").select("path", "name", F.col("line_no").alias("start"), "end")


def calls(facts: DataFrame, defined: DataFrame) -> DataFrame:
    """path, line_no, name and caller of each call of a function of the same file; null at the top level."""
    names = defined.select("path", "name").distinct()
    sites = facts.join(names, ["path", "name"]).select("path", "line_no", "name").distinct()
    headers = defined.select("path", "name", F.col("start").alias("line_no"))
    sites = sites.join(headers, ["path", "name", "line_no"], "left_anti")
    around = defined.select(F.col("path").alias("_path"), F.col("name").alias("caller"), "start", "end")
    inside = sites.join(around, (F.col("path") == F.col("_path")) & (F.col("line_no") > F.col("start")) & (F.col("line_no") <= F.col("end")), "left")
    return inside.groupBy("path", "line_no", "name").agg(F.max_by("caller", "start").alias("caller"))


def resolved_calls(sites: DataFrame, defined: DataFrame) -> DataFrame:
    """The definition that each call sees: the nearest before it, else the first behind it."""
    pairs = sites.join(defined.select("path", "name", "start"), ["path", "name"])
    before, behind = F.max(F.when(F.col("start") < F.col("line_no"), F.col("start"))), F.min("start")
    return pairs.groupBy("path", "line_no", "name").agg(F.coalesce(before, behind).alias("definition"))


def overwritten_functions(sites: DataFrame, defined: DataFrame) -> DataFrame:
    """Definitions that a later one of the same name replaces before any call: path, name, start, by."""
    later = F.lead("start").over(Window.partitionBy("path", "name").orderBy("start"))
    pairs = defined.select("path", "name", "start", later.alias("by")).where("by IS NOT NULL")
    used = sites.select(F.col("path").alias("_path"), F.col("name").alias("_name"), "line_no")
    return pairs.join(used, (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_name")) & F.col("line_no").between(F.col("start"), F.col("by")), "left_anti")


def early_calls(sites: DataFrame, defined: DataFrame) -> DataFrame:
    """Calls at the top level that stand before every definition of their function: path, name, line_no."""
    first = defined.groupBy("path", "name").agg(F.min("start").alias("first"))
    return sites.where("caller IS NULL").join(first, ["path", "name"]).where("line_no < first").select("path", "name", "line_no")


def uncalled_functions(sites: DataFrame, defined: DataFrame) -> DataFrame:
    """Functions that no chain of calls from the top level reaches."""
    roots = sites.where("caller IS NULL").select("path", F.col("name").alias("node")).distinct()
    edges = sites.where("caller IS NOT NULL").select("path", F.col("caller").alias("a"), F.col("name").alias("b")).distinct()
    reached = reachable(roots, edges, ["path"]).withColumnRenamed("node", "name")
    return defined.select("path", "name").distinct().join(reached, ["path", "name"], "left_anti")


def source_edges(facts: DataFrame) -> DataFrame:
    """path, line_no, target and kind (literal or dynamic) of each sourced file."""
    rows = facts.where(F.col("name").isin("source", ".") & (F.size("args") > 0))
    target = F.regexp_replace(F.get("args", F.lit(0)), r"""^["']|["']$""", "")
    return rows.select("path", "line_no", target.alias("target"), F.when(target.rlike(r"[$`]"), "dynamic").otherwise("literal").alias("kind"))


def followed_files(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file that literal source edges reach from ``roots`` (path); cycles end by themselves."""
    literal = edges.where("kind = 'literal'").select(F.col("path").alias("a"), F.col("target").alias("b")).distinct()
    return reachable(roots.select(F.col("path").alias("node")), literal).withColumnRenamed("node", "path")


def untracked_sources(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Literal source operands that name no input file."""
    return edges.where("kind = 'literal'").join(files.select(F.col("path").alias("target")), "target", "left_anti").select("path", "line_no", "target")


def unused_assignments(writes: DataFrame, reads: DataFrame, edges: DataFrame) -> DataFrame:
    """Assigned names that nothing reads: not their file, nor a file that sources it or that it sources."""
    tied = edges.where("kind = 'literal'").select("path", F.col("target").alias("other"))
    tied = tied.unionByName(tied.select(F.col("other").alias("path"), F.col("path").alias("other"))).distinct()
    names = reads.select("path", "name").distinct()
    seen = names.unionByName(tied.join(names.withColumnRenamed("path", "other"), "other").select("path", "name")).distinct()
    shared = writes.where(F.col("kind").isin("export", "unset")).select("path", "name").distinct()
    own = writes.where(F.col("kind").isin("assignment", "loop", "local", "read")).where(~F.col("name").isin(*PREDEFINED))
    return own.join(seen, ["path", "name"], "left_anti").join(shared, ["path", "name"], "left_anti").groupBy("path", "name").agg(F.max("line_no").alias("line_no"))


def undefined_variables(writes: DataFrame, reads: DataFrame, edges: DataFrame) -> DataFrame:
    """Unguarded reads of names that their file never writes or tests, nor a file that it sources or that sources it."""
    known = writes.select("path", "name").unionByName(reads.where("guarded").select("path", "name")).distinct()
    tied = edges.where("kind = 'literal'").select("path", F.col("target").alias("other"))
    tied = tied.unionByName(tied.select(F.col("other").alias("path"), F.col("path").alias("other"))).distinct()
    known = known.unionByName(tied.join(known.withColumnRenamed("path", "other"), "other").select("path", "name")).distinct()
    open_ = edges.where("kind = 'dynamic'").select("path").distinct()
    return reads.where(~F.col("guarded") & ~F.col("name").isin(*PREDEFINED)).join(known, ["path", "name"], "left_anti").join(open_, "path", "left_anti").select("path", "line_no", "name").distinct()


def resolve_commands(facts: DataFrame, defined: DataFrame, executables: DataFrame) -> DataFrame:
    """What each command name stands for: alias, function, builtin, the first folder's executable, or unknown.

    ``executables`` has dir_idx, folder and name.
    """
    aliases = facts.where("name = 'alias'").select("path", F.explode("args").alias("word")).select("path", F.split_part("word", F.lit("="), F.lit(1)).alias("name")).distinct().withColumn("is_alias", F.lit(True))
    names = defined.select("path", "name").distinct().withColumn("is_function", F.lit(True))
    first = executables.groupBy("name").agg(F.min_by("folder", "dir_idx").alias("folder"))
    sites = facts.where("name IS NOT NULL").select("path", "name").distinct()
    known = sites.join(aliases, ["path", "name"], "left").join(names, ["path", "name"], "left").join(first, "name", "left")
    kind = F.when(F.col("is_alias"), "alias").when(F.col("is_function"), "function").when(F.col("name").isin(*BUILTINS), "builtin").when(F.col("folder").isNotNull(), "executable").when(F.col("name").rlike(r"[$/`]"), "dynamic").otherwise("unknown")
    return known.select("path", "name", kind.alias("kind"), F.when(kind == "executable", F.col("folder")).alias("folder"))


def script_relations(files: DataFrame) -> dict[str, DataFrame]:
    """All relations of ``files`` (path, content). Facts are written once for those that rest on them; sources name input files where they can."""
    facts, defined = stored(commands(files), "commands"), stored(functions(files), "functions")
    edges = stored(resolved_sources(source_edges(facts), files), "sources")
    return {"commands": facts, "functions": defined, "bindings": bindings(facts), "references": references(files), "calls": calls(facts, defined), "source_edges": edges}


def shared_relations(files: DataFrame) -> dict[str, DataFrame]:
    """What ``script_relations`` gives, for ``files`` of which many have the same content: each distinct text is looked into once.

    Only what its sources name depends on where a file is.
    """
    copies = distinct_texts(files)
    facts, defined = stored(commands(copies.texts), "commands"), stored(functions(copies.texts), "functions")
    found = {"commands": facts, "functions": defined, "bindings": stored(bindings(facts), "bindings"), "references": stored(references(copies.texts), "references"), "calls": stored(calls(facts, defined), "calls")}
    edges = stored(resolved_sources(held(stored(source_edges(facts), "operands"), copies), files), "sources")
    return {name: held(rows, copies) for name, rows in found.items()} | {"source_edges": edges}
