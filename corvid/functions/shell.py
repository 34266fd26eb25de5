"""Shell text to relations: logical lines, here-documents, commands, pipelines, assignments.

This is no parser. One small scan finds what joins lines: continuations, quotes and here-documents. A logical
line is then cut into comments, operators and words by one pattern that keeps quotes and substitutions
whole; operators end commands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAKS = re.compile(
    r"""(?P<comment>(?<![^\s;|&()])\#[^\n]*)|(?P<single>'[^']*')|(?P<double>"(?:\\.|[^"\\])*")|"""
    r"""(?P<here>(?<!<)<<(?P<tabs>-?)(?!<)[ \t]*(?P<quote>['"]?)(?P<tag>[A-Za-z_][A-Za-z0-9_]*)(?P=quote))|"""
    r"""(?P<joined>\\\n)|(?P<escape>\\.)|(?P<end>\n)""",
    re.S,
)
# Possessive throughout: a group that may give back what it has taken costs the matcher a stack frame a character.
_QUOTED = r"""'[^']*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\$\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)|\$\{[^}]*+\}|`[^`]*+`|\\."""
WORD = rf"""(?:[^\s'"\\|;&()<>`$]++|{_QUOTED}|\$)++"""
OPERATOR = r"&&|\|\||;;|\|&|[0-9]*(?:<<<|<<-?|>>|<&|>&|<>|>\||&>>?|[<>])|[|;&()]"
TOKEN = rf"(?:(?<![^\s;|&()])#.*)|{OPERATOR}|{WORD}"
_ENDS = ("&&", "||", ";;", "|&", "|", ";", "&", "(", ")")
# Words that stand before a command, and commands that run another.
LEADING = ("if", "then", "elif", "else", "do", "while", "until", "!", "{", "}", "time", "done", "fi", "esac")
WRAPPERS = ("sudo", "env", "command", "builtin", "exec", "nohup", "nice", "xargs", "busybox")


def scan(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, str, bool, bool, int, int | None]]]:
    """The logical lines of a script, with the number of the line where each starts, and its here-documents.

    Continued and quoted line breaks become blanks; bodies of here-documents are left out. A here-document
    is the line that opens it, its mark, whether that is quoted and tabs are stripped, its first line, and
    the line that closes it.
    """
    out, documents = [], []
    pieces: list[str] = []
    waiting: list[re.Match] = []
    at, number, first = 0, 1, 1
    while (m := _BREAKS.search(text, at)) is not None:
        kind = next(k for k in ("comment", "single", "double", "here", "joined", "escape", "end") if m[k] is not None)
        pieces.append(text[at : m.start()])
        at = m.end()
        if kind != "end":
            number += m[0].count("\n")
            pieces.append(" " if kind == "joined" else m[0].replace("\n", " "))
            if kind == "here":
                waiting.append(m)
            continue
        out.append((first, "".join(pieces)))
        pieces, number = [], number + 1
        for mark in waiting:
            close = re.compile(rf"^{chr(9) + '*' if mark['tabs'] else ''}{mark['tag']}$", re.M).search(text, at)
            body = number
            number += text.count("\n", at, close.start() if close else len(text)) + 1
            documents.append((first, mark["tag"], bool(mark["quote"]), bool(mark["tabs"]), body, number - 1 if close else None))
            at = min(close.end() + 1, len(text)) if close else len(text)
            if not close or close.end() == len(text):
                return out, documents
        waiting, first = [], number
    pieces.append(text[at:])
    documents += [(first, mark["tag"], bool(mark["quote"]), bool(mark["tabs"]), number + 1, None) for mark in waiting]
    return [*out, (first, "".join(pieces))], documents


def _scanned(files: DataFrame, key: str, content: str, part: int, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([files.schema[key], *fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                found = [(k, *row) for k, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if text is not None for row in scan(text)[part]]
                columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
                kinds = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return files.select(key, F.col(content).alias("_text")).mapInArrow(rows, schema)


def logical_lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key``, ``line_no`` where each line starts, and ``line``, joined and without here-documents. A null has none."""
    return _scanned(files, key, content, 0, [T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])


def here_documents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key``, ``line_no``, ``mark``, ``quoted``, ``tabs``, ``start`` and ``end`` (null if it is never closed)."""
    fields = [T.StructField("line_no", T.IntegerType()), T.StructField("mark", T.StringType()), T.StructField("quoted", T.BooleanType()), T.StructField("tabs", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    return _scanned(files, key, content, 1, fields)


def _segments(tokens: Column) -> Column:
    """Commands of a line: the operator before each, its words and its redirects."""
    kind = "struct<before:string,words:array<string>,redirects:array<string>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit("").alias("before"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("redirects"), F.lit("").alias("open"))

    def step(s: Column, t: Column) -> Column:
        ends, redirect = t.isin(*_ENDS), t.rlike(r"^[0-9]*(<<<|<<-?|>>|<&|>&|<>|>\||&>>?|[<>])$")
        taken = F.array(F.struct(s["before"].alias("before"), s["words"].alias("words"), s["redirects"].alias("redirects")))
        some = (F.size(s["words"]) > 0) | (F.size(s["redirects"]) > 0)
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(ends & some, F.concat(s["done"], taken)).otherwise(s["done"]).alias("done"),
            F.when(ends, t).otherwise(s["before"]).alias("before"),
            F.when(ends, none).when(redirect | (s["open"] != ""), s["words"]).otherwise(F.concat(s["words"], F.array(t))).alias("words"),
            F.when(ends, none).when(s["open"] != "", F.concat(s["redirects"], F.array(F.concat(s["open"], t)))).otherwise(s["redirects"]).alias("redirects"),
            F.when(redirect, t).otherwise(F.lit("")).alias("open"),
        )

    last = lambda s: F.when((F.size(s["words"]) > 0) | (F.size(s["redirects"]) > 0), F.concat(s["done"], F.array(F.struct(s["before"].alias("before"), s["words"].alias("words"), s["redirects"].alias("redirects"))))).otherwise(s["done"])
    return F.aggregate(F.filter(tokens, lambda t: ~t.startswith("#")), start, step, last)


def _skip(words: Column, test) -> Column:
    """``words`` from the first that fails ``test`` on."""
    state = F.aggregate(words, F.struct(F.lit(True).alias("lead"), F.array().cast("array<string>").alias("rest")), lambda s, w: F.struct((s["lead"] & test(w)).alias("lead"), F.when(s["lead"] & test(w), s["rest"]).otherwise(F.concat(s["rest"], F.array(w))).alias("rest")), lambda s: s["rest"])
    return state


def commands(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row for each simple command.

    ``seg_no`` is its place in the line, ``before`` the operator in front, ``leading`` the keywords, ``assigned`` the words of
    assignment in front, ``name`` the command without them, ``args`` the other words, ``effective``
    the command that a wrapper runs, ``next_name`` and ``next_args`` those of the command that it pipes into.
    """
    tokens = F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))
    cut = logical_lines(files, key, content).select(key, "line_no", "line", F.posexplode(_segments(tokens)).alias("seg_no", "c"))
    words = _skip(F.col("c.words"), lambda w: w.isin(*LEADING))
    rows = cut.select(key, "line_no", "line", "seg_no", F.col("c.before").alias("before"), F.col("c.redirects").alias("redirects"), F.col("c.words").alias("all_words"), words.alias("w"))
    rows = rows.withColumn("rest", _skip(F.col("w"), lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\[[^\]]*\])?\+?=")))
    rows = rows.withColumn("assigned", F.slice("w", F.lit(1), F.size("w") - F.size("rest"))).withColumn("leading", F.slice("all_words", F.lit(1), F.size("all_words") - F.size("w")))
    inner = _skip(F.col("rest"), lambda w: w.isin(*WRAPPERS) | w.startswith("-"))
    rows = rows.withColumn("inner", inner)
    args = F.when(F.size("rest") > 1, F.slice("rest", 2, F.size("rest"))).otherwise(F.array().cast("array<string>"))
    out = rows.select(key, "line_no", "line", "seg_no", "before", "redirects", "all_words", "leading", "assigned", F.get("rest", F.lit(0)).alias("name"), args.alias("args"), F.get("inner", F.lit(0)).alias("effective"))
    w = Window.partitionBy(key, "line_no").orderBy("seg_no")
    piped = F.lead("before").over(w).isin("|", "|&")
    return out.withColumn("next_name", F.when(piped, F.lead("effective").over(w))).withColumn("next_args", F.when(piped, F.lead("args").over(w)))


def dialect_of(path: Column, content: Column) -> Column:
    """The shell that a script is for: by its marker line, then its name, else unknown."""
    marker = F.regexp_extract(content, r"^#![^\n]*?(?:/|env +)(bash|dash|sh|ksh|mksh|zsh|fish)\b", 1)
    ending = F.regexp_extract(path, r"\.(sh|bash|dash|ksh|zsh|fish)$", 1)
    return F.when(marker != "", marker).when(ending != "", ending).otherwise("unknown")
