"""Shell text to tokens of every level, as rows.

One pass over a text keeps a stack of what is open: substitutions, subshells, quotes, arithmetic. Words, operators,
redirections and keywords come out with the nest that they stand in, so commands inside ``$( )`` are rows as those
outside are. In a word's own text the commands of a nest are left out (``$()``), so that all texts together
are no longer than the script, however deep it nests.

What belongs together beyond that (keywords of a compound, commands, scopes, flow) is found by joins and windows over
these rows, in ``corvid.operators.scopes`` and ``corvid.operators.graph``.

Edge cases: a null text has no rows, an empty one neither. What is never closed has a null ``stop``. Closing marks
that close nothing are operators.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mean something of their own where a command begins.
KEYWORDS = frozenset("if then elif else fi for while until select do done case esac function { } ! time".split())
#: Behind these a command begins, or goes on to begin.
_OPENING = frozenset("if then elif else while until do { ! time".split())
_COMMAND = frozenset(["file", "$(", "`", "(", "=(", "<(", ">("])
_PLAIN = re.compile(r"[^\s;|&()<>\"'`$\\]+")
_OPERATOR = re.compile(r";;&|;;|;&|&&|\|\||\|&|[;|&]")
_REDIRECT = re.compile(r"(?:[0-9]+|\{[A-Za-z_][A-Za-z0-9_]*\})?(?:<<<|<<-?|>>|<&|>&|<>|>\||[<>])|&>>?")
_BLANK = re.compile(r"(?:[ \t\r\f\v]|\\\n)+")
_QUOTED = re.compile(r"[^\"\\$`]+")
_IN_BRACES = re.compile(r"[^}\"'\\$`]+")
_IN_SUMS = re.compile(r"[^()\"'\\$`]+")


class _Frame:
    """An open nest. ``begin`` is where its word began, ``pieces`` the word's text so far."""

    __slots__ = ("begin", "case", "depth", "kind", "last", "open", "pattern", "pieces", "start", "subject", "test", "wants")

    def __init__(self, kind: str, opened: int) -> None:
        self.kind, self.open, self.begin, self.pieces = kind, opened, -1, []
        self.start, self.case, self.pattern, self.test, self.wants, self.depth = True, 0, False, False, None, 0
        self.subject, self.last = 0, ""


def tokens_of(text: str) -> list[tuple[int, int | None, int, str, str]]:
    """at, stop, nest, kind and text of each token; ``nest`` is where the innermost nest around it opens, -1 for none.

    Kinds: word, keyword, pattern (of a ``case`` arm), operator, redirect, comment, body (of a here-document), and nest,
    whose text is its opening mark, ``=(`` for the words of an array and ``(`` for a subshell.
    """
    out: list[tuple[int, int | None, int, str, str]] = []
    frames = [_Frame("file", -1)]
    waiting: list[tuple[str, bool]] = []
    at, n = 0, len(text)

    def emit(kind: str, start: int, stop: int | None, said: str, nest: int) -> None:
        out.append((start, stop, nest, kind, said))

    def push(kind: str, mark: str) -> None:
        nonlocal at
        frames.append(_Frame(kind, at))
        at += len(mark)

    def pop(mark: str) -> None:
        nonlocal at
        f = frames.pop()
        at += len(mark)
        emit("nest", f.open, at, f.kind, frames[-1].open)
        outer = frames[-1]
        if f.kind == "(":
            outer.start = False
        elif f.kind in _COMMAND:
            outer.pieces.append(f"{f.kind.lstrip('=')}{mark}")
        elif outer.kind not in _COMMAND or outer.begin >= 0:
            outer.pieces.append("".join([_MARKS[f.kind], *f.pieces, mark]))

    def end_word(f: _Frame) -> None:
        if f.begin < 0:
            return
        said = "".join(f.pieces)
        kind = "word"
        if f.wants is not None:
            waiting.append((re.sub(r"[\\'\"]", "", said), f.wants))
            f.wants = None
        elif f.pattern and said != "esac":
            kind = "pattern"
        elif f.test:
            f.test = said != "]]"
        elif f.start and said in KEYWORDS:
            kind = "keyword"
            f.start = said in _OPENING
            if said == "case":
                f.case, f.subject = f.case + 1, 3
            elif said == "esac":
                f.case, f.pattern = max(0, f.case - 1), False
        elif f.start and said == "[[":
            f.test, f.start = True, False
        elif said == "in" and f.subject == 1:
            f.pattern, kind = True, "keyword"
        else:
            f.start = f.last == "function" or f.start and re.match(r"[A-Za-z_][A-Za-z0-9_]*(\[[^\]]*\])?\+?=", said) is not None
        f.subject, f.last = max(0, f.subject - 1), said
        emit(kind, f.begin, at, said, f.open)
        f.begin, f.pieces = -1, []

    def expansion(f: _Frame, quoted: bool) -> bool:
        """Opens what begins at a dollar sign or a backtick, if anything does."""
        nonlocal at
        for mark in ("$((", "$(", "${", "`"):
            if text.startswith(mark, at) and not (mark == "`" and f.kind == "`"):
                push(mark, mark)
                return True
        return False

    while at < n:
        f = frames[-1]
        c = text[at]
        if f.kind == '"':
            if c == '"':
                pop('"')
            elif c == "\\":
                f.pieces.append(text[at : at + 2])
                at += 2
            elif not (c in "$`" and expansion(f, True)):
                m = _QUOTED.match(text, at)
                f.pieces.append(m[0] if m else c)
                at = m.end() if m else at + 1
            continue
        if f.kind in ("${", "$((", "(("):
            sums = f.kind != "${"
            if not sums and c == "}":
                pop("}")
            elif sums and c == ")" and f.depth == 0 and text.startswith("))", at):
                pop("))")
            elif sums and c in "()":
                f.depth += 1 if c == "(" else -1
                f.pieces.append(c)
                at += 1
            elif c == "\\":
                f.pieces.append(text[at : at + 2])
                at += 2
            elif c == '"':
                push('"', '"')
            elif c == "'" and not any(g.kind == '"' for g in frames) and (close := text.find("'", at + 1)) >= 0:
                f.pieces.append(text[at : close + 1])
                at = close + 1
            elif not (c in "$`" and expansion(f, False)):
                m = (_IN_SUMS if sums else _IN_BRACES).match(text, at)
                f.pieces.append(m[0] if m else c)
                at = m.end() if m else at + 1
            continue
        # Commands.
        if (m := _BLANK.match(text, at)) is not None:
            if f.begin >= 0 and m[0] == "\\\n":
                at = m.end()
                continue
            end_word(f)
            at = m.end()
            continue
        if c == "\n":
            end_word(f)
            emit("operator", at, at + 1, "\n", f.open)
            f.start, at = True, at + 1
            for mark, tabs in waiting:
                start, line = at, None
                while at < n:
                    close = text.find("\n", at)
                    close = n if close < 0 else close
                    line = text[at:close]
                    at = min(close + 1, n)
                    if (line.lstrip("\t") if tabs else line) == mark:
                        emit("body", start, at, text[start : at - len(line) - (text[at - 1] == "\n")], f.open)
                        break
                else:
                    emit("body", start, None, text[start:], f.open)
            waiting.clear()
            continue
        if c == "#" and f.begin < 0:
            close = text.find("\n", at)
            close = n if close < 0 else close
            emit("comment", at, close, text[at:close], f.open)
            at = close
            continue
        if c == "`" and f.kind == "`":
            end_word(f)
            pop("`")
            continue
        if c == ")" and f.test and f.begin >= 0 and "(" not in "".join(f.pieces):
            end_word(f)
        elif c == ")" and not f.test:
            end_word(f)
        if c == ")" and f.kind not in ("`", "file") and not f.pattern and not f.test:
            pop(")")
            continue
        if f.test and f.begin < 0 and (m := re.compile(r"&&|\|\||[<>()]").match(text, at)):
            emit("word", at, m.end(), m[0], f.open)
            at = m.end()
            continue
        if c in "()" and not (f.test and f.begin >= 0):
            array = c == "(" and f.begin >= 0 and not f.pattern and f.pieces and f.pieces[-1].endswith("=")
            if array:
                push("=(", "(")
                continue
            end_word(f)
            if f.pattern:
                if c == ")":
                    emit("operator", at, at + 1, ")", f.open)
                    f.pattern, f.start = False, True
                at += 1
            elif c == "(" and (f.start or f.last == "for") and text.startswith("((", at):
                f.begin = at
                push("((", "((")
            elif c == "(" and (m := re.compile(r"\(\s*\)").match(text, at)):
                emit("operator", at, m.end(), "()", f.open)
                f.start, at = True, m.end()
            elif c == "(" and f.start:
                push("(", "(")
            elif c == "(":
                # The words of an array, or what only other shells know: part of a word.
                f.begin = at if f.begin < 0 else f.begin
                push("=(", "(")
            else:
                emit("operator", at, at + 1, ")", f.open)
                f.start, at = True, at + 1
            continue
        if c in "<>" and text.startswith("(", at + 1) and not f.test:
            f.begin = at if f.begin < 0 else f.begin
            push(f"{c}(", f"{c}(")
            continue
        if not f.test and (f.begin < 0 or c in "<>" or text.startswith("&>", at)) and (m := _REDIRECT.match(text, at)):
            end_word(f)
            emit("redirect", at, m.end(), m[0], f.open)
            if m[0].endswith(("<<", "<<-")) and not m[0].endswith("<<<"):
                f.wants = m[0].endswith("-")
            at = m.end()
            continue
        if (m := _OPERATOR.match(text, at)) is not None:
            end_word(f)
            if f.pattern and m[0] == "|":
                at = m.end()
                continue
            emit("operator", at, m.end(), m[0], f.open)
            f.start, at = True, m.end()
            if m[0] in (";;", ";&", ";;&") and f.case:
                f.pattern = True
            continue
        f.begin = at if f.begin < 0 else f.begin
        if c == "'":
            close = text.find("'", at + 1)
            if close < 0:
                emit("nest", at, None, "'", f.open)
                close = n - 1
            f.pieces.append(text[at : close + 1])
            at = close + 1
        elif c == '"':
            push('"', '"')
        elif c == "$" and text.startswith("$'", at):
            m = re.compile(r"\$'(?:[^'\\]|\\.)*'?", re.S).match(text, at)
            f.pieces.append(m[0])
            at = m.end()
        elif c == "\\":
            f.pieces.append(text[at : at + 2])
            at += 2
        elif not (c in "$`" and expansion(f, False)):
            m = _PLAIN.match(text, at)
            f.pieces.append(m[0] if m else c)
            at = m.end() if m else at + 1
    at = n
    while len(frames) > 1:
        f = frames.pop()
        if f.kind in _COMMAND:
            frames.append(f)
            end_word(f)
            frames.pop()
        emit("nest", f.open, None, f.kind, frames[-1].open)
        if f.kind not in _COMMAND:
            frames[-1].pieces.append("".join([_MARKS[f.kind], *f.pieces]))
    end_word(frames[0])
    out.sort(key=lambda t: (t[0], t[3] != "nest"))
    return out


_MARKS = {'"': '"', "${": "${", "$((": "$((", "((": "(("}
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def tokens(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key``, at, stop, line_no, col, end_line, end_col, nest, kind and text of each token.

    Lines and columns count from 1; ``end_col`` is the column behind the token.
    """
    schema = T.StructType([files.schema[key], *T._parse_datatype_string("at long, stop long, line_no int, col int, end_line int, end_col int, nest long, kind string, text string")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                some = batch.slice(i, 50)
                found = []
                for k, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
                    for at, stop, nest, kind, said in tokens_of(text):
                        line, last = bisect_right(breaks, at - 1), bisect_right(breaks, (len(text) if stop is None else stop) - 1)
                        found.append((k, at, stop, line, at - breaks[line - 1], last, (len(text) if stop is None else stop) - breaks[last - 1], nest, kind, said))
                columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(f.dataType.simpleString())) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return files.select(key, F.col(content).alias("_text")).mapInArrow(rows, schema)
