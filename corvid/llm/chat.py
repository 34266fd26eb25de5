"""Chats of typed content parts as one text with marks, and read back from it.

A visitor flattens the parts of a message in their order: text stays, with its control strings escaped; an image, a
sound or a document becomes a placeholder with the attachment's number in its message. What a placeholder stands for, where
it is, and how many tokens it expands to is recorded beside the text. A turn is
``<|im_start|>role``, a line break, its content, ``<|im_end|>`` and a line break.

In texts and roles ``<|`` gets a backslash between its two characters, and one more if there are some already, so
nothing in them looks like a mark, and taking one away gives them back. In roles, backslashes and line breaks are
escaped first, since a role is one line. The loss mask is spans of a piece's characters: what assistants say.

Messages are formatted one by one, each into a piece of its own, without a shuffle. A chat is its pieces by turn; to read
it, they are sorted within a partition and stream through, one held at a time, since a digest of a whole chat takes it
in order. So a chat that holds a large part of all messages costs one task's time in that last step, but no memory.

Edge cases: a message without parts, or with none but empty ones, is an empty text; a null text is empty. Text parts that
follow each other are one text when read back. A null role is empty. Parts of an unknown type are attachments of
no tokens, as are those that lack their sizes. Messages of the same turn go by
their pieces, so by role first; a null turn comes first.
A null id is a chat of its own. Only the named columns are read. No messages: no chats.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvid.llm.batches import sliced
from corvid.storage import stored

#: The type of a message's content.
PARTS = "array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
START, END = "<|im_start|>", "<|im_end|>\n"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())]))
_PIECE = "piece string, loss array<struct<start:bigint,stop:bigint>>, attachments array<struct<number:bigint,kind:string,ref:string,at:bigint,n_tokens:bigint>>"
_HOLDER = re.compile(r"<\|(image|audio|document|attachment)_([0-9]+)\|>")


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@dataclass(frozen=True)
class Rates:
    """Pixels of a patch's side, and tokens of a patch, a second and a page."""

    patch: int = 28
    patch_tokens: int = 1
    second_tokens: float = 25.0
    page_tokens: int = 256


class Flattener:
    """Visits the parts of a message in order, and numbers its attachments from 1."""

    def __init__(self, rates: Rates) -> None:
        self.rates = rates
        self.out: list[str] = []
        self.at = 0
        self.found: list[dict] = []

    def message(self, role: str | None, parts: list[dict] | None) -> tuple[str, list[dict], list[dict]]:
        """The message's piece, its loss spans and its attachments."""
        self.out, self.at, self.found = [], 0, []
        self._put(f"{START}{escaped_role(role or '')}\n")
        begin = self.at
        # Texts that touch are escaped as one: a control string may lie across them.
        held = ""
        for part in parts or []:
            if part is not None and part["type"] == "text":
                held += part["text"] or ""
            elif part is not None:
                self._put(escaped(held))
                held = ""
                getattr(self, f"visit_{part['type']}", self.visit_other)(part)
        self._put(escaped(held))
        loss = [{"start": begin, "stop": self.at}] if role == "assistant" else []
        self._put(END)
        return "".join(self.out), loss, self.found

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.found) + 1
        self.found.append({"number": number, "kind": kind, "ref": part["ref"], "at": self.at, "n_tokens": tokens})
        self._put(f"<|{kind}_{number}|>")

    def visit_image(self, part: dict) -> None:
        sides = [math.ceil((part[x] or 0) / self.rates.patch) for x in ("width", "height")]
        self._attach("image", part, sides[0] * sides[1] * self.rates.patch_tokens)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0.0
        self._attach("audio", part, math.ceil(seconds * self.rates.second_tokens) if math.isfinite(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * self.rates.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("attachment", part, 0)


def parts_of(content: str) -> list[dict]:
    """The parts that a turn's content shows: texts, and kind and number of each attachment."""
    out, at = [], 0
    for m in _HOLDER.finditer(content):
        if m.start() > at:
            out.append({"type": "text", "text": unescaped(content[at : m.start()]), "number": None})
        out.append({"type": m[1], "text": None, "number": int(m[2])})
        at = m.end()
    if at < len(content):
        out.append({"type": "text", "text": unescaped(content[at:]), "number": None})
    return out


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", rates: Rates = Rates()) -> DataFrame:
    """conv_id, turn, piece, loss and attachments of each message, stored.

    A chat's text is its pieces by ``turn``. Loss spans and the attachments' ``at`` are characters of the piece.
    """
    kinds = {x: messages.schema[x].dataType.simpleString() for x in (conv_id, turn)}
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(parts).cast(PARTS).alias("parts"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Flattener(rates)
        for batch in sliced(batches):
            out = map(visitor.message, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), _SPANS, _ATTACHED), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv_id", "turn", "piece", "loss", "attachments"])

    return stored(rows.mapInArrow(write, f"conv_id {kinds[conv_id]}, turn {kinds[turn]}, {_PIECE}"), "chats")


def _turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """role and content of the turns that follow each other in a text that comes in pieces."""
    held = ""
    for piece in pieces:
        held += piece
        while (end := held.find(END)) >= 0:
            mark, content = held[:end].split("\n", 1)
            if not mark.startswith(START):
                raise ValueError("a turn without its mark")
            yield unescaped_role(mark[len(START) :]), content
            held = held[end + len(END) :]
    if held:
        raise ValueError("a turn without its end")


def _streamed(pieces: DataFrame, of_chat: Callable[[Iterator[dict]], Iterator[tuple]], names: str, types: list[pa.DataType]) -> DataFrame:
    """conv_id and what ``of_chat`` gives for the pieces of each chat, in order."""
    id_type = to_arrow_type(pieces.schema["conv_id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in sliced(batches) for r in batch.to_pylist())
        found = ((chat, *out) for chat, of in groupby(rows, key=lambda r: r["conv_id"]) for out in of_chat(of))
        while held := list(islice(found, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), [id_type, *types], strict=True)], ["conv_id", *(x.split()[0] for x in names.split(", "))])

    ordered = pieces.select("conv_id", "turn", "piece", "loss", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.mapInArrow(read, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {names}")


def read_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, number, role and parts (type, text, attachment number) of each turn, from the text alone."""

    def of_chat(rows: Iterator[dict]) -> Iterator[tuple]:
        for n, (role, content) in enumerate(_turns(r["piece"] for r in rows)):
            yield n, role, parts_of(content)

    found = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("number", pa.int64())]))
    return _streamed(pieces, of_chat, "number bigint, role string, parts array<struct<type:string,text:string,number:bigint>>", [pa.int64(), pa.string(), found])


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments and attachment_tokens of each chat.

    Turns are read back from the text, and what the loss mask shows is cut out of it by the spans alone. The
    digest of turns is of role, line break, text (placeholders as they are), line break.
    """

    def of_chat(rows: Iterator[dict]) -> Iterator[tuple]:
        said, lost, chars, size, attached, tokens, n = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0

        def through() -> Iterator[str]:
            nonlocal chars, size, attached, tokens
            for r in rows:
                size += len(r["piece"])
                attached, tokens = attached + len(r["attachments"]), tokens + sum(a["n_tokens"] for a in r["attachments"])
                for span in r["loss"]:
                    text = unescaped(r["piece"][span["start"] : span["stop"]])
                    chars += len(text)
                    lost.update(text.encode())
                yield r["piece"]

        for role, content in _turns(through()):
            said.update(f"{role}\n{unescaped(content)}\n".encode())
            n += 1
        yield n, said.hexdigest(), chars, lost.hexdigest(), size, attached, tokens

    number, text = pa.int64(), pa.string()
    return _streamed(pieces, of_chat, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint", [number, text, number, text, number, number, number])
