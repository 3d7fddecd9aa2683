"""Chat formatting: turns of typed content parts as one text with ordered placeholders, attachments and a loss mask.

A turn's content is a list of parts: text, image, audio or document.  A visitor walks over them in order and has one
method for each kind.  Text is written with its control strings escaped; any other part becomes a numbered placeholder,
and its reference, its place and the number of tokens it expands to are recorded.  A turn is

    <|turn|>role<|text|>content<|end|>\\n

and two text parts in a row have ``<|part|>`` between them.  Escaping puts a backslash behind the first character of
every control string, of this template and of other common ones, and one more where backslashes already stand; so no
text holds a control string, and removing one backslash gives the text back.  The loss mask is a list of spans of code
points in the formatted text: the text parts of the assistant, nothing else.

The formatted text lies in blocks (see ``blocks``): a conversation of any length is written by several tasks, one block in
memory at a time, and read back in order.

Expanded tokens: an image takes one for each started square of ``PATCH`` pixels, one more per row of squares; audio
``AUDIO_RATE`` a second, rounded up; a document ``PAGE_TOKENS`` a page.  Where the measures are missing or not positive,
it is one token.

Defined results: turns go by turn, nulls first, then role and content; null text and null roles are empty, null parts
left out; an unknown kind is a placeholder ``other`` of one token; a turn without parts has empty content; a null
conversation id is a conversation; rows that repeat a turn are turns each; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import blocks
from tracewell.llm.tables import written

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 640
#: Whose texts are under the loss mask.
LEARNED = "assistant"
TURN, TEXT, END, NEXT = "<|turn|>", "<|text|>", "<|end|>\n", "<|part|>"
#: What may follow the first character of a control string: this template's, and those of other common templates.
_REST = r"(?:\|[a-z_]{1,32}(?::[0-9]{1,9})?\|>|/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_MARK = re.compile(r"<\|([a-z_]+)(?::([0-9]+))?\|>")

BLOCK = (
    "conv_id long, part int, block int, whole boolean, n_turns long, formatted string, loss array<struct<begin:int,end:int>>, "
    "attachments array<struct<turn:int,number:int,kind:string,ref:string,at:int,tokens:long>>")
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class Flatten:
    """Visits the parts of one turn; collects its content, the spans of its texts and its attachments."""

    def __init__(self, begin: int = 0):
        self.content: list[str] = []
        self.at, self.number, self.after_text = begin, 0, False
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part["kind"] if part["kind"] in ("text", "image", "audio", "document") else "other"
        getattr(self, f"visit_{kind}")(part)

    def _write(self, text: str) -> None:
        self.content.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        if self.after_text:
            self._write(NEXT)
        begin = self.at
        self._write(escape(part["text"] or ""))
        self.texts.append((begin, self.at))
        self.after_text = True

    def visit_image(self, part: dict) -> None:
        wide, high = part["width"] or 0, part["height"] or 0
        squares = -(-wide // PATCH) + 1, -(-high // PATCH)
        self._attach("image", part, squares[0] * squares[1] if wide > 0 and high > 0 else 1)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0.0
        self._attach("audio", part, math.ceil(seconds * AUDIO_RATE) if 0 < seconds < math.inf else 1)

    def visit_document(self, part: dict) -> None:
        pages = part["pages"] or 0
        self._attach("document", part, pages * PAGE_TOKENS if pages > 0 else 1)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"number": self.number, "kind": kind, "ref": part["ref"], "at": self.at, "tokens": tokens})
        self._write(f"<|{kind}:{self.number}|>")
        self.number += 1
        self.after_text = False


def _block(rows: list[dict]) -> dict:
    """One block's formatted text with its spans, which count from the block's start."""
    out, at, loss, attachments = [], 0, [], []
    for number, row in enumerate(rows):
        role = row["role"] or ""
        head = f"{TURN}{escape(role)}{TEXT}"
        turn = Flatten(at + len(head))
        for part in row["parts"] or ():
            if part is not None:
                turn.visit(part)
        out += [head, *turn.content, END]
        at = turn.at + len(END)
        attachments += [{"turn": number, **a} for a in turn.attachments]
        if role == LEARNED:
            loss += [{"begin": b, "end": e} for b, e in turn.texts]
    return {"n_turns": len(rows), "formatted": "".join(out), "loss": loss, "attachments": attachments}


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[str, object]]]]:
    """Role and parts of every turn of a formatted text: ``("text", text)``, else ``(kind, number)``."""
    at = 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            break
        at, parts, begin, last = turn.end(), [], 0, None
        content = turn[2]
        for mark in _MARK.finditer(content):
            if mark.start() > begin or last == "part" or mark[1] == "part":
                parts.append(("text", unescape(content[begin:mark.start()])))
            if mark[1] != "part":
                parts.append((mark[1], int(mark[2])))
            begin, last = mark.end(), mark[1]
        if len(content) > begin or last in (None, "part"):
            parts.append(("text", unescape(content[begin:])))
        yield unescape(turn[1]), parts
    if at != len(formatted):
        raise ValueError(f"damaged chat text at character {at}")


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("formatted", ""))
        if len(held) >= most or size >= blocks.CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_ATTACHED = pa.struct([("turn", pa.int32()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()),
                       ("tokens", pa.int64())])
_BLOCK_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
    ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHED))])
_DIGEST_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    chars = lambda row: sum(len(p["text"] or "") for p in row["parts"] or () if p)
    found = ({"conv_id": key, "part": part, "block": number, "whole": whole, **_block(rows)}
             for key, number, whole, rows in blocks.cut(blocks.rows_of(batches), chars))
    yield from _batches(found, _BLOCK_ARROW)


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted blocks of ``turns`` (``conv_id, turn, role, parts``), written to the shared folder.

    ``conv_id, part, block, whole, n_turns, formatted, loss, attachments``; places count from the start of a block, and a
    conversation's blocks follow each other by ``part, block``.
    """
    rows = turns.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return written(blocks.dealt(rows, "parts").mapInArrow(_format, BLOCK), "chat_blocks")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(key, run: Iterator[dict]) -> dict:
        turns, loss, n, masked, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for block in run:
            text = block["formatted"]
            for role, parts in read_turns(text):
                n += 1
                turns.update(f"{role}\n".encode())
                for kind, value in parts:
                    turns.update((value if kind == "text" else f"<|{kind}:{value}|>").encode())
                turns.update(b"\n")
            for span in block["loss"]:
                plain = unescape(text[span["begin"]:span["end"]])
                masked += len(plain)
                loss.update(plain.encode())
            chars += len(text)
        return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": masked, "loss_sha256": loss.hexdigest(),
                "formatted_chars": chars}

    yield from _batches((one(*run) for run in blocks.grouped(blocks.rows_of(batches))), _DIGEST_ARROW, 512)


def read_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its blocks: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Blocks that hold a whole conversation are read where they lie; the others are brought together.
    """
    narrow = formatted.select("conv_id", "part", "block", "whole", "formatted", "loss")
    return narrow.filter("whole").mapInArrow(_digest, DIGEST).union(
        blocks.in_order(narrow.filter("not whole")).mapInArrow(_digest, DIGEST))


def plain_turns(conversations: DataFrame) -> DataFrame:
    """Turns whose whole content is one text."""
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))]
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *none)
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
