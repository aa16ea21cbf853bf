r"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them into one text with ordered placeholders and records, for
each image, audio or document part, its reference, its place and the number of tokens its placeholder stands for. Turns are
formatted row by row; then the pieces of a conversation are put in order by one shuffle and a streaming pass, which keeps
running offsets only, so a conversation of any length needs the memory of its longest turn. (One conversation is read
by one task: its digest is sequential by definition; the formatting before it is not.)

Template: ``<s>[INST] text [/INST]`` for user turns, ``<s>[OUT] text [/OUT]</s>`` for assistant turns and
``<s>[TURN role] text [/TURN]`` for any other, the role percent-encoded. Control strings inside texts get a backslash after
their first character, one more if there are some; reading back removes one.

Defined cases: null texts, roles and part lists are empty; rows without conversation id form one conversation; turns of equal
number are in order of role and text, null numbers first; repeated rows are repeated turns; unknown part kinds fail; an empty
table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,at:bigint,tokens:bigint>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|\|[a-z_]+\|>|/?(?:INST|OUT|TURN)[\] ])")
# The same pattern for SQL.
CONTROL_SQL = r"[<\[]\\*(/?s>|\|[a-z_]+\|>|/?(INST|OUT|TURN)[\] ])"


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks(role: str) -> tuple[str, str]:
    """What stands before and after a turn's text."""
    if role == "user":
        return "<s>[INST] ", " [/INST]"
    if role == "assistant":
        return "<s>[OUT] ", " [/OUT]</s>"
    return f"<s>[TURN {quote(role, safe='')}] ", " [/TURN]"


class Flattener:
    """Visits the parts of a turn in order. ``patch`` pixels, ``frames`` a second and ``page`` tokens set the expansions."""

    def __init__(self, patch: int = 28, frames: float = 25.0, page: int = 256) -> None:
        self.patch, self.frames, self.page = patch, frames, page

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        self.text, self.attachments = "", []
        for part in parts:
            method = getattr(self, f"visit_{part['kind']}", None)
            if method is None:
                raise ValueError(f"unknown part kind {part['kind']!r}")
            method(part)
        return self.text, self.attachments

    def attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "at": len(self.text), "tokens": tokens})
        self.text += f"<|{part['kind']}|>"

    def visit_text(self, part: dict) -> None:
        self.text += escaped(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach(part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0) * self.frames))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part["pages"] or 0) * self.page)


FORMATTED = f"conv_id bigint, turn bigint, role string, piece string, loss_from bigint, loss_to bigint, attachments array<{ATTACHMENT}>"
ASSEMBLED = f"conv_id bigint, position bigint, start bigint, piece string, loss_from bigint, loss_to bigint, attachments array<{ATTACHMENT}>"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _format_task(flattener: Flattener, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("attachments", ATTACHMENTS)]
    for batch in batches:
        rows = []
        for conv, turn, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "parts"))):
            before, after = marks(role)
            text, attachments = flattener.visit(parts)
            for a in attachments:
                a["at"] += len(before)
            loss = (len(before), len(before) + len(text)) if role == "assistant" else (None, None)
            rows.append((conv, turn, role, before + text + after, *loss, attachments))
        yield _batch(rows, kinds)


def text_parts(turns: DataFrame) -> DataFrame:
    """Turns whose content is the column ``text`` as turns with one text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()]]
    return turns.select("conv_id", "turn", "role", F.array(F.struct(*fields)).alias("parts"))


def formatted(turns: DataFrame, flattener: Flattener | None = None) -> DataFrame:
    """Turns with ``parts`` as pieces of the template, with the code points of the piece that are under the loss mask."""
    flattener = flattener or Flattener()
    source = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"),
    )
    return source.mapInArrow(lambda b: _format_task(flattener, b), FORMATTED)


def _assemble_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("conv_id", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("piece", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("attachments", ATTACHMENTS)]
    current, position, start = ..., 0, 0
    for batch in batches:
        rows = []
        for conv, piece, low, high, attachments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to", "attachments"))):
            if conv != current:
                current, position, start = conv, 0, 0
            for a in attachments:
                a["at"] += start
            rows.append((conv, position, start, piece, None if low is None else low + start, None if high is None else high + start, attachments))
            position, start = position + 1, start + len(piece)
        yield _batch(rows, kinds)


def assembled(pieces: DataFrame) -> DataFrame:
    """Pieces in conversation order with their start in the conversation; a conversation's output is their concatenation.

    Rows of a conversation follow each other within one partition.
    """
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return dealt.mapInArrow(_assemble_task, ASSEMBLED)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a piece."""
    name = re.match(r"<s>\[(INST|OUT|TURN ([^\]]*))\] ", piece)
    role = {"INST": "user", "OUT": "assistant"}.get(name[1], unquote(name[2] or ""))
    before, after = marks(role)
    if not (piece.startswith(before) and piece.endswith(after)):
        raise ValueError("not a turn of this template")
    return role, unescaped(piece[len(before) : len(piece) - len(after)])


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    current, rows = ..., []

    def close():
        rows.append((current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv, start, piece, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "piece", "loss_from", "loss_to"))):
            if conv != current:
                if current is not ...:
                    close()
                current, n_turns, loss_chars, chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, text = parsed(piece)
            turns.update(f"{role}\n{text}\n".encode())
            n_turns, chars = n_turns + 1, start + len(piece)
            if low is not None:
                under = unescaped(piece[low - start : high - start])
                loss_chars += len(under)
                loss.update(under.encode())
        if rows:
            yield _batch(rows, kinds)
            rows = []
    if current is not ...:
        close()
        yield _batch(rows, kinds)


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, parsed from the output of ``assembled`` (in its order)."""
    return pieces.mapInArrow(_read_task, READ)


def report(turns: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return read_back(assembled(formatted(text_parts(turns))))
