"""Chat formatting: typed content parts become ordered placeholders in one text with turn marks and a loss mask.

A turn's text is a plain string, or parts: a list of dicts with a type. ``Visitor`` flattens them in order; images,
audio and documents become placeholder marks, each with its reference and the number of tokens that it expands to.
Turns are written ``<|role|>\\ntext<|end|>\\n``. Within roles and texts a backslash is put behind each backslash, ``<``,
``[`` and ``|``, so that neither this template's marks nor those of others (``</s>``, ``[INST]``) can arise; taking away
the backslash behind each of the four gives the text back. The mask lists the spans of the assistants' texts.

Cases: parts that are no dict, and texts that are no string, are kept as their JSON text; sizes that are no finite number
above 0 count as missing: one patch, one token, one page; a null or empty text is an empty turn; a null role is the empty role; turns with equal numbers follow in the
order of role and text; null turn numbers come first; rows with a null conversation id form one conversation; an empty
table gives no rows; other columns are left out. Rows are dealt out by conversation and streamed in order, so only one
conversation's output is in memory, not a table of its turns.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, TURN_END = re.compile(r"<\|((?:[^\\<\[|]|[\\<\[|]\\)*)\|>\n"), "<|end|>\n"
_escaped, _unescaped = re.compile(r"[\\<\[|]"), re.compile(r"([\\<\[|])\\")


def escape(text: str) -> str:
    return _escaped.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _unescaped.sub(r"\1", text)


def amount(value: object, default: float) -> float:
    """A size as a number; ``default`` for what is none, is not finite or not above 0."""
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return default
    return number if 0 < number < float("inf") else default


@dataclass
class Attachment:
    kind: str
    reference: str
    position: int
    tokens: int


@dataclass
class Visitor:
    """Flattens typed parts in order, a method for each type; unknown types are kept as their JSON text."""

    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 512
    attachments: list[Attachment] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)

    def visit(self, part: object) -> None:
        if part is None:
            return
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        kind = part.get("type") if isinstance(part, dict) else None
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(str(kind), self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.pieces.append(escape(text if isinstance(text, str) else "" if text is None else json.dumps(text, sort_keys=True, ensure_ascii=False)))

    def visit_image(self, part: dict) -> None:
        side = lambda k: math.ceil(amount(part.get(k), self.image_patch) / self.image_patch)
        self.attach(part, "image", side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio", max(1, round(amount(part.get("seconds"), 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document", math.ceil(amount(part.get("pages"), 1)) * self.tokens_per_page)

    def visit_other(self, part: object) -> None:
        self.pieces.append(escape(json.dumps(part, sort_keys=True, ensure_ascii=False, default=str)))

    def attach(self, part: dict, kind: str, tokens: int) -> None:
        self.attachments.append(Attachment(kind, str(part.get("reference") or part.get("url") or ""), len(self.attachments), tokens))
        self.pieces.append(f"<|{kind}:{len(self.attachments) - 1}|>")

    def flatten(self, content: str | list | dict | None) -> str:
        self.pieces = []
        for part in content if isinstance(content, list) else [content]:
            self.visit(part)
        return "".join(self.pieces)


@dataclass
class Formatted:
    text: str
    mask: list[tuple[int, int]]
    attachments: list[Attachment]


def format_turns(turns: Iterator[tuple[str | None, str | list | None]]) -> Formatted:
    """One conversation in this template; mask spans are in code points of the formatted text."""
    visitor, out, at, mask = Visitor(), [], 0, []
    for role, content in turns:
        head, body = f"<|{escape(role or '')}|>\n", visitor.flatten(content)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TURN_END]
        at += len(head) + len(body) + len(TURN_END)
    return Formatted("".join(out), mask, visitor.attachments)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read back from a formatted conversation; placeholders stay as they are."""
    at = 0
    while at < len(text):
        head = OPEN.match(text, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        # the first unescaped end mark: '<' within a text always has a backslash behind it
        end = text.index(TURN_END, head.end())
        yield unescape(head[1]), unescape(text[head.end() : end])
        at = end + len(TURN_END)


FORMATTED = "conv_id long, formatted string, mask array<struct<start:long,end:long>>, attachments array<struct<kind:string,reference:string,position:long,tokens:long>>"


def conversations(rows: DataFrame, content: Callable[[str], str | list] | None = None) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): its text, loss mask and attachments.

    ``content`` turns a text column into typed parts, such as ``json.loads``; by default texts are plain.
    """
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    def format_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        done: list[tuple] = []
        held = 0
        types = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())])))])
        pack = lambda: pa.RecordBatch.from_pylist([dict(zip(types.names, d, strict=True)) for d in done], types)
        for conv, turns in groupby(stream(batches), key=lambda r: r[0]):
            f = format_turns((role, content(text) if content and text is not None else text) for _, role, text in turns)
            done.append((conv, f.text, [{"start": a, "end": b} for a, b in f.mask], [vars(x) for x in f.attachments]))
            held += len(f.text)
            if held > 4 << 20:
                yield pack()
                done, held = [], 0
        if done:
            yield pack()

    return ordered.mapInArrow(format_all, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and masks hold, read back from them alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                whole, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in parse(text):
                    whole.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in mask:
                    said = unescape(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                out.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(read, DIGESTS)
