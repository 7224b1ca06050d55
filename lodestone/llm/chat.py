"""Chat formatting with typed content parts.

A turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Control strings
inside roles and texts are escaped so that they can be told from the
template's own, and the escape can be undone.  Content parts other than text
become placeholders such as ``<|image_1|>``; the parts they stand for are
returned in order with the tokens they will take.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned.
LEARNED = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,placeholder:string,ref:string,tokens:bigint>>"
SEGMENT = (
    "conv_id bigint, turn_index bigint, role string, formatted string, start bigint, length bigint, "
    f"loss_start bigint, loss_length bigint, attachments {ATTACHMENTS}"
)
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: each gets a backslash inside, and one that has some gets one more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _amount(x: float | None) -> float:
    """A size as given; 0 if it is null, negative or no finite number."""
    return x if x is not None and math.isfinite(x) and x > 0 else 0


class PartVisitor:
    """Flattens parts of one turn in order; one method for each type."""

    def __init__(self, counters: dict[str, int]):
        self.counters, self.out, self.attachments = counters, [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        """A token for each started tile of 28 by 28 pixels, and two for the edges."""
        tiles = math.ceil(_amount(part.get("width")) / 28) * math.ceil(_amount(part.get("height")) / 28)
        self._attach("image", part, tiles + 2)

    def visit_audio(self, part: dict) -> None:
        """25 tokens a second, and two for the edges."""
        self._attach("audio", part, math.ceil(_amount(part.get("seconds")) * 25) + 2)

    def visit_document(self, part: dict) -> None:
        """1024 tokens a page, and two for the edges."""
        self._attach("document", part, _amount(part.get("pages")) * 1024 + 2)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, n: int) -> None:
        self.counters[kind] = self.counters.get(kind, 0) + 1
        name = f"<|{kind}_{self.counters[kind]}|>"
        self.out.append(name)
        self.attachments.append({"kind": kind, "placeholder": name, "ref": part.get("ref"), "tokens": n})


def format_turn(role: str, parts: list[dict], counters: dict[str, int]) -> tuple[str, int, int, list[dict]]:
    """Formatted turn, then place and length of its content, then its attachments."""
    visitor = PartVisitor(counters)
    for part in parts:
        visitor.visit(part)
    head, content = f"{START}{escape_role(role)}\n", "".join(visitor.out)
    return f"{head}{content}{END}\n", len(head), len(content), visitor.attachments


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn, in order: its piece of the conversation's formatted text.

    Concatenating ``formatted`` by ``turn_index`` gives the conversation;
    ``start`` is the piece's place in it, ``loss_start`` and ``loss_length``
    (in code points of the whole text) the part under the loss mask, null
    where nothing is learned.  ``turns`` has ``conv_id, turn, role`` and
    either ``text`` or ``parts`` (see ``PARTS``; a null falls back to text).

    A conversation is streamed in order through one task that holds one
    batch, however long it is, since digests and offsets of a text run from
    its start.  Null texts are empty, null roles are empty strings, rows with
    equal ``turn`` stand in order of role, text and parts, null turns first.
    Sizes of parts that are null, negative or not finite count as 0.
    Repeated rows are repeated turns.  Rows with a null ``conv_id`` are one
    conversation.  Clashing extra columns are not read.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in turns.columns else F.lit("")
    narrow = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), parts.alias("parts"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", F.to_json("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, index, at, counters = object(), 0, 0, {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["conv_id"] != conv:
                    conv, index, at, counters = r["conv_id"], 0, 0, {}
                content = r["parts"] if r["parts"] is not None else [{"type": "text", "text": r["text"]}]
                formatted, place, size, attachments = format_turn(r["role"], content, counters)
                learned = r["role"] == LEARNED
                rows.append({"conv_id": conv, "turn_index": index, "role": r["role"], "formatted": formatted, "start": at, "length": len(formatted), "loss_start": at + place if learned else None, "loss_length": size if learned else None, "attachments": attachments})
                index, at = index + 1, at + len(formatted)
            schema = schema or pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("placeholder", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ordered.mapInArrow(run, SEGMENT)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row per conversation with digests of what they say.

    The role, the text and the learned text of each turn are parsed from
    ``formatted`` and the mask alone.  Rows must come as ``format_chats``
    leaves them: conversations whole and in order within a partition.
    """
    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None
        conv = object()
        rows = []

        def finish():
            if state is not None:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    finish()
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = r["formatted"]
                head, _, body = piece.removeprefix(START).partition("\n")
                text = unescape(body.removesuffix(END + "\n"))
                state[0] += 1
                state[1].update(f"{unescape_role(head)}\n{text}\n".encode("utf-8", "surrogatepass"))
                if r["loss_start"] is not None:
                    a = r["loss_start"] - r["start"]
                    learned = unescape(piece[a : a + r["loss_length"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(run, kinds)
