"""Chat formatting (operator 6): typed content parts, flattened by a visitor into one reversible template.

A turn is a header `<|turn|>role`, a line end, its parts, and `<|end|>`. A content part is text, image, audio or
document. The visitor writes text escaped and every other part as a placeholder `<|kind|>`, in order; it records
which attachment the placeholder stands for and into how many tokens that one expands. A part of any other type is
an attachment of the kind `unknown`, which expands into none; a part without a type is text.

Control strings inside texts are broken by a backslash after their first character, and a backslash that is
there already gets one more. So no text holds a control string once it is escaped, and unescaping gives back
exactly what was there. The strings of other common templates (`<s>`, `[INST]`, `<<SYS>>` and their ends) are
broken as well. A role is escaped likewise, and its line ends and backslashes are written as `\\n` and `\\\\`.

Only the contents of assistant turns are under the loss mask. Formatting is a matter of single turns, so a
conversation of any length is many rows; only what reads the whole conversation walks through its rows in order,
in one pass that holds one batch. Turns are ordered by turn number (nulls first), then role and text; null texts and
roles are empty; rows that repeat are turns of their own; a null conversation id is one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

TURN, END = "<|turn|>", "<|end|>"
_TAIL = r"(\||/?s>|<SYS>|</SYS>|/?INST\])"
_BREAK = re.compile(rf"([<\[])(\\*){_TAIL}")
_MEND = re.compile(rf"([<\[])\\(\\*){_TAIL}")
#: Tokens that an attachment takes: per image tile, second of audio and document page.
IMAGE_TILE, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 25, 512


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MEND.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Flattener:
    """Visits the parts of one turn: `out` collects the text, `attachments` what the placeholders stand for."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.text: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind, self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def flush(self) -> None:
        """Neighbouring texts are escaped as one, as a control string could lie across them."""
        self.out.append(escape("".join(self.text)))
        self.text = []

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-int(part.get(k) or 0) // IMAGE_TILE)) for k in ("width", "height"))
        self._attach("image", part, across * down * IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -(-int(1000 * (part.get("seconds") or 0)) * AUDIO_TOKENS // 1000)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(part.get("pages") or 0)) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self._attach("unknown", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "position": len(self.attachments), "ref": part.get("ref") or "", "tokens": tokens})
        self.flush()
        self.out.append(f"<|{kind}|>")


def flatten(parts: list[dict] | None) -> tuple[str, list[dict]]:
    v = Flattener()
    for p in parts or []:
        v.visit(p or {})
    v.flush()
    return "".join(v.out), v.attachments


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_SCHEMA = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, expanded_tokens long, attachments array<struct<kind:string,position:long,ref:string,tokens:long>>"


def text_part(text: Column) -> Column:
    """A text column as a turn's only content part."""
    blank = {k: F.lit(None).cast(t) for k, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(c.alias(k) for k, c in blank.items())))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts array<PART>) as formatted turns.

    `loss_start` and `loss_end` are offsets into `formatted` (equal where no loss is taken); `expanded_tokens`
    counts what the turn's attachments expand into. A conversation is its turns' `formatted`, in order.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("position", pa.int64()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            roles = [r or "" for r in b.column(2).to_pylist()]
            out, starts, ends, attached = [], [], [], []
            for role, parts in zip(roles, b.column(3).to_pylist(), strict=True):
                content, attachments = flatten(parts)
                head = f"{TURN}{escape_role(role)}\n"
                out.append(f"{head}{content}{END}")
                starts.append(len(head))
                ends.append(len(head) + (len(content) if role == "assistant" else 0))
                attached.append(attachments)
            tokens = [sum(a["tokens"] for a in x) for x in attached]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(out, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(tokens, pa.int64()), pa.array(attached, kind)],
                ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"],
            )

    columns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>"))
    return columns.mapInArrow(run, TURN_SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation of text parts."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        if not piece.endswith(END):
            raise ValueError("a turn without its end")
        role, content = piece[: -len(END)].split("\n", 1)
        turns.append((unescape_role(role), unescape(content)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, of what the formatted turns hold: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows are hashed as they stream by, so a conversation needs no memory of its own."""

    class One:
        def __init__(self, conv_id: int | None) -> None:
            self.id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
            self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

        def row(self) -> tuple:
            return self.id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: One | None = None
        for b in text_batches(batches):
            out = []
            for conv_id, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.id != conv_id:
                    if now:
                        out.append(now.row())
                    now = One(conv_id)
                for role, content in parse(text):
                    now.n += 1
                    now.turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                now.chars += len(text)
                if start < end:
                    masked = unescape(text[start:end])
                    now.loss += len(masked)
                    now.masked.update(masked.encode("utf-8", "surrogatepass"))
            if out:
                yield rows(out)
        if now:
            yield rows([now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, ddl)
