"""Chat formatting: typed content parts become ordered placeholders; turns are marked, and marks inside texts escaped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: <|turn|>role NEWLINE content <|end|> NEWLINE.  In roles and contents `\` is written `\\`, and `<|` is `<\|`; a role's line ends have a `\` before them.
TURN, MIDDLE, END = "<|turn|>", "\n", "<|end|>\n"
#: Tokens that a part stands for, for each unit of its size (image: a tile; audio: a second; document: a page).
TOKENS_PER_UNIT = {"image": 576, "audio": 25, "document": 700}
PART = "struct<type:string,text:string,ref:string,units:double>"


ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.S)


def escape(text: str) -> str:
    """Reversible: no `<|` is left, so no control string can stand inside a text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out += [text[at:i], text[i + 1 : i + 2]]
        at = i + 2
    return "".join([*out, text[at:]])


def bytes_by_four(text: str) -> int:
    """A token for each four bytes or part of them."""
    return ceil(len(text.encode()) / 4)


def library_counter(path: str):
    """Tokens of a text by the tokenizer file at the path, without added special tokens."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()
    return lambda text: len(known.encode(text, add_special_tokens=False).ids)


class Flattener:
    """Visits the parts of one message in order and records what stands for them."""

    def __init__(self, count) -> None:
        self.content: list[str] = []
        self.attachments: list[dict] = []
        self.tokens, self.count = 0, count

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("type") or "text"
        if kind == "text":
            self.visit_text(part)
        elif kind in TOKENS_PER_UNIT:
            self.visit_attachment(part, kind)
        else:
            self.visit_other(part, kind)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.content.append(escape(text))
        self.tokens += self.count(text)

    def visit_attachment(self, part: dict, kind: str) -> None:
        units = part.get("units")
        units = units if units is not None and isfinite(units) and units > 0 else 1
        self._place(part, kind, kind, ceil(units * TOKENS_PER_UNIT[kind]))

    def visit_other(self, part: dict, kind: str) -> None:
        self._place(part, kind, "other", 0)

    def _place(self, part: dict, kind: str, mark: str, cost: int) -> None:
        self.content.append(f"<|{mark}:{len(self.attachments)}|>")
        self.attachments.append({"position": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": cost})
        self.tokens += cost


def flatten(parts: list[dict | None] | None, count=bytes_by_four) -> tuple[str, list[dict], int]:
    """(escaped content with placeholders in order, attachments, expanded tokens) of a message's parts.

    Texts cost what `count` says; an attachment the tokens of its units (one unit if there is no positive, finite number).
    A part of any other type is kept as an attachment of that type, stands as `<|other:n|>` and costs nothing.
    """
    f = Flattener(count)
    for part in parts or []:
        f.visit(part)
    return "".join(f.content), f.attachments, f.tokens


TURNS = "conv_id bigint, turn bigint, segment string, loss_start bigint, loss_end bigint, expanded_tokens bigint, attachments array<struct<position:int,type:string,ref:string,tokens:bigint>>"


def format_turns(messages: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per message: conv_id, turn, segment, loss_start, loss_end, expanded_tokens, attachments.

    messages: conv_id, turn, role and either text or parts (array of struct type, text, ref, units; types
    text, image, audio, document).  A conversation's output is its segments in order of turn, then role,
    then text.  [loss_start, loss_end) are code points of the segment under the loss mask: an assistant's
    content, nothing (0, 0) for others.  Null roles and texts are empty; see flatten for unknown types and units.
    Texts' tokens are counted with the tokenizer file at the given path, or taken as a quarter of their bytes.
    """
    parts = "parts" in messages.columns
    body = F.col("parts") if parts else F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))]
        count = library_counter(tokenizer) if tokenizer else bytes_by_four
        for batch in batches:
            rows = []
            for role, body in zip(batch.column("role").to_pylist(), batch.column("body").to_pylist(), strict=True):
                content, attachments, tokens = flatten(body, count)
                head = TURN + escape(role or "").replace("\n", "\\\n") + MIDDLE
                loss = (len(head), len(head) + len(content)) if role == "assistant" else (0, 0)
                rows.append((head + content + END, *loss, tokens, attachments))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "turn", "segment", "loss_start", "loss_end", "expanded_tokens", "attachments"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), body.cast(f"array<{PART}>").alias("body"))
    return rows.mapInArrow(run, TURNS)


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) from a segment of the output; attachments' placeholders stay in the text."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a turn")
    role = ROLE.match(segment, len(TURN))[0]
    return unescape(role), unescape(segment[len(TURN) + len(role) + len(MIDDLE) : -len(END)])


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, expanded_tokens bigint"


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, read from the output: its turns' and its loss text's digests and sizes.

    Segments are sorted by conversation and turn and read as a stream: a digest is a chain over a
    conversation's turns, so one task reads a conversation, of any length, holding one batch at a time.
    Segments of equal turn are read in their own order (role first, then text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, state) -> list:
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]]

        last, state, started = None, None, False
        for batch in batches:
            out = []
            for conv, segment, a, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "expanded_tokens")), strict=True):
                if not started or conv != last:
                    if started:
                        out.append(row(last, state))
                    last, state, started = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                role, text = read_turn(segment)
                loss = unescape(segment[a:b])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
                state[5] += tokens
            if out:
                yield _read_batch(out)
        if started:
            yield _read_batch([row(last, state)])

    rows = turns.select("conv_id", "turn", "segment", "loss_start", "loss_end", "expanded_tokens")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(run, READ)


def _read_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_conversations(messages: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """format_turns and read_back: one row per conversation (a null conv_id is one, too).  No rows give no rows; extra columns are ignored."""
    return read_back(format_turns(messages, tokenizer))
