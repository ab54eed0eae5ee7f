"""Chat formatting: conversations rebuilt from event logs, rendered, masked and read back.

An event is (conv_id, seq, part, kind, message_id, role, text); ``part`` orders events of one sequence number and may be left out. Kinds: ``message`` (a whole message), ``delta``
(text appended to a message, streamed), ``edit`` (replaces a message's text; an edit of a user message
drops what came after it), ``regenerate`` (empties an assistant message, whose later deltas refill it).
Events are partitioned by conversation and sorted by sequence (part, kind, message, role, text break
ties), then folded in one pass over the sorted partition: a worker holds one conversation at a
time, never a partition or a group of conversations. A conversation is one value of the result, so its
messages have to fit into one (2 GB), however many events made them: those of all kinds are read as a stream.

Rendering: ``<turn role="R">`` newline, the text, newline ``</turn>`` newline. A text's own ``<turn`` or ``</turn``,
with any backslashes before it, gets one backslash more, which reading takes away again; since a marker of
the template always follows a newline or the start, the two can't be confused. Roles are written
as JSON strings. The loss mask lists the code-point spans of the assistants' (escaped) texts.

Defined results: a null text is empty; a null role is the empty role; rows with a null conversation id
form one conversation with that id; a null sequence number sorts first; an event of an unknown kind, as any row of a log may be, is
passed by; an event without a message id is a whole message, whatever its kind; repeated rows are repeated events
(for ``message`` events: repeated turns); a conversation without messages renders as the empty string;
an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table

EVENTS = "conv_id long, seq long, part int, kind string, message_id string, role string, text string"
FORMATTED = "conv_id long, formatted string, mask array<struct<start:int,end:int>>"
# The control conversation of the query's contract.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"

_CONTROL = re.compile(r"(\\*)(</?turn)")
_ESCAPED = re.compile(r"\\(\\*)(</?turn)")
_HEAD = re.compile(r'<turn role=("(?:[^"\\]|\\.)*")>\n')
_TAIL = "\n</turn>\n"
ROWS = 2000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str) -> str:
    return json.dumps(role, ensure_ascii=False).replace("<", "\\u003c")


KINDS = ("message", "delta", "edit", "regenerate")


class Conversation:
    """Fold of one conversation's events into its messages."""

    def __init__(self) -> None:
        self.order: list[str] = []
        self.place: dict[str, int] = {}
        self.role: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {}
        self.serial = 0

    def add(self, kind: str | None, message_id: str | None, role: str | None, text: str | None) -> None:
        text = text or ""
        if kind is not None and kind not in KINDS:
            return
        if kind in (None, "message") or message_id is None:
            key = f"\0{self.serial}" if message_id is None or message_id in self.parts else message_id
            self.serial += 1
            self._put(key, role, [text])
        elif message_id not in self.parts:
            self._put(message_id, role, [text] if text or kind != "regenerate" else [])
        elif kind == "delta":
            self.parts[message_id].append(text)
        elif kind == "regenerate":
            self.parts[message_id] = [text] if text else []
        else:
            self.parts[message_id] = [text]
            if self.role[message_id] == "user":
                after = self.place[message_id] + 1
                for later in self.order[after:]:
                    del self.parts[later], self.role[later], self.place[later]
                del self.order[after:]

    def _put(self, key: str, role: str | None, parts: list[str]) -> None:
        self.place[key] = len(self.order)
        self.order.append(key)
        self.role[key] = role or ""
        self.parts[key] = parts

    def messages(self) -> list[tuple[str, str]]:
        return [(self.role[k], "".join(self.parts[k])) for k in self.order]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans under the loss mask."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn role={_role(role)}>\n", escape(text)
        out += [head, body, _TAIL]
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(_TAIL)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, from the formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(_TAIL, m.end())
        out.append((json.loads(m.group(1)), unescape(formatted[m.end() : end]), m.end(), end))
        at = end + len(_TAIL)
    return out


def format_events(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, key, begun, held = Conversation(), None, False, 0

        def batch() -> pa.RecordBatch:
            ids, texts, masks = zip(*rows, strict=True)
            mask = pa.array([[{"start": a, "end": b} for a, b in m] for m in masks], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), mask], ["conv_id", "formatted", "mask"])

        for b in batches:
            for conv, kind, mid, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "message_id", "role", "text")), strict=True):
                if begun and conv != key:
                    rows.append((key, *render(now.messages())))
                    held += len(rows[-1][1])
                    now = Conversation()
                    if len(rows) >= ROWS or held > 8_000_000:
                        yield batch()
                        rows, held = [], 0
                begun, key = True, conv
                now.add(kind, mid, role, text)
        if begun:
            rows.append((key, *render(now.messages())))
            yield batch()

    order = ["conv_id", "seq", "part", "kind", "message_id", "role", "text"]
    if "part" not in events.columns:
        events = events.withColumn("part", F.lit(0))
    return events.select(*order).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fold, FORMATTED)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read from them and the mask alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column("formatted").to_pylist(), b.column("mask").to_pylist(), strict=True):
                digest, loss, chars, turns = hashlib.sha256(), hashlib.sha256(), 0, parse(text)
                for role, body, _, _ in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                for m in mask:
                    said = unescape(text[m["start"] : m["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                rows.append((len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(text)))
            n, d, c, s, f = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(c, pa.int64()), pa.array(s, pa.string()), pa.array(f, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log that ends in the rows (conv_id, turn, role, text): what a chat that was streamed and corrected leaves.

    A user's message is a draft, then edited to the text. Any other's is a draft, then regenerated and streamed in two
    deltas. An edit drops what came after it, so that of rows of one turn the later ones are made again by their
    own events. Message ids tell rows apart; rows of one turn come in the order of role and digest of the text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    mid = F.concat_ws(":", role, F.left(F.sha2(text.cast("binary"), 256), F.lit(16)), F.monotonically_increasing_id().cast("string"))

    def event(part: int, kind: str, said) -> object:
        return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), said.alias("text"))

    draft = event(0, "message", F.concat(F.lit("draft "), F.left(text, F.lit(8))))
    edited = F.array(draft, event(1, "edit", text))
    streamed = F.array(draft, event(2, "regenerate", F.lit("")), event(3, "delta", F.left(text, half)), event(4, "delta", F.substring(text, half + 1, F.length(text))))
    log = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), mid.alias("message_id"), role.alias("role"), F.when(role == "user", edited).otherwise(streamed).alias("events"))
    return log.select("conv_id", "seq", "message_id", "role", F.explode("events").alias("e")).select("conv_id", "seq", "e.part", "e.kind", "message_id", "role", "e.text")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL_ID, k, r, CONTROL_TEXT) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    every = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(control)
    return read_formatted(kept_table(format_events(turns_as_events(every)), "chat"))
