"""Chat formatting: conversations rebuilt from event logs, then rendered with a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events. open: a message starts; delta: text is added; edit: the text is replaced;
#: regenerate: the message and all after it are taken back and it starts anew.
EVENTS = ("open", "delta", "edit", "regenerate")

START, END = "<|im_start|>", "<|im_end|>"
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A text without `<|`: backslashes are doubled and a `<|` gets one between its characters."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted text, and where in it (code points) the loss counts: an assistant's text."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    at = len(head) if role == "assistant" else 0
    return f"{head}{body}{END}\n", at, at + len(body) if role == "assistant" else 0


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn. Roles' own newlines follow a backslash."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    at = len(START)
    while formatted[at] != "\n":
        at += 2 if formatted[at] == "\\" else 1
    return unescape(formatted[len(START) : at]), unescape(formatted[at + 1 : -len(END) - 1])


TURNS = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, message, formatted, loss_start, loss_end: a row per final message, rows of a conversation together and in order.

    events(conv_id, seq, event, message, role, text), see EVENTS. A conversation's formatted
    text is its rows' formatted columns one after another; the loss span is in code points
    of the row's own text and empty but for assistants.

    Logs are partitioned by conversation. A running minimum from the end finds the events
    that a later regeneration takes back; the rest are folded in order of message and
    sequence. A task holds one message at a time, never a conversation, so one of any length
    needs no more memory. Null roles and texts are empty; unknown kinds of events are
    ignored; equal sequence numbers go by kind and text; no events give no rows.
    """
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event"))
    valid = (
        events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "event", F.col("message").cast("long"), "role", "text")
        .where(F.col("event").isin(*EVENTS))
        .withColumn("rank", rank)
        .withColumn("cut", F.min(F.when(F.col("event") == "regenerate", F.col("message"))).over(later))
        .where(F.col("cut").isNull() | (F.col("message") < F.col("cut")))
        .sortWithinPartitions("conv_id", "message", "seq", "rank", "text")
        .select("conv_id", "message", "event", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, parts, out, size = None, "", [], [], 0

        def done() -> None:
            nonlocal size
            out.append((*now, *render(role, "".join(parts))))
            size += len(out[-1][2])

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), TURNS, strict=True)], schema=TURNS)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for conv, message, event, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv, message):
                    if now is not None:
                        done()
                        if size > 4_000_000:
                            yield flush()
                    now, role, parts = (conv, message), "", []
                if event in ("edit", "regenerate"):
                    parts = []
                role = who if who is not None else role
                parts.append(text or "")
        if now is not None:
            done()
        if out:
            yield flush()

    return valid.mapInArrow(run, "conv_id long, message long, formatted string, loss_start long, loss_end long")


def read_back(turns: DataFrame) -> DataFrame:
    """A row per conversation with digests of what its formatted text says, as format_conversations() orders it.

    n_turns; turns_sha256 over role, newline, text, newline per turn; loss_chars and
    loss_sha256 of the unescaped text under the loss spans; formatted_chars.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []

        def done() -> None:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for one, _, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or one != conv:
                    if state is not None:
                        done()
                    conv, state = one, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                loss = unescape(formatted[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if state is not None:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Code points of text that an event of as_events() carries, and those that are taken back.
DELTA_CHARS, DRAFT_CHARS = 1024, 16


def as_events(rows: DataFrame, *, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log that could have led to finished conversations(conv_id, turn, role, text).

    Each row opens a message with the text's beginning. An assistant's is then regenerated (with
    its role, as its opening is taken back too), any other's replaced by an edit, and the text
    streamed in deltas of at most ``delta_chars`` code points. Nothing follows an empty text's opening but
    the regeneration or edit.

    Rows go by turn, nulls first; rows of one turn are messages of their own, by role and text.
    Null roles and texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def event(kind: Column, role: Column, text: Column) -> Column:
        return F.struct(kind.alias("event"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    none, deltas = F.lit(None), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    again = F.when(F.col("role") == "assistant", F.lit("regenerate")).otherwise(F.lit("edit"))
    who = F.coalesce("role", F.lit(""))
    steps = F.concat(
        F.array(event(F.lit("open"), who, none)),
        F.transform(F.slice("deltas", 1, 1), lambda d: event(F.lit("delta"), none, F.substring(d, 1, DRAFT_CHARS))),
        F.array(event(again, who, none)),
        F.transform("deltas", lambda d: event(F.lit("delta"), none, d)),
    )
    return (
        rows.select("conv_id", "turn", "role", "text")
        .withColumn("message", F.row_number().over(order).cast("long"))
        .withColumn("deltas", F.coalesce(deltas, F.array().cast("array<string>")))
        .select("conv_id", "message", F.posexplode(steps).alias("step", "e"))
        .select("conv_id", (F.col("message") * (1 << 32) + F.col("step")).alias("seq"), "e.event", "message", "e.role", "e.text")
    )
