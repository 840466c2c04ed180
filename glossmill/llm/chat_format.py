"""Operator 5, chat formatting by event-sourced reconstruction.

A log of events (conversation, sequence, kind, message, role, text) is folded into final messages, which are rendered:

* ``message``: a new message, or the whole of a message that exists, under a message id; without an id always a new one;
* ``delta``: text appended to the message (begun by its first delta);
* ``edit``: the message's text is replaced;
* ``regenerate``: the message's text is thrown away, further deltas begin anew;
* ``delete``: the message goes.

A message's events concern no other message. So the log is first partitioned by conversation and message and sorted by
sequence, and every message is folded by itself; the events of a conversation, however many, spread over tasks. Final
messages are then partitioned by conversation, sorted by the sequence number that began them, and rendered as they stream by.
Only the rendering of one conversation is one task's work, because it is one value; nothing but that value is held.

Template: each message is ``<turn>role\\n`` text ``</turn>\\n``. In roles and texts a backslash becomes ``\\\\\\\\``, ``<`` becomes
``\\\\l`` and, in roles only, a newline ``\\\\n``, so that no text can hold a control string and `parse` gives everything back.
The loss mask is a list of code point ranges of the formatted string: the text of each assistant message.

Defined results: null texts and roles count as empty; events without a conversation id form one conversation of their own;
events of a message with equal sequence numbers are ordered by kind (as listed above), role and text, messages that begin at
one sequence number by role and text; repeated rows are repeated events; events of unknown kind raise; edits, regenerations
and deletions of no message do nothing; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import tidy

KINDS = ("message", "delta", "edit", "regenerate", "delete")
_TURN = re.compile(r"<turn>([^<\n]*)\n([^<]*)</turn>\n")
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: {"l": "<", "n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


def fold(events: Iterable[tuple[object, str, str | None, str | None]]) -> tuple[object, str, str] | None:
    """One message, from its ordered (seq, kind, role, text) events: the seq that began it, role, text; None if it is gone."""
    message: list | None = None
    for seq, kind, role, text in events:
        if kind == "delete":
            message = None
            continue
        if message is None:
            if kind in ("edit", "regenerate"):
                continue  # nothing to change
            message = [seq, "", []]
        if role is not None:
            message[1] = role
        if kind == "delta":
            message[2].append(text or "")
        else:
            message[2] = [] if kind == "regenerate" else [text or ""]
    return None if message is None else (message[0], message[1], "".join(message[2]))


def render(messages: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """The formatted conversation, the ranges of it under the loss mask, and its number of messages."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn>{escape(role)}\n".replace("\n", "\\n", role.count("\n")), escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans, len(parts) // 3


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation; the inverse of `render`."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return found


def _runs(batches, n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first columns, from sorted batches: the key, and the rest of each row as it streams by."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    return ((key, (row[n_keys:] for row in run)) for key, run in itertools.groupby(rows, lambda row: row[:n_keys]))


def final_messages(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, message, role, text) -> conv_id, seq, role, text of every final message."""
    conv_type = events.schema["conv_id"].dataType
    seq_type = events.schema["seq"].dataType
    names = ["conv_id", "seq", "role", "text"]
    out = pa.schema(list(zip(names, (to_arrow_type(conv_type), to_arrow_type(seq_type), pa.string(), pa.string()), strict=True)))
    schema = f"conv_id {conv_type.simpleString()}, seq {seq_type.simpleString()}, role string, text string"
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    alone = events.filter(F.col("message").isNull() & F.col("kind").isin("message", "delta"))
    alone = alone.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # All of unknown kind go this way, so that one stage raises: of two that fail at once Spark tells neither's message.
    unknown = F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))
    named = events.filter(F.col("message").isNotNull() | ~known).withColumn("kind", F.when(known, F.col("kind")).otherwise(unknown))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    named = named.select("conv_id", "message", "seq", "kind", "role", "text").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", rank, "role", "text")

    def run(batches):
        rows, size = [], 0
        for (conv, _), held in _runs(batches, 2):
            message = fold(held)
            if message is not None:
                rows.append((conv, *message))
                size += len(message[2])
            if size > 1_000_000 or len(rows) > 10_000:
                yield _batch(rows, out)
                rows, size = [], 0
        if rows:
            yield _batch(rows, out)

    return alone.unionByName(named.mapInArrow(tidy(run), schema))


def format_log(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, message, role, text) -> conv_id, n_turns, formatted, loss_spans, one row per conversation."""
    conv_type = events.schema["conv_id"].dataType
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("conv_id", to_arrow_type(conv_type)), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", span)])
    ordered = final_messages(events).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        rows, size = [], 0
        for (conv,), messages in _runs(batches, 1):
            text, spans, turns = render(messages)
            rows.append((conv, turns, text, [{"begin": a, "end": b} for a, b in spans]))
            size += len(text)
            if size > 1_000_000:
                yield _batch(rows, out)
                rows, size = [], 0
        if rows:
            yield _batch(rows, out)

    return ordered.mapInArrow(tidy(run), f"conv_id {conv_type.simpleString()}, n_turns bigint, formatted string, loss_spans array<struct<begin:bigint,end:bigint>>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                all_of, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    all_of.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["begin"] : span["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                rows.append((len(turns), all_of.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", *names])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def messages_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of message events."""
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text"
    )


def streamed_log(conversations: DataFrame, deltas: int = 12) -> DataFrame:
    """A table of finished turns as the log that a chat server would have written of them.

    By a hash of the turn, its message arrived whole; or in up to `deltas` streamed deltas; or as a draft that was edited,
    beside a message that was deleted; or as a draft that was regenerated and then streamed. Repeated rows are messages each.
    """
    once = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    once = once.withColumn("h", F.xxhash64("conv_id", "turn", "role", "text")).select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    name = F.concat_ws("-", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.hex("h"), "copy")
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    size = F.greatest(F.ceil(F.char_length(text) / deltas), F.lit(1)).cast("int")
    draft = F.concat(F.lit("draft: "), F.reverse(text))

    def event(nth: Column | int, kind: str, said: Column, who: Column = role, other: str = "") -> Column:
        none = F.lit(None).cast("string")
        return F.struct((F.lit(nth) if isinstance(nth, int) else nth).cast("bigint").alias("nth"), F.lit(kind).alias("kind"), F.concat(name, F.lit(other)).alias("message"), F.coalesce(who, none).alias("who"), F.coalesce(said, none).alias("said"))

    none = F.lit(None).cast("string")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / size).cast("int") - 1, F.lit(0)))
    stream = lambda first: F.transform(pieces, lambda k: event(k + first, "delta", F.substring(text, k * size + 1, size), F.when(k == 0, role)))
    kind = F.pmod("h", F.lit(4))
    events = (
        F.when(kind == 0, F.array(event(0, "message", text)))
        .when(kind == 1, stream(0))
        .when(kind == 2, F.array(event(0, "message", draft), event(1, "message", draft, other="x"), event(2, "edit", text, none), event(3, "delete", none, none, other="x")))
        .otherwise(F.concat(F.array(event(0, "delta", draft), event(1, "regenerate", none, none)), stream(2)))
    )
    log = once.select("conv_id", "turn", F.explode(events).alias("e"))
    return log.select("conv_id", (F.col("turn").cast("bigint") * 1024 + F.col("e.nth")).alias("seq"), "e.kind", "e.message", F.col("e.who").alias("role"), F.col("e.said").alias("text"))
