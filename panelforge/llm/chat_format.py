"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

A log holds events of conversations: (conv_id, seq, message, kind, role, text). Kinds: ``message`` starts
a message, ``delta`` appends streamed text to it, ``edit`` replaces its text, ``regenerate`` drops it and
every message that began after it. Events are partitioned by conversation and ordered by sequence; the
fold runs as window functions with running frames, so no conversation is ever gathered: only the pieces
of one message meet, as the text they make up.

Defined cases: null text is empty and a null role is the empty role; null conv_id is a conversation of
its own and null message a message; a null seq sorts first; events with equal seq are taken in the order
of kind (regenerate, message, others), kind, role, text, message; a delta or edit without a message starts
one; a regenerate of an unknown message does nothing; the same message id after a regenerate is a new
message; empty logs give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"
#: Texts between them can't hold "<|": each such mark gets a backslash, and marks that have some get one more.
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"[\\\n]")

RENDERED = "conv_id bigint, message_no bigint, formatted string, loss_begin bigint, loss_end bigint"


def escape(text: str) -> str:
    return _MARK.sub(lambda m: f"<\\{m[1]}|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(_ROLE.sub(lambda m: "\\\\" if m[0] == "\\" else "\\n", role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template and the place of its text in it (the loss mask of assistant turns)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages of an event log: (conv_id, message_no from 0, role, text)."""
    rank = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "message", 1).otherwise(2)
    in_order = Window.partitionBy("conv_id").orderBy("seq", "_rank", "kind", "role", "text", "message")
    events = log.select("conv_id", "seq", "message", "kind", "role", "text").withColumn("_rank", rank)
    events = events.withColumn("_pos", F.row_number().over(in_order)).drop("seq", "_rank")

    # generations: a regenerate closes the message's generation, later events open the next
    own = Window.partitionBy("conv_id", "message").orderBy("_pos")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    is_regen = F.col("kind") == "regenerate"
    opens = ~is_regen & F.coalesce(F.lag("kind").over(own) == "regenerate", F.lit(True))
    events = (
        events.withColumn("_gen", F.sum(is_regen.cast("int")).over(own))
        .withColumn("_open", F.when(opens, F.col("_pos")))
        .withColumn("_target", F.when(is_regen, F.last("_open", ignorenulls=True).over(earlier)))
    )
    # a message is dropped if a later regenerate goes back to it or before it
    back = Window.partitionBy("conv_id").orderBy(F.desc("_pos"))
    events = events.withColumn("_back_to", F.min("_target").over(back))
    parts = Window.partitionBy("conv_id", "message", "_gen")
    live = (
        events.where(~is_regen)
        .withColumn("_start", F.min("_pos").over(parts))
        .withColumn("_dropped", F.max(F.when(F.col("_open").isNotNull(), F.coalesce(F.col("_back_to") <= F.col("_open"), F.lit(False)))).over(parts))
        .withColumn("_base", F.max(F.when(F.col("kind") != "delta", F.col("_pos"))).over(parts))
        .where("not _dropped")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_pos") >= F.coalesce("_base", "_start"), F.struct("_pos", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"]), "")
    folded = live.groupBy("conv_id", "message", "_gen", "_start").agg(F.coalesce(F.min_by("role", "_pos"), F.lit("")).alias("role"), text.alias("text"))
    return folded.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("_start")) - 1).cast("bigint").alias("message_no"), "role", "text")


def from_turns(turns: DataFrame) -> DataFrame:
    """An event log whose final messages are the turns of a table (conv_id, turn, role, text), as an interface would log it.

    Each text is streamed in two deltas; every fifth message is first drafted and then edited, and every fourth one, if it
    is the assistant's, is first answered otherwise and regenerated. Turns with the same number are kept apart, in the order
    of role and text.
    """
    event = "struct<kind:string,role:string,text:string>"
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(at).cast("bigint").alias("message"))
    make = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text")).cast(event)
    none, role, text = F.lit(None), F.col("role"), F.col("text")
    half = F.expr("length(text) div 2")
    streamed = F.array(make("message", role, none), make("delta", none, F.substring("text", F.lit(1), half)), make("delta", none, F.substring("text", half + 1, F.length("text"))))
    edited = F.array(make("message", role, F.lit("A draft")), make("delta", none, F.lit(" of it")), make("edit", none, text))
    again = F.concat(F.array(make("message", role, F.lit("Another")), make("delta", none, F.lit(" answer")), make("regenerate", none, none)), streamed)
    events = F.when(F.col("message") % 5 == 3, edited).when((F.col("message") % 4 == 2) & (role == "assistant"), again).otherwise(streamed)
    log = rows.select("conv_id", "message", F.posexplode(events).alias("k", "e"))
    return log.select("conv_id", (F.col("message") * 8 + F.col("k")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def format_messages(messages: DataFrame) -> DataFrame:
    """Rendered turns of (conv_id, message_no, role, text) and, for assistant turns, their loss span."""

    def run(batch):
        roles, docs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        got = [render(r or "", t or "") for r, t in zip(roles, docs)]
        yield {
            "conv_id": batch.column(0),
            "message_no": batch.column(1),
            "formatted": [f for f, _, _ in got],
            "loss_begin": [a if r == "assistant" else None for r, (_, a, _) in zip(roles, got)],
            "loss_end": [b if r == "assistant" else None for r, (_, _, b) in zip(roles, got)],
        }

    return arrow_map(messages.select("conv_id", "message_no", "role", "text"), run, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the formatted text alone.

    Conversations are partitioned and sorted, then hashed as a stream: one turn is in memory at a time,
    however long a conversation is. A digest takes a conversation's turns in order, so one conversation is one
    task's work, here and in the windows of reconstruct; an endless one would take one task long, not much memory.
    """
    rows = rendered.select("conv_id", "message_no", "formatted", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "message_no")

    def fold(batches):
        cur, out = None, []
        for batch in batches:
            for cid, _, text, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if cur is None or cid != cur["conv_id"]:
                    if cur:
                        out.append(_done(cur))
                    cur = {"conv_id": cid, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
                for role, said in parse(text):
                    cur["n_turns"] += 1
                    cur["turns"].update(f"{role}\n{said}\n".encode())
                if begin is not None:
                    learnt = unescape(text[begin:end])
                    cur["loss_chars"] += len(learnt)
                    cur["loss"].update(learnt.encode())
                cur["formatted_chars"] += len(text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _DIGESTS)
                out = []
        out += [_done(cur)] if cur else []
        yield pa.RecordBatch.from_pylist(out, _DIGESTS)

    return rows.mapInArrow(fold, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _done(c: dict) -> dict:
    return {"conv_id": c["conv_id"], "n_turns": c["n_turns"], "turns_sha256": c["turns"].hexdigest(), "loss_chars": c["loss_chars"], "loss_sha256": c["loss"].hexdigest(), "formatted_chars": c["formatted_chars"]}
