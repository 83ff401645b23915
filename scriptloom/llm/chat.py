"""Chat formatting: logs of streamed deltas, edits and regenerations folded into messages, then rendered.

An event is a row (conv_id, turn, alt, seq, kind, role, payload). ``turn`` and ``alt`` address a message in its
conversation, ``seq`` (any orderable type) orders the log. Kinds: "open" begins a message, "delta" adds to its text,
"edit" replaces its text, "regenerate" replaces its text and drops what later messages had logged before.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python

#: The template: marker, role, end of role, text, end of turn.
TURN, ROLE_END, TURN_END = "### ", "</role>\n", "</turn>\n"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def fold_messages(events: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, alt, role, text), in each partition ordered by message, each conversation in one partition.

    Messages are first put together by their own key, so a long conversation is spread over tasks until it is
    rendered. A message with no event left after a regeneration is gone.
    """
    per_message = events.groupBy("conv_id", "turn", "alt").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload")))).alias("log"),
        F.max("role").alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "alt").rowsBetween(Window.unboundedPreceding, 0)
    live = F.filter("log", lambda e: F.col("since").isNull() | (e["seq"] >= F.col("since")))
    reset = F.array_max(F.transform("live", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1)))
    return (
        per_message.withColumn("since", F.max("redone").over(before))
        .withColumn("live", live)
        .filter(F.size("live") > 0)
        .withColumn("first", F.coalesce(reset, F.lit(1)))
        .select(
            "conv_id", "turn", "alt", F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice("live", F.col("first"), F.size("live")), lambda e: e["payload"]), "").alias("text"),
        )
    )


def escape(text: str) -> str:
    """The result holds neither "</" nor a "#" without a backslash before it, hence no control string."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(messages: DataFrame, part_chars: int = 65_536, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, part, formatted, loss): a conversation's parts joined are its formatted text, ``loss`` has the
    (start, end) of the text that counts for the loss in its part. A part ends after the turn that fills it."""
    ready_python(messages.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def flush(rows):
        ids, parts, texts, spans = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)], names=["conv_id", "part", "formatted", "loss"])

    def run(batches):
        conv, part, begun = None, 0, False
        pieces: list[str] = []
        spans: list[dict] = []
        size, rows = 0, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and (c != conv or size >= part_chars):
                    rows.append((conv, part, "".join(pieces), spans))
                    part, pieces, spans, size = (part + 1 if c == conv else 0), [], [], 0
                    if len(rows) >= 256:
                        yield flush(rows)
                        rows = []
                conv, begun = c, True
                head, body = TURN + escape(role) + ROLE_END, escape(text)
                if role == loss_role:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                pieces += (head, body, TURN_END)
                size += len(head) + len(body) + len(TURN_END)
        if begun:
            rows.append((conv, part, "".join(pieces), spans))
        if rows:
            yield flush(rows)

    return messages.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>")


def read_turns(formatted: str):
    """(role, text) of each turn of a part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError("a turn must begin with its marker")
        role_end = formatted.index(ROLE_END, at)
        end = formatted.index(TURN_END, role_end)
        yield unescape(formatted[at + len(TURN) : role_end]), unescape(formatted[role_end + len(ROLE_END) : end])
        at = end + len(TURN_END)


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its parts in order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Holds one part at a time."""

    def run(batches):
        conv, begun = None, False
        rows: list[tuple] = []
        turns = chars = loss_chars = 0
        said, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for c, formatted, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if begun and c != conv:
                    rows.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns = chars = loss_chars = 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                conv, begun = c, True
                chars += len(formatted)
                for role, text in read_turns(formatted):
                    turns += 1
                    said.update(f"{role}\n{text}\n".encode())
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
            if len(rows) >= 1024:
                yield out(rows)
                rows = []
        if begun:
            rows.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield out(rows)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = ["long", "long", "string", "long", "string", "long"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def chat_digest(events: DataFrame) -> DataFrame:
    """Folds, renders and reads back a log. A null conv_id is a conversation of its own, a null role or payload is
    empty, null turns come first; events equal in seq are taken in order of kind and payload; a repeated event counts
    twice. An empty log gives no rows; further columns are ignored."""
    return digest(render(fold_messages(events)))
