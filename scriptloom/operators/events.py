"""Validating and anchoring edit events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A character other than white space, as Unicode has it.
SOLID = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# The kinds of edit.
OPS = ["create", "append", "replace", "property", "include"]


def first_error(chunk_id: Column, seq: Column, op: Column, file: Column, anchor: Column, code: Column) -> Column:
    """The first rule an event breaks, null for a valid event. Nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    file = text(file)
    return (
        F.when(text(chunk_id) == "", "chunk_id")
        .when(F.coalesce(seq, F.lit(0)) < 1, "seq")
        .when(~text(op).isin(*OPS), "op")
        .when(file == "", "file")
        .when(file.rlike(r"[/\\]") | file.startswith("."), "bare name")
        .when(~file.endswith(".mq5"), "extension")
        .when((op == "replace") & ~text(anchor).rlike(r"(?U)\S"), "anchor")
        .when((op != "replace") & (text(code) == ""), "code")
    )


def violation(chunk_id: str, event: object) -> str | None:
    """The first rule that an event of a parsed reply breaks once ``reanchor`` has set its id and seq, null for a valid
    event: a field of another type, then the rules of ``first_error``. An anchor of any white space is blank."""
    event = {} if event is None else event
    if not isinstance(event, dict):
        return "not an object"
    chars = {name: event.get(name) for name in ("chunk_id", "op", "file", "anchor", "code")}
    for name, value in chars.items():
        if value is not None and not isinstance(value, str):
            return f"type of {name}"
    seq = event.get("seq")
    if seq is not None and (type(seq) is not int or seq >= 1 << 31):
        return "type of seq"
    op, file, anchor, code = (chars[name] or "" for name in ("op", "file", "anchor", "code"))
    broken = {
        "chunk_id": not chunk_id, "op": op not in OPS, "file": not file, "bare name": "/" in file or "\\" in file or file.startswith("."),
        "extension": not file.endswith(".mq5"), "anchor": op == "replace" and not SOLID.search(anchor), "code": op != "replace" and not code,
    }
    return next((rule for rule, is_broken in broken.items() if is_broken), None)


def validate(events: DataFrame) -> DataFrame:
    return events.withColumn("reject", first_error(*(F.col(c) for c in ("chunk_id", "seq", "op", "file", "anchor", "code"))))


def reanchor(events: DataFrame) -> DataFrame:
    """Events (video_id, chunk_id, pos, seq, ...) of replies take their chunk's id and, where seq is below 1, their
    place in the list; one bad event rejects the chunk's whole list (chunk_ok false)."""
    seq = F.when(F.coalesce("seq", F.lit(0)) < 1, F.col("pos") + 1).otherwise(F.col("seq")).cast("int")
    checked = validate(events.withColumn("seq", seq))
    return checked.withColumn("chunk_ok", F.bool_and(F.col("reject").isNull()).over(Window.partitionBy("video_id", "chunk_id")))
