"""Replaying edit events into files: an ordered fold per (video_id, file)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import occurrences, snippet, trim_newlines

#: Leading lines that belong to a file's header; blank lines do too.
HEADER = r"^[ \t\r]*(//|/\*|#property|#include|#pragma)"
STATE = "struct<exists: boolean, content: string, records: array<struct<chunk_id: string, seq: int, op: string, status: string, detail: string>>>"


def _ended(text: Column) -> Column:
    return F.concat(trim_newlines(text), F.lit("\n"))


def _with_break(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def header_insert(content: Column, line: Column) -> Column:
    """``line`` after the leading run of header and blank lines."""
    parts = F.split(content, "(?<=\n)")
    body = F.array_min(F.transform(parts, lambda p, i: F.when((F.trim(F.regexp_replace(p, r"\s", "")) != "") & ~p.rlike(HEADER), i)))
    cut = F.coalesce(body, F.size(parts))
    head = F.array_join(F.slice(parts, F.lit(1), cut), "")
    return F.concat(_with_break(head), line, F.lit("\n"), F.array_join(F.slice(parts, cut + 1, F.size(parts)), ""))


def _step(state: Column, e: Column) -> Column:
    content, exists, op = state["content"], state["exists"], e["op"]
    code, anchor = F.coalesce(e["code"], F.lit("")), F.coalesce(e["anchor"], F.lit(""))
    line = F.rtrim(code, F.lit("\n"))
    n = occurrences(content, anchor)
    quoted = F.concat(F.lit(': "'), snippet(anchor, 64), F.lit('"'))
    error = (
        F.when((op == "create") & exists, F.concat(F.lit("create: "), e["file"], F.lit(" already exists")))
        .when((op == "replace") & ~exists, F.concat(F.lit("replace: "), e["file"], F.lit(" does not exist")))
        .when((op == "replace") & (n == 0), F.concat(F.lit("replace: anchor not found in "), e["file"], quoted))
        .when((op == "replace") & (n > 1), F.concat(F.lit("replace: anchor occurs "), n.cast("string"), F.lit(" times in "), e["file"], quoted))
        .when(~op.isin("create", "append", "replace", "property", "include"), F.concat(F.lit('unknown op "'), op, F.lit('"')))
    )
    present = F.contains(content, F.concat(line, F.lit("\n"))) | (content.endswith(line) & ~F.contains(line, F.lit("\n")))
    after = (
        F.when(error.isNotNull(), content)
        .when(op == "create", _ended(code))
        .when(op == "append", F.concat(_with_break(content), _ended(code)))
        .when(op == "replace", F.replace(content, anchor, code))
        .when(present, content)
        .otherwise(header_insert(content, line))
    )
    record = F.struct(e["chunk_id"].alias("chunk_id"), e["seq"].alias("seq"), op.alias("op"), F.when(error.isNull(), "applied").otherwise("skipped").alias("status"), F.coalesce(error, F.lit("")).alias("detail"))
    return F.struct((exists | (error.isNull() & (op != "replace"))).alias("exists"), after.alias("content"), F.concat(state["records"], F.array(record)).alias("records")).cast(STATE)


def replay(events: DataFrame) -> DataFrame:
    """(video_id, file, exists, content, records): files touch nothing but themselves, so each is folded apart, in the
    order of (chunk_id, seq, ord)."""
    row = F.struct("chunk_id", "seq", "ord", "op", "file", "anchor", "code")
    per_file = events.groupBy("video_id", "file").agg(F.array_sort(F.collect_list(row)).alias("events"))
    empty = F.struct(F.lit(False).alias("exists"), F.lit("").alias("content"), F.array().alias("records")).cast(STATE)
    return per_file.select("video_id", "file", F.aggregate("events", empty, _step).alias("s")).select("video_id", "file", "s.*")


def _head_of(content: str) -> int:
    """Where the leading run of header and blank lines ends."""
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", content):
        if re.sub(r"[ \t\n\x0b\f\r]", "", line) and not re.match(HEADER, line):
            break
        at += len(line)
    return at


def fold_file(events: list[dict]) -> tuple[bool, str, list[tuple]]:
    """(exists, content, records) of one file's ordered events; a step costs the length of the file, whatever its history."""
    exists, content, records = False, "", []
    for e in events:
        op, file, code, anchor = e["op"], e["file"], e["code"] or "", e["anchor"] or ""
        broken = content + "\n" if content and not content.endswith("\n") else content
        n, error = content.count(anchor) if anchor else 0, ""
        shown = anchor if len(anchor) <= 64 else f"{anchor[:64]}..."
        if op == "create" and exists:
            error = f"create: {file} already exists"
        elif op == "create":
            content = code.strip("\n") + "\n"
        elif op == "append":
            content = broken + code.strip("\n") + "\n"
        elif op == "replace" and not exists:
            error = f"replace: {file} does not exist"
        elif op == "replace" and n != 1:
            error = f'replace: anchor not found in {file}: "{shown}"' if not n else f'replace: anchor occurs {n} times in {file}: "{shown}"'
        elif op == "replace":
            content = content.replace(anchor, code)
        elif op in ("property", "include"):
            line = code.rstrip("\n")
            if f"{line}\n" not in content and not ("\n" not in line and content.endswith(line)):
                at = _head_of(content)
                head = content[:at]
                content = (head + "\n" if head and not head.endswith("\n") else head) + line + "\n" + content[at:]
        else:
            error = f'unknown op "{op}"'
        exists = exists or (not error and op != "replace")
        records.append((e["chunk_id"], int(e["seq"]), op, "skipped" if error else "applied", error))
    return exists, content, records


def replay_long(events: DataFrame) -> DataFrame:
    """As ``replay``, for files with long histories: the fold over expressions copies the content and the records at each
    event, this one runs over a file's events in a Python worker."""
    kind = "video_id string, file string, exists boolean, content string, records array<struct<chunk_id: string, seq: int, op: string, status: string, detail: string>>"

    def run(frame):
        import pandas as pd

        ordered = frame.sort_values(["chunk_id", "seq", "ord"], kind="stable")
        rows = ordered.astype(object).where(ordered.notna(), None).to_dict("records")
        exists, content, records = fold_file(rows)
        names = ("chunk_id", "seq", "op", "status", "detail")
        return pd.DataFrame([(rows[0]["video_id"], rows[0]["file"], exists, content, [dict(zip(names, r, strict=True)) for r in records])], columns=["video_id", "file", "exists", "content", "records"])

    wanted = events.select("video_id", "file", "chunk_id", "seq", "ord", "op", "anchor", "code")
    return wanted.groupBy("video_id", "file").applyInPandas(run, kind)


def replay_report(replayed: DataFrame) -> DataFrame:
    return replayed.select("video_id", "file", F.explode("records").alias("r")).select("video_id", "file", "r.*")
