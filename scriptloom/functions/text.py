"""Scalar expressions over strings: white space, sizes, prefixes, identifiers and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The openings that begin a new chunk by default.
CUES = [
    "let's add",
    "let's write",
    "let's create",
    "let's type",
    "next line",
    "so now we",
    "type this",
    "we're going to add",
    "now we add",
]
# Characters ignored before a cue.
CUE_LEAD = r"^[\"'\-—(\[ ]+"
# The hosts of watch pages and the path prefixes that carry an id.
WATCH_HOSTS = ["youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com"]
SHORT_HOST = "youtu.be"
ID_PATHS = ["shorts", "embed", "live", "v"]


def strip_space(text: Column) -> Column:
    """Without the white space, as Unicode has it, at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


def starts_with_cue(text: Column, cues: list[str]) -> Column:
    """Whether the text, lower-cased and without leading quotes and dashes, begins with a cue (no word boundary)."""
    wanted = [c.strip().lower() for c in cues if c.strip()]
    head = F.regexp_replace(strip_space(F.lower(text)), CUE_LEAD, "")
    return F.exists(F.array(*map(F.lit, wanted)), lambda c: F.startswith(head, c)) if wanted else F.lit(False)


def ends_sentence(text: Column) -> Column:
    return F.rtrim(strip_space(text), F.lit("\"'’)] ")).rlike(r"[.!?]\z")


def run_id_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def video_id(url: Column) -> Column:
    """The 11-character id of a bare id, a watch page, a short link or a shorts, embed, live or v path; else null."""
    text = strip_space(url)
    valid = lambda c: F.when(c.rlike(r"\A[A-Za-z0-9_-]{11}\z"), c)
    host = F.regexp_replace(F.lower(F.try_parse_url(text, F.lit("HOST"))), r"^www\.", "")
    path = F.filter(F.split(F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    query = F.try_url_decode(F.try_parse_url(text, F.lit("QUERY"), F.lit("v")))
    by_path = F.when((F.size(path) == 2) & F.get(path, F.lit(0)).isin(*ID_PATHS), valid(F.get(path, F.lit(1))))
    return F.coalesce(
        valid(text),
        F.when(host == SHORT_HOST, valid(F.get(path, F.lit(0)))),
        F.when(host.isin(*WATCH_HOSTS), F.when(F.coalesce(query, F.lit("")) != "", valid(query)).otherwise(by_path)),
    )


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def snippet(text: Column, size: int) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal part; 0 for an empty part."""
    return F.when(F.length(part) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("int"))


def trim_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))
