"""Model-backed passes over chunks: triage, then extraction of edit events from the chunks that pass."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.events import OPS, violation
from scriptloom.operators.neighbours import shifted

# Fixed value: the length of a verdict.
TRIAGE_TOKENS = 64
# The shapes that replies are held to.
TRIAGE_SCHEMA = {
    "type": "object",
    "properties": {"chunk_id": {"type": "string"}, "has_code_action": {"type": "boolean"}, "confidence": {"type": "number"}},
    "required": ["chunk_id", "has_code_action", "confidence"],
}
EVENT_FIELDS = {"chunk_id": {"type": "string"}, "seq": {"type": "integer"}, "op": {"type": "string", "enum": OPS}, "file": {"type": "string"}, "anchor": {"type": "string"}, "code": {"type": "string"}}
EVENTS_SCHEMA = {
    "type": "object",
    "properties": {"events": {"type": "array", "items": {"type": "object", "properties": EVENT_FIELDS, "required": ["chunk_id", "seq", "op", "file", "code"]}}},
    "required": ["events"],
}
#: What the model is told once, before any chunk: the same for every call, so that a server can keep it.
TRIAGE_TASK = "You judge parts of a spoken programming tutorial. A part counts if somebody writes, dictates or changes code or a file in it; talk about code does not. Answer with one JSON object: chunk_id, has_code_action, confidence from 0 to 1."
EVENTS_TASK = "You turn parts of a spoken programming tutorial into edits of source files. An edit has chunk_id, seq from 1, op (create, append, replace, property or include), file (a bare name ending in .mq5), anchor (for replace: the exact text that gives way) and code, exactly as said. Invent nothing. Answer with one JSON object: events, a list of edits, empty where nothing is dictated."


class ModelClient(Protocol):
    """Answers a prompt; must be picklable and idempotent, as Spark may run a task again. ``task`` is what the model is to
    do, ``schema`` the JSON schema of its reply."""

    def chat(self, prompt: str, most_tokens: int, task: str = "", schema: dict | None = None) -> str: ...


@dataclass(frozen=True)
class ExtractConfig:
    model: str
    workers: int = 2
    retries: int = 2
    num_predict: int = 512

    def __post_init__(self):
        if not self.model or not 1 <= self.workers <= 8 or not 0 <= self.retries <= 5:
            raise ValueError("a model, 1 to 8 workers and 0 to 5 retries are needed")
        if self.num_predict < 0:
            raise ValueError("num_predict must not be negative")
        if not self.num_predict:
            object.__setattr__(self, "num_predict", 512)


def replay_client(replies: dict[str, list[str]]) -> ModelClient:
    """A client for tests: recorded replies by a part of the prompt, the last one again and again."""

    class Recorded:
        def chat(self, prompt: str, most_tokens: int, task: str = "", schema: dict | None = None) -> str:
            for part, found in replies.items():
                if part in prompt:
                    return found.pop(0) if len(found) > 1 else found[0]
            raise RuntimeError("no reply")

    return Recorded()


def checked(client: ModelClient) -> None:
    if client is None or not callable(getattr(client, "chat", None)):
        raise ValueError("a client is needed")


def triage(verdicts: DataFrame) -> DataFrame:
    """Verdicts (..., has_code_action, confidence, error) with ``kept`` and ``note``. An error keeps the chunk; a
    positive below 0.5 is noted; a negative is dropped however unsure."""
    positive = F.coalesce("has_code_action", F.lit(False))
    sure = F.coalesce("confidence", F.lit(0.0))
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("triage failed: "), F.col("error"))).when(positive & (sure > 0) & (sure < 0.5), "low-confidence positive")
    return verdicts.withColumn("kept", F.when(F.col("error").isNotNull(), True).otherwise(positive)).withColumn("note", note)


def ask_verdicts(chunks: DataFrame, client: ModelClient, config: ExtractConfig) -> DataFrame:
    """Verdicts (video_id, chunk_id, has_code_action, confidence, error) on chunks (video_id, chunk_id, text): one call
    each without another attempt, on ``workers`` tasks at once. ``triage`` decides on them."""

    checked(client)

    def run(frames):
        for frame in frames:
            rows = []
            for p in frame["prompt"]:
                try:
                    reply = json.loads(client.chat(p, TRIAGE_TOKENS, TRIAGE_TASK, TRIAGE_SCHEMA))
                    rows.append((bool(reply["has_code_action"]), float(reply.get("confidence", 0.0)), None))
                except Exception as e:  # a failed call is data: triage keeps the chunk
                    rows.append((None, None, str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield frame[["video_id", "chunk_id"]].assign(has_code_action=list(columns[0]), confidence=list(columns[1]), error=list(columns[2]))

    head = F.lit("Does this part of a tutorial dictate a code edit? Answer as JSON: has_code_action, confidence.\nPart ")
    asked = chunks.select("video_id", "chunk_id", F.concat(head, F.col("chunk_id"), F.lit(": "), F.col("text")).alias("prompt"))
    return asked.repartition(config.workers).mapInPandas(run, "video_id string, chunk_id string, has_code_action boolean, confidence double, error string")


def context_before(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the last 200 characters of the chunk before, in chunk order; empty for the first."""
    found = shifted(chunks, key, order, F.right("text", F.lit(200)), "context")
    return found.withColumn("context", F.coalesce("context", F.lit("")))


def all_failed(outcomes: DataFrame, key: str) -> DataFrame:
    """Keys with a chunk passed and all passed chunks failed; outcomes have (key, failed)."""
    return outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("passed"), F.sum(F.col("failed").cast("int")).alias("failures")).filter("passed > 0 and passed = failures")


def prompt(chunk_id, text, context):
    """The task's text last, so that a server can keep the common head."""
    before = F.when(context != "", F.concat(F.lit("\nBefore it: "), context)).otherwise(F.lit(""))
    return F.concat(F.lit("List the code edits that this part of a tutorial dictates, as JSON events."), before, F.lit("\nPart "), chunk_id, F.lit(": "), text)


def checked_reply(chunk_id: str, reply: str) -> str:
    """The reply if it is exactly one JSON object whose events are a list without a bad one; absent or null they are no
    events. Keys in other case are written in lower case. Raises what is wrong."""

    def number(name):
        raise ValueError(f"not JSON: {name}")

    folded = json.loads(reply, object_pairs_hook=lambda pairs: {k.lower(): v for k, v in pairs}, parse_constant=number)
    if not isinstance(folded, dict):
        raise ValueError("not an object")
    events = folded.get("events")
    if events is not None and not isinstance(events, list):
        raise ValueError("events is not a list")
    for k, event in enumerate(events or [], 1):
        if rule := violation(chunk_id, event):
            raise ValueError(f"event {k}: {rule}")
    return reply if folded == json.loads(reply) else json.dumps(folded)


def deep_extract(chunks: DataFrame, client: ModelClient, config: ExtractConfig) -> DataFrame:
    """(video_id, chunk_id, reply, error) of chunks (video_id, chunk_id, text, context): up to retries + 1 attempts
    each, on ``workers`` tasks at once. A reply that ``checked_reply`` refuses is asked for again; the last refusal is
    the chunk's error, and the row its failure marker."""

    checked(client)

    def run(frames):
        for frame in frames:
            replies, errors = [], []
            for chunk_id, p in zip(frame["chunk_id"], frame["prompt"], strict=True):
                reply = error = None
                for _ in range(config.retries + 1):
                    try:
                        reply, error = checked_reply(chunk_id, client.chat(p, config.num_predict, EVENTS_TASK, EVENTS_SCHEMA)), None
                        break
                    except Exception as e:  # a failed attempt is data: it becomes the chunk's failure marker
                        reply, error = None, str(e)
                replies.append(reply)
                errors.append(error)
            yield frame[["video_id", "chunk_id"]].assign(reply=replies, error=errors)

    asked = chunks.select("video_id", "chunk_id", prompt(F.col("chunk_id"), F.col("text"), F.col("context")).alias("prompt"))
    return asked.repartition(config.workers).mapInPandas(run, "video_id string, chunk_id string, reply string, error string")
