"""A model behind an HTTP address, asked without streaming."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from scriptloom.operators.extract import ModelClient

#: Bytes of a reply at most, and characters of it that an error tells.
MOST, TOLD = 64 << 20, 256


class ReplyError(ValueError):
    """The server's answer is not what was asked for."""


@dataclass(frozen=True)
class HttpClient(ModelClient):
    """Raises ConnectionError, TimeoutError or ReplyError. Holds no connection, so it can be sent to executors."""

    url: str
    model: str
    num_ctx: int = 4096
    keep_alive: float = 1800.0
    timeout: float = 600.0

    def __post_init__(self):
        if not self.model or not self.url.startswith(("http://", "https://")):
            raise ValueError("a model and an http(s) address are needed")

    def request(self, prompt: str, most_tokens: int, task: str, schema: dict | None) -> bytes:
        messages = [{"role": role, "content": text} for role, text in (("system", task), ("user", prompt)) if text]
        if not messages:
            raise ValueError("nothing is asked")
        body = {"model": self.model, "messages": messages, "stream": False, "keep_alive": f"{self.keep_alive:g}s", "options": {"num_ctx": self.num_ctx, "num_predict": most_tokens}}
        return json.dumps(body | ({"format": schema} if schema else {})).encode()

    def chat(self, prompt: str, most_tokens: int, task: str = "", schema: dict | None = None) -> str:
        asked = urllib.request.Request(f"{self.url.rstrip('/')}/api/chat", self.request(prompt, most_tokens, task, schema), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                data = answer.read(MOST + 1)
        except urllib.error.HTTPError as e:
            raise ConnectionError(f"http {e.code}: {e.read(TOLD).decode(errors='replace')}") from e
        except TimeoutError as e:
            raise TimeoutError(f"no answer within {self.timeout:g} s") from e
        except (urllib.error.URLError, ConnectionError) as e:
            if isinstance(getattr(e, "reason", None), TimeoutError):
                raise TimeoutError(f"no answer within {self.timeout:g} s") from e
            raise ConnectionError(str(e)) from e
        if len(data) > MOST:
            raise ReplyError(f"more than {MOST} bytes")
        told = data[:TOLD].decode(errors="replace")
        try:
            text = json.loads(data)["message"]["content"]
        except (ValueError, KeyError, TypeError) as e:
            raise ReplyError(f"not a reply: {told}") from e
        if not text or not isinstance(text, str):
            raise ReplyError(f"an empty reply: {told}")
        return text
