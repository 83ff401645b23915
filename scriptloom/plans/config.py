"""Settings of the flow: defaults, a settings file of sections and keys, overrides, and the ranges all must keep to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ms|s|m|h)")


def seconds(value: str) -> float:
    """Seconds of a duration such as "1.5s" or "1h30m"."""
    if not re.fullmatch(rf"(?:{_PART.pattern})+", value):
        raise ValueError(f"not a duration: {value!r}")
    return sum(float(n) * UNITS[u] for n, u in _PART.findall(value))


def _web(v: str) -> bool:
    return v.startswith(("http://", "https://"))


# Each setting's reader, default and range.
SETTINGS: dict[str, tuple[Callable, object, Callable[[object], bool], str]] = {
    "models.primary": (str, "qwen2.5-coder:3b-instruct", bool, "not empty"),
    "models.fast": (str, "qwen2.5-coder:1.5b", bool, "not empty"),
    "ollama.url": (str, "http://localhost:11434", _web, "an http(s) address"),
    "ollama.num_ctx": (int, 4096, lambda v: 512 <= v <= 32768, "512 to 32768"),
    "ollama.keep_alive": (seconds, 1800.0, lambda v: v > 0, "positive"),
    "segment.max_tokens": (int, 350, lambda v: v > 0, "positive"),
    "segment.max_seconds": (int, 45, lambda v: v > 0, "positive"),
    "segment.pause_gap": (seconds, 1.5, lambda v: v > 0, "positive"),
    "extract.workers": (int, 2, lambda v: 1 <= v <= 8, "1 to 8"),
    "extract.retries": (int, 2, lambda v: 0 <= v <= 5, "0 to 5"),
    "verify.min_confidence": (float, 0.6, lambda v: 0 <= v <= 1, "0 to 1"),
    "paths.runs_dir": (str, "runs", bool, "not empty"),
}


@dataclass(frozen=True)
class Settings:
    """Values by "section.key"; a value out of its range is an error."""

    values: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        for name, value in self.values.items():
            if name not in SETTINGS:
                raise ValueError(f"unknown setting {name}")
            if not SETTINGS[name][2](value):
                raise ValueError(f"{name} must be {SETTINGS[name][3]}, got {value!r}")

    def __getitem__(self, name: str):
        return self.values.get(name, SETTINGS[name][1])

    def override(self, **given) -> Settings:
        """With further values, named section__key; None leaves a value as it is."""
        return Settings(self.values | {k.replace("__", "."): v for k, v in given.items() if v is not None})


def parse(text: str) -> Settings:
    """Settings of lines ``section:`` and, indented below, ``key: value``; # begins a comment; values may be quoted."""
    values, section = {}, None
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        if not colon or (line[0].isspace() and section is None):
            raise ValueError(f"line {number}: neither a section nor a setting")
        if not line[0].isspace():
            if value.strip():
                raise ValueError(f"line {number}: a section has no value")
            section = key.strip()
            if not any(name.startswith(section + ".") for name in SETTINGS):
                raise ValueError(f"line {number}: unknown section {section!r}")
            continue
        name, value = f"{section}.{key.strip()}", value.strip().strip("\"'")
        if name not in SETTINGS:
            raise ValueError(f"line {number}: unknown setting {name}")
        if name in values:
            raise ValueError(f"line {number}: {name} is given twice")
        try:
            values[name] = SETTINGS[name][0](value)
        except ValueError as e:
            raise ValueError(f"line {number}: {name}: {e}") from e
    return Settings(values)


def load(path: str | None) -> Settings:
    """Settings of a file on the driver, or the defaults where no path is given."""
    return parse(Path(path).read_text()) if path else Settings()
