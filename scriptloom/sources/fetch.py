"""Getting captions by an external downloader, or speech recognised from a video's sound. Only this module reaches out."""

from __future__ import annotations

import subprocess
import sys
import tempfile
import threading
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import video_id

#: Bytes that are kept of what a command says on either channel.
SAID, COMPLAINED = 1 << 20, 8 << 10
# The downloader's command line and the recogniser's settings.
DOWNLOADER = "yt-dlp"
CAPTIONS = ["--no-playlist", "--skip-download", "{kind}", "--sub-langs", "en", "--sub-format", "json3", "-o", "{out}", "{url}"]
SOUND = ["--no-playlist", "-x", "--audio-format", "m4a", "--audio-quality", "48K", "-o", "{out}", "{url}"]
TITLE = ["--no-playlist", "--print", "title", "{url}"]
RECOGNISE = """
import json, sys
from faster_whisper import WhisperModel
sound, out, name = sys.argv[1:4]
spoken, _ = WhisperModel(name, compute_type="int8", cpu_threads=8).transcribe(sound, vad_filter=True)
rows = [dict(start=float(x.start), end=float(x.end), text=x.text) for x in spoken]
open(out, "w", encoding="utf-8").write(json.dumps(rows, ensure_ascii=False))
"""


class NoCaptions(LookupError):
    """A video has no captions of the kind asked for."""


class Runner(Protocol):
    def run(self, argv: list[str]) -> bytes: ...


class CommandRunner:
    """Runs a command without a shell; of its output no more than SAID bytes are kept, of its complaints COMPLAINED."""

    def run(self, argv: list[str]) -> bytes:
        try:
            p = subprocess.Popen(argv, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        except OSError as e:
            raise RuntimeError(f"{argv[0]}: {e}") from e
        kept = {}

        def read(name, stream, most):
            data = b""
            while part := stream.read(1 << 16):
                data += part[: most - len(data)]
            kept[name] = data

        readers = [threading.Thread(target=read, args=a) for a in (("out", p.stdout, SAID), ("err", p.stderr, COMPLAINED))]
        for t in readers:
            t.start()
        for t in readers:
            t.join()
        if p.wait():
            said = kept["err"].decode(errors="replace").strip()
            raise RuntimeError(f"{argv[0]} ended with {p.returncode}" + (f": {said}" if said else ""))
        return kept["out"]


def title_of(url: str, runner: Runner) -> str:
    title = runner.run([DOWNLOADER, *(a.format(url=url) if "{" in a else a for a in TITLE)]).decode(errors="replace").strip()
    if not title or "\n" in title or "\r" in title:
        raise RuntimeError(f"unexpected title {title!r}")
    return title


def captions_of(video: str, url: str, mode: str, runner: Runner, model: str = "small") -> tuple[str, str]:
    """(source, raw captions) of a video. Mode "captions" takes manual ones only, "whisper" recognises speech, "auto"
    tries manual, then automatic ones, then recognises."""
    if mode not in ("captions", "whisper", "auto"):
        raise ValueError(f"no such mode: {mode}")
    with tempfile.TemporaryDirectory() as folder:
        out = f"{folder}/{video}.%(ext)s"
        for source, kind in (("captions-manual", "--write-subs"), ("captions-auto", "--write-auto-subs")):
            if mode == "whisper" or (mode == "captions" and source != "captions-manual"):
                continue
            runner.run([DOWNLOADER, *(kind if a == "{kind}" else out if a == "{out}" else url if a == "{url}" else a for a in CAPTIONS)])
            if (found := Path(folder, f"{video}.en.json3")).exists():
                return source, found.read_text()
        if mode == "captions":
            raise NoCaptions(video)
        runner.run([DOWNLOADER, *(out if a == "{out}" else url if a == "{url}" else a for a in SOUND)])
        sound = Path(folder, f"{video}.m4a")
        if not sound.exists():
            raise RuntimeError(f"no sound at {sound}")
        runner.run([sys.executable, "-c", RECOGNISE, str(sound), f"{sound}.json", model])
        return "whisper", Path(f"{sound}.json").read_text()


def fetch(urls: DataFrame, mode: str = "auto", runner: Runner | None = None, workers: int = 2) -> DataFrame:
    """(video_id, url, title, source, raw, error) of addresses (url), on ``workers`` tasks at once; an address that names no
    video and a failed command are told in ``error``, a failed title is null. To be written before it is used again."""
    runner = runner or CommandRunner()

    def run(frames):
        for frame in frames:
            rows = []
            for video, url in zip(frame["video_id"], frame["url"], strict=True):
                source = raw = title = error = None
                try:
                    if video is None:
                        raise ValueError("no video id in the address")
                    source, raw = captions_of(video, url, mode, runner)
                except Exception as e:  # a failed download is data
                    error = str(e) or type(e).__name__
                if error is None:
                    try:
                        title = title_of(url, runner)
                    except Exception:  # a title is not needed
                        title = None
                rows.append((title, source, raw, error))
            titles, sources, raws, errors = zip(*rows, strict=True) if rows else ((),) * 4
            yield frame.assign(title=titles, source=sources, raw=raws, error=errors)

    named = urls.select(video_id(F.col("url")).alias("video_id"), "url")
    return named.repartition(workers).mapInPandas(run, "video_id string, url string, title string, source string, raw string, error string")
