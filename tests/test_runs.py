import http.server
import json
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from scriptloom.__main__ import main
from scriptloom.operators.extract import EVENTS_SCHEMA, TRIAGE_SCHEMA, ExtractConfig
from scriptloom.plans.runs import Runs, assembly_report, run_all, verify_report
from scriptloom.sources.captions import CHUNKS, LINES, read_array, read_report
from scriptloom.sources.client import HttpClient, ReplyError
from scriptloom.sources.fetch import CommandRunner, NoCaptions, captions_of, fetch, title_of

CAPTIONS = {"events": [{"tStartMs": 0, "dDurationMs": 1000, "segs": [{"utf8": "type this"}]}, {"tStartMs": 9000, "dDurationMs": 1000, "segs": [{"utf8": "just talk"}]}]}
CODE = "#property strict\nint OnInit() { return 0; }\nvoid OnTick() { }"
EVENT = {"chunk_id": "x", "seq": 0, "op": "create", "file": "f.mq5", "code": CODE}


@pytest.fixture()
def server():
    """A model server that counts what it is asked; ``broken`` makes it give no edits."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked = body["messages"][-1]["content"]
            self.server.asked.append((body["format"], asked))
            if body["format"] == TRIAGE_SCHEMA:
                text = json.dumps({"chunk_id": "x", "has_code_action": "type this" in asked, "confidence": 1.0})
            else:
                text = "[]" if self.server.broken else json.dumps({"events": [EVENT]})
            data = json.dumps({"message": {"content": text}}).encode() if self.server.plain is None else self.server.plain
            self.send_response(200 if self.server.plain is None or data != b"down" else 500)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked, s.broken, s.plain = [], False, None
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_flow_with_resume(spark, tmp_path, server):
    (tmp_path / "caps").mkdir()
    for video in ("vid1", "7"):
        (tmp_path / "caps" / f"{video}.json3").write_text(json.dumps(CAPTIONS))
    (tmp_path / "settings").write_text(f"ollama:\n  url: http://127.0.0.1:{server.server_port}\n")
    args = ["--config", f"{tmp_path}/settings", "pipeline", "--captions", f"{tmp_path}/caps", "--runs", f"{tmp_path}/runs"]
    runs = Runs(spark, f"{tmp_path}/runs")
    assert main(args, spark) == 0
    assert sum(f == TRIAGE_SCHEMA for f, _ in server.asked) == 4 and sum(f == EVENTS_SCHEMA for f, _ in server.asked) == 2
    summary = {r["video_id"]: (r["confidence"], r["failed_chunks"], r["passes"]) for r in spark.read.json(f"{tmp_path}/runs/summary").withColumn("video_id", F.col("video_id").cast("string")).collect()}
    assert summary == {"vid1": (1.0, 0, True), "7": (1.0, 0, True)}
    assert {(r["video_id"], r["content"]) for r in runs.current("files").collect()} == {(v, CODE + "\n") for v in ("vid1", "7")}
    report = assembly_report(runs.current("assembly").select("video_id", "file", "chunk_id", "seq", "op", "status", "detail")).collect()
    assert {(r["video_id"], r["applied"], r["skipped"], tuple(r["files"])) for r in report} == {(v, 1, 0, ("f.mq5",)) for v in ("vid1", "7")}

    def stages():
        return {(r["video_id"], r["stage"]): r["n"] for r in runs.manifest().groupBy("video_id", "stage").agg(F.count(F.lit(1)).alias("n")).collect()}

    before, asked = stages(), len(server.asked)
    assert main(args, spark) == 0 and stages() == before and len(server.asked) == asked  # nothing is done again
    shutil.rmtree(tmp_path / "runs" / "events" / "video=v-vid1")
    assert main(args, spark) == 0  # only the extraction of the video that lost its events
    assert {k for k, n in stages().items() if n > before[k]} == {("vid1", "extract")} and len(server.asked) == asked + 1

    server.broken = True
    changed = json.loads(json.dumps(CAPTIONS))
    changed["events"][0]["segs"][0]["utf8"] = "type this now"
    (tmp_path / "caps" / "7.json3").write_text(json.dumps(changed))
    assert main(args, spark) == 1  # its only chunk fails: no files, confidence 0
    assert {r["video_id"]: r["error"] for r in runs.current("events").filter("kind = 1").collect()} == {"7": "not an object"}
    server.broken, asked = False, len(server.asked)
    assert main(args, spark) == 0  # a video without any success is asked about again
    assert [f for f, _ in server.asked[asked:]] == [EVENTS_SCHEMA]
    before = stages()
    assert main([*args, "--force"], spark) == 0
    assert all(n == before[k] + 2 for k, n in stages().items())  # the reset and the run

    spark.read.parquet(f"{tmp_path}/runs/manifest/video=v-7").limit(1).write.mode("append").parquet(f"{tmp_path}/runs/manifest/video=v-vid1")
    with pytest.raises(Exception, match="lies under"):
        runs.manifest().collect()


def test_empty_input_and_bad_names(spark, tmp_path):
    raw = spark.createDataFrame([("../x", "{}", "whisper")], "video_id string, raw string, source string")
    client = HttpClient("http://127.0.0.1:1", "m")
    with pytest.raises(Exception, match="no run name"):
        run_all(spark, raw, f"{tmp_path}/bad", client)
    with pytest.raises(Exception, match="no input hash"):
        row = [("v", "fetch", "", 1, False)]
        Runs(spark, f"{tmp_path}/r").note(spark.createDataFrame(row, "video_id string, stage string, input_hash string, n_rows long, failed boolean"))


def test_client(server):
    c = HttpClient(f"http://127.0.0.1:{server.server_port}", "m", timeout=5)
    assert json.loads(c.chat("Part: type this", 5, "task", TRIAGE_SCHEMA))["has_code_action"]
    for plain, error in ((b"{", ReplyError), (b'{"message": {"content": ""}}', ReplyError), (b"[]", ReplyError), (b"down", ConnectionError)):
        server.plain = plain
        with pytest.raises(error):
            c.chat("x", 5, "", TRIAGE_SCHEMA)
    with pytest.raises(ConnectionError):
        HttpClient("http://127.0.0.1:1", "m", timeout=2).chat("x", 5)
    for bad in (("", "http://x"), ("m", "ftp://x")):
        with pytest.raises(ValueError):
            HttpClient(bad[1], bad[0])
    assert ExtractConfig("m", num_predict=0).num_predict == 512
    with pytest.raises(ValueError):
        ExtractConfig("m", num_predict=-1)


def downloads(has=(), title=b"A title\n"):
    """A runner that writes what a downloader would, by the kinds of captions that a video has."""

    class Downloads:
        calls: list = []

        def run(self, argv):
            self.calls.append(argv)
            if "--print" in argv:
                return title
            out = argv[argv.index("-o") + 1] if "-o" in argv else None
            for kind, flag, name in (("manual", "--write-subs", "en.json3"), ("auto", "--write-auto-subs", "en.json3"), ("sound", "-x", "m4a")):
                if flag in argv and kind in has:
                    with open(out.replace("%(ext)s", name), "w") as f:
                        f.write(kind)
            if out is None:
                with open(argv[4], "w") as f:
                    f.write("[]")
            return b""

    return Downloads()


def test_fetch(spark):
    url, video = "https://youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"
    assert captions_of(video, url, "auto", downloads(("manual", "auto"))) == ("captions-manual", "manual")
    assert captions_of(video, url, "auto", downloads(("auto",))) == ("captions-auto", "auto")
    assert captions_of(video, url, "auto", d := downloads(("sound",))) == ("whisper", "[]")
    assert len(d.calls) == 4 and d.calls[-1][-1] == "small"
    assert captions_of(video, url, "whisper", d := downloads(("sound",)))[0] == "whisper" and len(d.calls) == 2
    with pytest.raises(NoCaptions):
        captions_of(video, url, "captions", downloads(("auto", "sound")))
    with pytest.raises(ValueError):
        captions_of(video, url, "other", downloads())
    for title in (b"", b"a\nb"):
        with pytest.raises(RuntimeError):
            title_of(url, downloads(title=title))
    urls = spark.createDataFrame([(url,), ("https://example.com/x",)], "url string")
    got = {r["url"]: (r["video_id"], r["source"], r["raw"], r["title"], r["error"]) for r in fetch(urls, runner=downloads(("auto",))).collect()}
    assert got[url] == (video, "captions-auto", "auto", "A title", None) and got["https://example.com/x"][4] == "no video id in the address"


def test_commands():
    run = CommandRunner().run
    assert run(["printf", "%s", "a b; c"]) == b"a b; c"
    assert len(run(["head", "-c", "3000000", "/dev/zero"])) == 1 << 20
    with pytest.raises(RuntimeError, match="no-such-file"):
        run(["ls", "no-such-file"])
    with pytest.raises(RuntimeError):
        run(["no-such-command"])


def test_arrays_and_reports_are_read(spark, tmp_path):
    (tmp_path / "v.lines.json").write_text('[{"start": 0, "end": 1.5, "text": "a"}, {"start": 2, "end": 3, "text": "b"}]')
    (tmp_path / "v.chunks.json").write_text('[{"id": "c0001", "start": 0, "end": 3, "text": "a b"}]')
    (tmp_path / "w.lines.json").write_text("null")
    (tmp_path / "x.lines.json").write_text('{"start": 0')
    assert [tuple(r) for r in read_array(spark, f"{tmp_path}/[vw].lines.json", LINES).collect()] == [("v", 0, 0.0, 1.5, "a"), ("v", 1, 2.0, 3.0, "b")]
    assert [r["id"] for r in read_array(spark, f"{tmp_path}/v.chunks.json", CHUNKS).collect()] == ["c0001"]
    for path, cap in ((f"{tmp_path}/x.lines.json", 1 << 20), (f"{tmp_path}/v.lines.json", 10)):
        with pytest.raises(Exception):
            read_array(spark, path, LINES, cap).collect()
    scores = spark.createDataFrame([("v", "f.mq5", "ea", {"a": "b"}, 0.75)], "video_id string, file string, program_type string, metadata map<string, string>, confidence double")
    found = spark.createDataFrame([("v", "f.mq5", 0, "error", "balance", "unbalanced {}")], "video_id string, file string, pos int, severity string, check string, detail string")
    report = verify_report(scores, found)
    report.write.json(f"{tmp_path}/report")
    back = read_report(spark, f"{tmp_path}/report", report.schema).collect()
    assert back == report.collect() and back[0]["findings"][0]["check"] == "balance"


def test_one_golden_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.mq5").write_text("int x;")
    assert main(["fidelity", "--golden", f"{tmp_path}/*.mq5", "--files", f"{tmp_path}"], spark) == 2
    assert main(["fidelity", "--golden", f"{tmp_path}/a.mq5", "--files", f"{tmp_path}"], spark) == 0
