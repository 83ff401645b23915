import json

import pytest

from scriptloom.__main__ import main
from scriptloom.operators.extract import ExtractConfig, ask_verdicts, replay_client, triage
from scriptloom.operators.verify import ask_match, with_model_check
from scriptloom.plans.config import Settings, parse, seconds
from scriptloom.sources.captions import read_event_log


def test_settings():
    got = parse('# head\nollama:\n  url: "https://h:1" # end\n  num_ctx: 512\nsegment:\n  pause_gap: 2s\n')
    assert (got["ollama.url"], got["ollama.num_ctx"], got["segment.pause_gap"], got["extract.workers"]) == ("https://h:1", 512, 2.0, 2)
    assert got.override(verify__min_confidence=0.9, extract__workers=None)["verify.min_confidence"] == 0.9
    assert (seconds("1h30m"), seconds("1500ms")) == (5400.0, 1.5)
    for bad in ("extract:\n  workers: 9", "extract:\n  retries: x", "other:\n", "verify:\n  min: 1", "segment:\n  pause_gap: 2", "  workers: 1", "extract: 3", "ollama:\n  num_ctx: 511", "models:\n  fast: a\n  fast: b"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        Settings({"ollama.url": "ftp://x"})


def test_verdicts(spark):
    chunks = spark.createDataFrame([("v", f"c{k}", "t") for k in range(4)], "video_id string, chunk_id string, text string")
    client = replay_client({"c0:": ['{"has_code_action": true, "confidence": 0.4}'], "c1:": ['{"has_code_action": false, "confidence": 0.1}'], "c2:": ["{}"]})
    got = {r["chunk_id"]: (r["kept"], r["note"]) for r in triage(ask_verdicts(chunks, client, ExtractConfig("m"))).collect()}
    assert (got["c0"], got["c1"]) == ((True, "low-confidence positive"), (False, None))
    assert got["c2"][0] and got["c3"] == (True, "triage failed: no reply")


def test_model_check(spark):
    files = spark.createDataFrame([("v", f, f"body {f}") for f in ("a", "b", "c")], "video_id string, file string, content string")
    events = spark.createDataFrame([("v", "c2", 1, 0, "a", "second"), ("v", "c1", 1, 1, "a", "first"), ("v", "c1", 2, 2, "b", None)], "video_id string, chunk_id string, seq int, ord int, file string, code string")
    client = replay_client({"body a\nEvents:\nfirst\nsecond\n": ['{"match": false, "missing": ["x", "y"], "notes": ""}'], "body b": ['{"match": true}']})
    verdicts = ask_match(files, events, client)
    assert {r["file"]: (r["match"], r["detail"]) for r in verdicts.collect()} == {"a": (False, "mismatch; missing: x | y"), "b": (True, "mismatch")}
    scores = spark.createDataFrame([("v", "a", 0.2), ("v", "b", 0.2), ("v", "c", 1.0)], "video_id string, file string, confidence double")
    assert {r["file"]: r["confidence"] for r in with_model_check(scores, verdicts).collect()} == {"a": 0.0, "b": 0.2, "c": 1.0}


def test_command_line(spark, tmp_path):
    (tmp_path / "caps").mkdir()
    doc = {"events": [{"tStartMs": 0, "dDurationMs": 1000, "segs": [{"utf8": "one"}]}, {"tStartMs": 9000, "dDurationMs": 1000, "segs": [{"utf8": "two"}]}]}
    (tmp_path / "caps" / "vid.json3").write_text(json.dumps(doc))
    assert main(["segment", "--captions", f"{tmp_path}/caps", "--out", f"{tmp_path}/chunks"], spark) == 0
    assert sorted(r["text"] for r in spark.read.json(f"{tmp_path}/chunks").collect()) == ["one", "two"]
    event = {"chunk_id": "c0001", "seq": 1, "op": "create", "file": "f.mq5", "code": "int OnInit() {\nvoid OnTick();"}
    (tmp_path / "log.jsonl").write_text("# log\n" + json.dumps(event) + "\n" + json.dumps({"chunk_id": "c0002", "error": "x"}) + "\n")
    assert main(["assemble", "--events", f"{tmp_path}/log.jsonl", "--out", f"{tmp_path}/made", "--video", "vid"], spark) == 0
    made = spark.read.option("lineSep", "\0").text(f"{tmp_path}/made").collect()
    assert [(r["video_id"], r["file"], r["value"]) for r in made] == [("vid", "f.mq5", event["code"] + "\n")]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "f.mq5").write_text(event["code"] + "\n")
    assert main(["--min-confidence", "0.7", "verify", "--files", f"{tmp_path}/out"], spark) == 0
    assert main(["--min-confidence", "0.71", "verify", "--files", f"{tmp_path}/out"], spark) == 1
    assert main(["fidelity", "--golden", f"{tmp_path}/out/f.mq5", "--files", f"{tmp_path}/out"], spark) == 0
    assert main(["--min-confidence", "2", "verify", "--files", "x"], spark) == 2


def test_event_log_is_validated(spark, tmp_path):
    good = {"chunk_id": "c0001", "seq": 1, "op": "create", "file": "f.mq5", "code": "int x;"}
    fine = [good, good | {"op": "replace", "anchor": "x", "code": ""}, good | {"anchor": None}, {"chunk_id": "c0002", "error": None}, {"chunk_id": "c0002", "error": "x", "seq": "y"}]
    bad = [good | change for change in ({"seq": 0}, {"seq": None}, {"seq": "1"}, {"seq": 1.5}, {"file": "a/f.mq5"}, {"file": "f.txt"}, {"code": 5}, {"code": {}}, {"chunk_id": ""}, {"op": "delete"}, {"op": "replace", "anchor": "\t"})]
    bad += [{"chunk_id": "c0002", "error": 5}, [good]]
    for k, line in enumerate(bad):
        log = tmp_path / f"bad{k}.jsonl"
        log.write_text("\n".join(map(json.dumps, [good, line])))
        with pytest.raises(Exception, match="bad log line"):
            main(["assemble", "--events", str(log), "--out", f"{tmp_path}/made"], spark)
    (tmp_path / "all.jsonl").write_text("# log\n\n" + "\n".join(map(json.dumps, fine + bad)))
    kinds = [r["kind"] for r in read_event_log(spark, f"{tmp_path}/all.jsonl", quarantine=True).collect()]
    assert kinds == ["event"] * 3 + ["failed"] * 2 + ["invalid"] * len(bad)
    (tmp_path / "fine.jsonl").write_text("\n".join(map(json.dumps, fine)))
    assert read_event_log(spark, f"{tmp_path}/fine.jsonl").filter("kind = 'event'").count() == 3
