import itertools
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.operators.events import first_error, reanchor, violation
from scriptloom.operators.extract import ExtractConfig, all_failed, deep_extract, replay_client
from scriptloom.operators.fidelity import compare, strip_comments, tokens
from scriptloom.operators.neighbours import shifted
from scriptloom.operators.replay import replay, replay_long, replay_report
from scriptloom.operators.segment import SegmentConfig, segment
from scriptloom.operators.transcript import normalize
from scriptloom.operators.verify import balanced, confidence, findings, metadata, strip_code
from scriptloom.plans.flow import events_of
from scriptloom.streaming.sessions import pause_sessions
from scriptloom.sources.captions import best_captions, decode_asr, decode_json3, read_outputs

LINE = "video_id string, ord long, start double, end double, text string"
EVENT = "video_id string, chunk_id string, seq int, ord int, op string, file string, anchor string, code string"


def lines(spark, rows):
    return spark.createDataFrame([("v", k, float(s), float(e), t) for k, (s, e, t) in enumerate(rows)], LINE)


def test_json3(spark):
    doc = {"events": [{"tStartMs": 1000, "dDurationMs": 2500, "segs": [{"utf8": "let's "}, {"utf8": "add a variable"}]}, {"tStartMs": 4000, "dDurationMs": 1500, "segs": [{"utf8": "next line"}]}, {"tStartMs": 5000}]}
    df = spark.createDataFrame([("v", json.dumps(doc))], "video_id string, raw string")
    assert [tuple(r)[2:] for r in decode_json3(df).orderBy("ord").collect()] == [(1.0, 3.5, "let's add a variable"), (4.0, 5.5, "next line")]
    with pytest.raises(Exception):
        decode_json3(spark.createDataFrame([("v", "{broken")], "video_id string, raw string")).collect()


def test_normalize(spark):
    df = lines(spark, [(5, 8, "  second\tline  "), (1, 6.5, "first   overlaps\nsecond"), (9, 10, " \t"), (-1, 0.5, "zeroth"), (20, 19, "last one　")])
    assert [tuple(r) for r in normalize(df).orderBy("start").select("start", "end", "text").collect()] == [(-1, 0.5, "zeroth"), (1, 5, "first overlaps second"), (5, 8, "second line"), (20, 19, "last one")]


@pytest.mark.parametrize(
    "rows, config, starts",
    [
        ([], SegmentConfig(), []),
        ([(0, 2, "one line only")], SegmentConfig(), [0]),
        ([(0, 1, "a"), (3, 4, "b"), (4.5, 5, "c")], SegmentConfig(), [0, 3]),
        ([(0, 1, "a"), (2.5, 3, "b")], SegmentConfig(), [0]),
        ([(0, 1, "we see let's add it"), (1, 2, "Next line starts with the cue")], SegmentConfig(), [0, 1]),
        ([(0, 1, "x"), (1, 2, "\"Let's add an input variable\"")], SegmentConfig(), [0, 1]),
        ([(0, 1, "word " * 6), (1, 2, "word " * 6)], SegmentConfig(10, 100, 3600, ()), [0, 1]),
        ([(0, 5, "a"), (6, 12, "b")], SegmentConfig(350, 10, 3600, ()), [0, 6]),
    ],
)
def test_segment(spark, rows, config, starts):
    assert [r["start"] for r in segment(lines(spark, rows), config).orderBy("chunk_no").collect()] == starts


def test_sentence_backtrack(spark):
    rows = [(0, 1, "this is a line of words"), (1, 2, "and that is right."), (2, 3, "more words that go on here")]
    got = segment(lines(spark, rows), SegmentConfig(15, 1000, 3600, ())).orderBy("chunk_no").collect()
    assert [r["text"] for r in got] == ["this is a line of words and that is right.", "more words that go on here"]
    assert [r["chunk_id"] for r in got] == ["c0001", "c0002"]


def test_captions_of_every_kind(spark, tmp_path):
    raw = lambda *rows: spark.createDataFrame(list(rows), "video_id string, raw string")
    manual, auto, asr = raw(("a", "m")), raw(("a", "x"), ("b", "y")), raw(("a", "p"), ("b", "q"), ("c", "r"))
    got = lambda mode: {r["video_id"]: (r["raw"], r["source"]) for r in best_captions(manual, auto, asr, mode).collect()}
    assert got("auto") == {"a": ("m", "captions-manual"), "b": ("y", "captions-auto"), "c": ("r", "whisper")}
    assert got("captions") == {"a": ("m", "captions-manual")} and got("whisper")["a"] == ("p", "whisper")
    spoken = raw(("v", '[{"start": 1, "end": 2.5, "text": " hi "}, {"end": 3}]'))
    assert [tuple(r) for r in decode_asr(spoken).collect()] == [("v", 0, 1.0, 2.5, " hi "), ("v", 1, 0.0, 3.0, "")]
    with pytest.raises(Exception):
        decode_asr(raw(("v", "[{"))).collect()
    (tmp_path / "a.mq5").write_text("int x;")
    (tmp_path / "b.txt").write_text("no")
    assert [tuple(r) for r in read_outputs(spark, str(tmp_path)).collect()] == [("a.mq5", "int x;")]
    with pytest.raises(Exception, match="too large"):
        read_outputs(spark, str(tmp_path), cap=3).collect()


def test_stream_of_sessions(spark, tmp_path):
    """A pause of exactly the gap keeps a session together, a longer one ends it."""
    rows = [("v", 0.0, 1.0), ("v", 2.5, 1.0), ("v", 5.01, 1.0), ("w", 0.0, 1.0)]
    lines = spark.createDataFrame(rows, "video_id string, s double, seconds double").select("video_id", F.timestamp_seconds("s").alias("at"), "seconds")
    want = [("v", 1), ("v", 2), ("w", 1)]
    assert sorted((r["video_id"], r["n"]) for r in pause_sessions(lines, 1.5).collect()) == want
    lines.write.parquet(f"{tmp_path}/lines")
    stream = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/lines")
    query = pause_sessions(stream, 1.5).writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["video_id"], r["n"]) for r in spark.table("found").collect()) == want


def test_events(spark):
    rows = [("c", 1, "append", "a.mq5", None, "x", None), ("", 1, "append", "a.mq5", None, "x", "chunk_id"), ("c", 0, "append", "a.mq5", None, "x", "seq"), ("c", 1, "delete", "a.mq5", None, "x", "op"), ("c", 1, "append", "../a.mq5", None, "x", "bare name"), ("c", 1, "append", ".mq5", None, "x", "bare name"), ("c", 1, "append", "a.txt", None, "x", "extension"), ("c", 1, "append", "a.mq5\n", None, "x", "extension"), ("c", 1, "replace", "a.mq5", " ", "x", "anchor"), ("c", 1, "replace", "a.mq5", "k", "", None), ("c", 1, "create", "a.mq5", None, "", "code")]
    df = spark.createDataFrame(rows, "chunk_id string, seq int, op string, file string, anchor string, code string, want string")
    got = df.withColumn("got", first_error(*(F.col(c) for c in ("chunk_id", "seq", "op", "file", "anchor", "code")))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    df = spark.createDataFrame([("v", "c3", 0, 0, "append", "a.mq5", None, "x"), ("v", "c3", 1, 9, "append", "a.mq5", None, "y")], "video_id string, chunk_id string, pos int, seq int, op string, file string, anchor string, code string")
    assert [(r["seq"], r["chunk_ok"]) for r in reanchor(df).orderBy("pos").collect()] == [(1, True), (9, True)]


@pytest.mark.parametrize(
    "rows, content, skipped",
    [
        ([("c0002", 1, "append", None, "int y;"), ("c0001", 1, "create", None, "#property strict\nint x;")], "#property strict\nint x;\nint y;\n", []),
        ([("c1", 1, "create", None, "a"), ("c2", 1, "create", None, "b")], "a\n", ["create: f.mq5 already exists"]),
        ([("c1", 1, "create", None, "int x;\nint y;"), ("c2", 1, "replace", "int y;", "int z;")], "int x;\nint z;\n", []),
        ([("c1", 1, "create", None, "int x;"), ("c2", 1, "replace", "q", "z")], "int x;\n", ['replace: anchor not found in f.mq5: "q"']),
        ([("c1", 1, "create", None, "x x"), ("c2", 1, "replace", "x", "z")], "x x\n", ['replace: anchor occurs 2 times in f.mq5: "x"']),
        ([("c1", 1, "property", None, "#property strict"), ("c1", 2, "include", None, "#include <A>"), ("c1", 3, "append", None, "int x;")], "#property strict\n#include <A>\nint x;\n", []),
        ([("c1", 1, "create", None, "// head\n\nint x;"), ("c2", 1, "property", None, "#property strict"), ("c3", 1, "property", None, "#property strict")], "// head\n\n#property strict\nint x;\n", []),
    ],
)
def test_replay(spark, rows, content, skipped):
    df = spark.createDataFrame([("v", c, s, k, op, "f.mq5", a, code) for k, (c, s, op, a, code) in enumerate(rows)], EVENT)
    done = replay(df)
    assert done.collect()[0]["content"] == content
    assert [r["detail"] for r in replay_report(done).filter("status = 'skipped'").collect()] == skipped


def test_replay_of_long_histories(spark):
    """Both folds agree on random events, whatever order these come in."""
    rng = random.Random(7)
    code = ["int x;", "#property strict", "#include <A>", "// note\n\n", "\n\nint y;\n", "x", "", "a a", "/* b */", "\r\n"]
    rows = []
    for f in range(12):
        for k in range(rng.randint(1, 25)):
            op = rng.choice(["create", "append", "append", "replace", "property", "include", "delete"])
            rows.append(("v", f"c{rng.randint(1, 9)}", k, k, op, f"f{f}.mq5", rng.choice(["x", "int x;", "", None, "zz" * 40]), rng.choice([*code, None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, EVENT)
    want = sorted(map(str, replay(df).collect()))
    assert want == sorted(map(str, replay_long(df).collect())) and len(want) == 12


GOOD = '#property strict\n#property copyright "me"\nint OnInit() { return(0); }\nvoid OnTick() { Print("}"); } \n'


def test_verify(spark):
    rows = [("good", GOOD), ("noinit", GOOD.replace("OnInit", "Other")), ("open", GOOD.replace("return(0); }", "return(0);")), ("todo", GOOD + "x = placeholder; // TODO\n")]
    df = spark.createDataFrame([("v", f, c) for f, c in rows], "video_id string, file string, content string")
    score = {r["file"]: r["confidence"] for r in confidence(df).collect()}
    assert score == {"good": 1.0, "noinit": 0.75, "open": 0.75, "todo": 1.0 - 0.05 - 0.05 - 0.05}
    assert [r["check"] for r in findings(df).filter("file = 'todo'").orderBy("pos").collect()] == ["artifacts", "artifacts", "truncation"]
    one = spark.createDataFrame([('a // {\n/* ( */ "}\\"" \'{\' b /* open',)], "s string")
    r = one.select(strip_code(F.col("s")).alias("c"), balanced(F.lit(")("), "(", ")").alias("b")).first()
    assert (r["c"], r["b"]) == ("a \n   b ", False)
    assert spark.range(1).select(metadata(F.lit('#property strict\n#property version "1.0"\n')).alias("m")).first()["m"] == {"strict": "#property version"}


def test_white_space_of_any_kind(spark):
    """Tabs, carriage returns and spaces beyond ASCII at the ends of lines, anchors and cues are white space too."""
    sources = {"\t// TODO later\nint x;\r": [], "\xa0// FIXME\nint x;\t": [], "\u3000int x; // TODO\r\n}": ["TODO marker left in code: int x; // TODO"], "int x = 1\t": ["last line ends no statement"], "a ...\t\nint y;": ["ellipsis at end of line (possible truncation): a ..."]}
    df = spark.createDataFrame([("v", str(k), "#property strict\n" + s) for k, s in enumerate(sources)], "video_id string, file string, content string")
    got = {}
    for r in findings(df).filter("check in ('artifacts', 'truncation')").orderBy("file", "pos").collect():
        got.setdefault(int(r["file"]), []).append(r["detail"])
    assert [got.get(k, []) for k in range(len(sources))] == list(sources.values())
    blank = spark.createDataFrame([(a,) for a in (" ", "\t\n", "\xa0", "\u2003\r", "k", " k ")], "a string")
    rule = first_error(F.lit("c"), F.lit(1), F.lit("replace"), F.lit("f.mq5"), F.col("a"), F.lit(""))
    assert [r["r"] for r in blank.select(rule.alias("r")).collect()] == ["anchor"] * 4 + [None] * 2
    assert [violation("c", {"op": "replace", "file": "f.mq5", "anchor": a}) for a in ("\xa0", "\u2003\r", "k")] == ["anchor", "anchor", None]
    cue = spark.createDataFrame([("\t\xa0'Next line is",), ("the next line",)], "t string")
    assert [r["c"] for r in cue.select(T.starts_with_cue(F.col("t"), T.CUES).alias("c")).collect()] == [True, False]


def test_neighbours_across_blocks(spark):
    rng = random.Random(5)
    rows = [(key, order, f"{key}{order}") for key in ("a", "b", None) for order in rng.sample(range(-30, 200), 60)]
    df = spark.createDataFrame(rows, "k string, n long, t string")
    for ahead in (False, True):
        want = {}
        for key in ("a", "b", None):
            own = sorted((n for k, n, _ in rows if k == key), reverse=ahead)
            want |= {(key, n): None if before is None else f"{key}{before}" for before, n in zip([None, *own], own)}
        for block in (1, 7, 4096):
            got = shifted(df, "k", "n", F.col("t"), "x", ahead=ahead, block=block).collect()
            assert {(r["k"], r["n"]): r["x"] for r in got} == want and len(got) == len(rows)


def test_fidelity(spark):
    df = spark.createDataFrame([(1, "a b\nc", "a b\nc"), (2, "a b c d", "a b"), (3, "a", "A"), (4, "", "")], "pair_id long, golden string, output string")
    got = {r["pair_id"]: (r["precision"], r["recall"]) for r in compare(df).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 0.5), 3: (0.0, 0.0), 4: (0.0, 0.0)}
    r = spark.range(1).select(F.size(tokens(F.lit('if (RSIValue > 70) signal="sell";'))).alias("n"), strip_comments(F.lit('a; // x\n/* b\nc */ d;\n\nurl="//e";')).alias("l")).first()
    assert (r["n"], r["l"]) == (12, ["a;", "d;", 'url="//e";'])


def plain_strip(source):
    """Survey M1 line by line, with string searches only."""
    out, block = [], False
    for line in source.split("\n"):
        if block:
            i = line.find("*/")
            if i < 0:
                continue
            line, block = line[i + 2 :], False
        i = line.find("//")
        if i >= 0 and line[:i].count('"') % 2 == 0:
            line = line[:i]
        i = line.find("/*")
        if i >= 0:
            j = line.find("*/", i + 2)
            line, block = (line[:i] + line[j + 2 :], False) if j >= 0 else (line[:i], True)
        if line.strip():
            out.append(line.strip())
    return "\n".join(out)


def plain_compare(golden, output):
    g, o = (Counter(re.findall(r"\w+|[^\w\s]", plain_strip(s))) for s in (golden, output))
    n, m, both = g.total(), o.total(), (g & o).total()
    p, r = both / m if m else 0.0, both / n if n else 0.0
    return n, m, round(p, 9), round(r, 9), round(2 * p * r / (p + r), 9) if p + r else 0.0


def test_fidelity_comments(spark):
    code = "int x;\nvoid f() { g(1); }\n"
    rows = [
        (code, "// head\n/* long\n   note */int x; // tail\nvoid f() { /* why */ g(1); }\n"),
        ("a /* b */ c /* d */ e", "a c e"),
        ("a /* b */ c /* d\ne */ f", "a f"),
        ('see "http://x" // y\nz', 'see "http://x"\nz'),
        ("a /* // */ b\nc */ d", "a d"),
        ("/* all", ""),
    ]
    pieces, rng = ["//", "/*", "*/", '"', "a", "b1", " ", "\n", "/", "*"], random.Random(3)
    rows += [tuple("".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pair_id long, golden string, output string")
    got = {r[0]: (r[1], r[2], *(round(x, 9) for x in r[3:])) for r in compare(df).collect()}
    assert got == {k: plain_compare(*r) for k, r in enumerate(rows)}
    assert got[0][-1] == 1.0


def test_ids(spark):
    i = "dQw4w9WgXcQ"
    good = [i, f" {i} ", f"https://www.youtube.com/watch?v={i}", f"https://youtu.be/{i}?t=1", f"https://m.youtube.com/watch?a=b&v={i}", f"https://youtube.com/shorts/{i}", f"https://www.youtube-nocookie.com/embed/{i}"]
    bad = ["", "not a url", f"https://example.com/watch?v={i}", "https://youtube.com/playlist?list=x", "https://youtu.be/short", "https://youtube.com/a/b/c"]
    got = spark.createDataFrame([(u,) for u in good + bad], "url string").select(T.video_id(F.col("url")).alias("id")).collect()
    assert [r["id"] for r in got] == [i] * len(good) + [None] * len(bad)


def test_extraction_retries(spark):
    chunks = spark.createDataFrame([("v", "c0001", "one", ""), ("v", "c0002", "two", "one")], "video_id string, chunk_id string, text string, context string")
    client = replay_client({"c0001: one": ["not json", '{"events": []}'], "c0002: two": ["[]"]})
    got = {r["chunk_id"]: (r["reply"], r["error"]) for r in deep_extract(chunks, client, ExtractConfig("m", workers=1)).collect()}
    assert got == {"c0001": ('{"events": []}', None), "c0002": (None, "not an object")}


def test_extraction_checks_events(spark):
    def reply(*events):
        return json.dumps({"events": events})

    good = {"op": "create", "file": "a.mq5", "code": "int x;"}
    bad = {
        "event 2: extension": reply(good, good | {"file": "a.txt"}),
        "event 1: anchor": reply({"op": "replace", "file": "a.mq5", "anchor": " \t", "code": "y"}),
        "event 1: op": reply(good | {"op": "delete"}),
        "event 1: file": reply({"op": "append", "code": "y"}),
        "event 1: bare name": reply(good | {"file": "x\\a.mq5"}),
        "event 1: code": reply(good | {"code": None}),
        "event 1: type of seq": reply(good | {"seq": "1"}),
        "event 1: type of code": reply(good | {"code": 5}),
        "event 1: not an object": reply("x"),
        "events is not a list": '{"events": {}}',
    }
    fine = [reply(good), reply(good | {"seq": 0}), "{}", '{"events": null}']
    cases = [([b], (None, e)) for e, b in bad.items()] + [([b, b, fine[0]], (fine[0], None)) for b in bad.values()] + [([r], (r, None)) for r in fine]
    cases.append((['{"Events": [{"OP": "create", "File": "a.mq5", "code": "x"}]}'], ('{"events": [{"op": "create", "file": "a.mq5", "code": "x"}]}', None)))
    chunks = spark.createDataFrame([("v", f"c{k:04}", "t", "") for k in range(len(cases))], "video_id string, chunk_id string, text string, context string")
    client = replay_client({f"c{k:04}: t": list(replies) for k, (replies, _) in enumerate(cases)})
    out = deep_extract(chunks, client, ExtractConfig("m", workers=1, retries=2)).persist()
    assert {r["chunk_id"]: (r["reply"], r["error"]) for r in out.collect()} == {f"c{k:04}": want for k, (_, want) in enumerate(cases)}
    with_events = {f"c{k:04}" for k, (_, (r, _)) in enumerate(cases) if r and "mq5" in r}
    assert {r["chunk_id"] for r in events_of(out).collect()} == with_events
    outcomes = out.select("video_id", F.col("error").isNotNull().alias("failed"), "chunk_id")
    assert [r["video_id"] for r in all_failed(outcomes.filter(F.col("chunk_id") < f"c{len(bad):04}"), "video_id").collect()] == ["v"]


def test_violations_as_first_error(spark):
    names = ("chunk_id", "op", "file", "anchor", "code")
    rows = [dict(zip(names, r, strict=True)) for r in itertools.product(("c", "", None), ("create", "replace", "delete", None), ("a.mq5", "a/b.mq5", ".mq5", "a.txt", "", None), ("k", " ", None), ("x", "", None))]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "chunk_id string, op string, file string, anchor string, code string")
    got = df.select(first_error(*(F.col(n) if n else F.lit(1) for n in ("chunk_id", None, "op", "file", "anchor", "code"))).alias("rule")).collect()
    assert [r["rule"] for r in got] == [violation(r["chunk_id"], r) for r in rows]
