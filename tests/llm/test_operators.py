"""Small cases of every operator: nulls, empty and repeated rows, clashing columns, empty tables, brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import exact_dedup as exact
from scriptloom.llm import media, near_dedup as near, packing, quality, repeats, shingles, toxicity
from scriptloom.llm.chat import chat_digest, fold_messages, read_turns, render
from scriptloom.llm.components import components
from scriptloom.llm.exact_dedup import exact_dedup
from scriptloom.llm.line_dedup import LineRuns, line_dedup
from scriptloom.llm.near_dedup import near_dedup, similar_links
from scriptloom.llm.queries import TRICKY, conversation_log
from scriptloom.llm.textnum import blocks, split_words

DOCS = "doc_id long, text string, t long, dropped string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = text(300), text(120), "A common line of some length"
    near = base.split()
    near[150] = "changed"
    texts = [None, "", "", " \n\t", "one two", "One TWO", "x", base, base.upper(), " ".join(near), base + " tail", text(50) + passage, passage + text(60), f"{line}\na\n{line}", f" {line.lower()} \nb", f"q\n{line}", text(2000), "y" * 30_000]
    rows = [(k, t, 1, "a", "b") for k, t in enumerate(texts)] + [(7, base, 1, "a", "b"), (None, "one two", 1, "a", "b")]
    return spark.createDataFrame(rows, DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_words_match_a_plain_split():
    texts = ["a b", "", "  x\x0b y", "Z,z. q", "é\xa0b c", None]
    for _, data, offsets in blocks(pa.array(texts, pa.string())):
        w = split_words(data, offsets)
        got = [data.tobytes()[a:b].decode() for a, b in zip(w.starts, w.ends)]
        assert got == [x for t in texts for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_exact(docs):
    want = {}
    for i, t in rows_of(docs):
        want.setdefault(low(t), []).append(i)
    for r in exact_dedup(docs).collect():
        ids = next(v for v in want.values() if r["doc_id"] in v and hashlib.sha256(low(dict(rows_of(docs))[r["doc_id"]]).encode()).hexdigest() == r["text_sha256"])
        top = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(ids), r["doc_id"] == top)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_colliding_identifiers(docs, monkeypatch):
    """Many chunk contents share an identifier of three bits: the result stays the same."""
    want = sorted(map(str, exact_dedup(docs).collect()))
    monkeypatch.setattr(exact, "identifier", lambda c: F.struct(F.pmod(F.xxhash64(c), F.lit(8)).alias("a"), F.lit(0).alias("b")))
    assert exact.colliding_identifiers(docs, "text").count() > 0
    assert sorted(map(str, exact_dedup(docs).collect())) == want


def plain_lines(rows, min_chars=20, min_docs=3):
    """(id, lines, dropped, kept text) by counting each key's documents."""
    blank = " \t\n\x0b\x0c\r"
    held = {}
    for i, t in set(rows):
        for line in t.split("\n"):
            held.setdefault(low(line).strip(blank), set()).add((i, t))
    top = {k: max((i for i, _ in v if i is not None), default=None) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if (k := low(x).strip(blank)) not in top or top[k] is None or i == top[k]]
        out.append(str((i, len(lines), len(lines) - len(kept), "\n".join(kept))))
    return sorted(out)


def test_lines_by_brute_force(spark):
    rng = random.Random(11)
    common = [f"Common LINE number {k:04d} of all" for k in range(40)] + ["short", "", "Ünïcode line of twenty x", "x" * 19, "x" * 20]
    text = lambda: "\n".join(rng.choice(["", "  ", "\t"]) + (low(x) if rng.random() < 0.5 else x) + rng.choice(["", "\r", " "]) for x in rng.choices(common, k=rng.randint(0, 12)))
    rows = [(k, text()) for k in range(60)] + [(None, common[0]), (5, common[1])]
    rows.append(rows[7])
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect()
    assert sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in got) == plain_lines(rows)


def test_lines(docs):
    got = {r["doc_id"]: r for r in line_dedup(docs, batches=3).collect()}
    assert (got[0]["n_lines"], got[1]["kept_text"]) == (1, "")
    assert (got[13]["n_dropped"], got[13]["kept_text"], got[14]["kept_text"], got[15]["n_dropped"]) == (2, "a", "b", 0)
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_runs(spark):
    rng, want, runs = random.Random(4), {}, LineRuns(spark, fanout=2)
    for _ in range(5):
        batch = {(rng.randint(0, 9), rng.randint(0, 2)): (rng.randint(1, 3), rng.choice([None, rng.randint(-5, 50)])) for _ in range(12)}
        fresh = {k for k in batch if k not in want}
        table = spark.createDataFrame([(*k, *v) for k, v in batch.items()], "hi long, lo long, n_docs long, max_doc long")
        assert {(r["hi"], r["lo"]) for r in runs.fresh(table).collect()} == fresh
        runs.add(table)
        for k, (n, m) in batch.items():
            old = want.get(k, (0, None))
            want[k] = (old[0] + n, max((x for x in (old[1], m) if x is not None), default=None))
        held = [(r["hi"], r["lo"]) for run in runs.runs() for r in run.collect()]
        assert sorted(held) == sorted(want)  # each key in one run
        assert {(r["hi"], r["lo"]): (r["n_docs"], r["max_doc"]) for r in runs.totals().collect()} == want


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_components_of_long_chains(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002), (2000, 2000)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(300), 0) | {1000: 1000, 1001: 1000, 1002: 1000}


@pytest.mark.parametrize("sizes", [{"LOOK": 12, "BLOCK": 4, "FOLLOWERS": 2}, {"BROADCAST": 0, "LOOK": 8}])
def test_near_at_every_size(spark, monkeypatch, sizes):
    """Groups beyond one look are dealt again, clusters beyond one block into several, ids beyond a broadcast joined."""
    for name, value in sizes.items():
        monkeypatch.setattr(near, name, value)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for c in range(3):
        base = rng.choices(words, k=rng.choice([12, 40, 120]))
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    assert_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near(docs):
    assert_near(docs)
    assert near_dedup(docs.limit(0)).count() == 0


def assert_near(docs):
    sets = rows_of(docs)
    up = list(range(len(sets)))
    find = lambda k: k if up[k] == k else find(up[k])
    for (a, (_, x)), (b, (_, y)) in combinations([(k, (i, shingle_set(t))) for k, (i, t) in enumerate(sets)], 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[find(b)] = find(a)
    want = []
    for k, (i, t) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(k) and sets[j][0] is not None]
        want.append((str(i), len(shingle_set(t)), min(ids, default=None)))
    assert sorted(map(str, want)) == sorted(str((str(r["doc_id"]), r["n_shingles"], r["component_id"])) for r in near_dedup(docs).collect())


def test_sketches_of_moved_sets_tell_sets_apart():
    """Sets that have travelled have lost bits; their sketches are those of the whole ones and rule pairs out."""
    rng = np.random.default_rng(4)
    for size in (5, 60, 700):
        a, b = (np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(2))
        moved = [near.widened(near.narrow(x)) for x in (a, b)]
        assert [near.sketch(x) for x in moved] == [near.sketch(a), near.sketch(b)]
        x, y = near.folded([near.sketch(x) for x in moved])
        assert np.bitwise_count(x ^ y).sum() > 2 * size // 9


def test_sets_too_small_to_link_make_no_groups(spark):
    small = spark.createDataFrame([(" ".join(f"w{k}x{i}" for i in range(n)),) for k in range(40) for n in (1, 3, 7)], "text string")
    assert near.shared_signatures(near.packed_signatures(small, 4, 5, 80), 4).count() == 0


def test_all_links(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    more = []
    for k in range(12):  # one dense class: many links beside those that span it
        some = list(base)
        for _ in range(k % 5):
            some[rng.randrange(200)] = f"other{k}"
        more.append((100 + k, " ".join(some), 1, "a", "b"))
    table = docs.union(spark.createDataFrame(more, DOCS))
    links, per_row = similar_links(table)
    found = rows_of(table)
    sets = [shingle_set(t) for _, t in found]
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = [(str(i), len(x), sum(bool(near(x, y)) for k, y in enumerate(sets) if k != j)) for j, ((i, _), x) in enumerate(zip(found, sets, strict=True))]
    got = per_row.collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in got) == sorted(want)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) == sum(bool(near(x, y)) for x, y in combinations(set(sets), 2))
    assert len(pairs) > len({i for p in pairs for i in p})  # more than span the classes
    assert all(a < b for a, b in pairs) and {i for p in pairs for i in p} <= {r["set"] for r in got}
    links, per_row = similar_links(docs.limit(0))
    assert links.count() == per_row.count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(800):
        n = int(rng.choice([1, 3, 4, 5, 6, 8, 10, 15, 30, 60, 200]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        k = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**64, n // 4 - k, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(shingles.signatures(a), shingles.signatures(b)))


def without_repeats(rows, size):
    """(id, bytes removed, spans, digest of the rest, the rest) by looking at every window."""
    seen: dict[bytes, int] = {}
    for _, b in rows:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] = seen.get(b[k : k + size], 0) + 1
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((str(i), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def removed(table, size):
    return sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(table, size).collect())


def test_suffix_array(monkeypatch):
    rng = random.Random(0)
    for letters in (b"ab\x00\xff", b"a", b"abc"):
        for _ in range(100):
            b = bytes(rng.choice(letters) for _ in range(rng.randint(0, 60)))
            b += b[: rng.randint(0, 60)]
            assert repeats.suffix_array(b, 130).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    b = bytes(rng.choice(b"abc") for _ in range(1500))
    b = b + b"x" + b[:900] + b"y" + b
    for tied in (repeats.TIED, 40):
        monkeypatch.setattr(repeats, "TIED", tied)
        assert repeats.suffix_array(b, 4000).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_repeats(docs):
    got = removed(docs, 400)
    assert got == without_repeats([(i, t.encode()) for i, t in rows_of(docs)], 400)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    text = {str(r["doc_id"]): r["text"] for r in repeats.remove_repeats(docs).collect()}
    assert text["7"] == "" and text["4"] == "one two"


def hot_rows():
    """Documents around one passage: longer, shorter and as long as what is looked for, some whole copies."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = noise(300)
    rows = []
    for k in range(90):
        part = hot[rng.randint(0, 60) : 300 - rng.randint(0, 150)] if k % 3 else hot
        same = "q" * 30 if k % 5 == 0 else noise(30)  # surroundings that some share
        rows.append((k, noise(rng.randint(0, 90)) + same + part + noise(rng.randint(0, 200))))
    return rows + [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, "ab" * 700), (203, "z" * 900)]


@pytest.mark.parametrize("block", [2_500, 300])
def test_hot_anchors_are_split(spark, monkeypatch, block):
    """Blocks so small that anchors of many different stretches go down to halves, to single windows at the last."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "FEW", min(repeats.FEW, block // 2))
    rows = hot_rows()
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 120) == without_repeats([(i, t.encode()) for i, t in rows], 120)


def test_long_texts_are_sliced(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 6000, dtype=np.uint8)
    whole = set(repeats.anchors(data, np.array([0, len(data)]), 400)[1].tolist())
    parts = set()
    for low_ in range(0, len(data), 1000):
        high = min(len(data), low_ + 1399)
        parts |= {int(p) + low_ for p in repeats.anchors(data[low_:high], np.array([0, high - low_]), 400)[1]}
    assert parts == whole


def test_media(docs):
    px = np.random.default_rng(0).integers(0, 256, (50, 576), dtype=np.uint8)
    assert (media.decode_frames(media.read_avi(media.write_avi(media.encode_frames(px)))) == px).all()
    got = media.media_features(docs).collect()
    by_text = {}
    for r, (_, t) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows_of(docs), key=lambda x: str(x[0]))):
        n, payload = media.payload_of(t)
        assert (r["n_bytes"], r["payload_sha256"]) == (n, hashlib.sha256(payload).hexdigest())
        assert by_text.setdefault(t, r["feature"]) == r["feature"]
    cut = np.concatenate([np.full((20, 576), 10, np.uint8), np.full((20, 576), 200, np.uint8)])
    assert media.cuts(cut).tolist() == [20]
    assert media.clip_rows(media.encode_media(docs)).filter("clip = 0").count() == docs.count()


def read_frame(jpeg):
    """The samples of a lossless frame, bit by bit from its own Huffman table."""
    at, codes = 2, {}
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if marker == 0xC4:
            code, k = 0, at + 21
            for bits, n in enumerate(jpeg[at + 5 : at + 21], 1):
                for _ in range(n):
                    codes[f"{code:0{bits}b}"] = jpeg[k]
                    code, k = code + 1, k + 1
                code <<= 1
        at += 2 + size
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in jpeg[at:-2].replace(b"\xff\x00", b"\xff"))
    out, i = np.zeros((media.SIDE, media.SIDE), int), 0
    for y in range(media.SIDE):
        for x in range(media.SIDE):
            j = i + 1
            while bits[i:j] not in codes:
                j += 1
            s = codes[bits[i:j]]
            v, i = int(bits[j : j + s] or "0", 2), j + s
            d = v if not s or v >> (s - 1) else v - (1 << s) + 1
            out[y, x] = d + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return out


def test_media_frames_by_another_reader():
    px = np.random.default_rng(1).integers(0, 256, (6, 576), dtype=np.uint8)
    px[3:] //= 8
    files = media.read_avi(media.write_avi(media.encode_frames(px)))
    assert all((read_frame(f).ravel() == p).all() for f, p in zip(files, px, strict=True))
    # a file whose frames have tables of their own: the categories' codes the other way about are not of one width
    other = files[0].replace(bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)), bytes([1] * 9 + [0] * 7) + bytes(range(9)))
    with pytest.raises(ValueError):
        media.decode_frames([files[1], other])


def test_media_of_an_empty_table(docs):
    assert media.media_features(docs.limit(0)).count() == media.clip_rows(media.encode_media(docs.limit(0))).count() == 0


def test_clips_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        levels = np.repeat(rng.integers(0, 230, rng.integers(1, 8)), rng.integers(1, 30))
        frames = (levels[:, None] + rng.integers(0, 25, (len(levels), 576))).astype(np.uint8)
        hist = [np.bincount(f >> 4, minlength=16) for f in frames]
        d = [np.abs(a - b).sum() / (2 * 576) for a, b in zip(hist, hist[1:])]
        want = []
        for k, x in enumerate(d):
            others = [d[j] for j in range(max(0, k - 12), min(len(d), k + 13)) if j != k]
            mean = sum(others) / max(len(others), 1)
            spread = (sum((o - mean) ** 2 for o in others) / max(len(others), 1)) ** 0.5
            if x >= 0.3 and x > mean + 3 * spread + 1e-9:
                want.append(k + 1)
        assert media.cuts(frames).tolist() == want
        edges = [0, *want, len(frames)]
        assert media.clips(frames) == [(k, a, b - a, a / media.FPS, b / media.FPS) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_chat(spark):
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY), (1, 0, None, None), (1, 1, "assistant", "a#b </turn>\n\\"), (1, 1, "assistant", "again"), (None, None, "user", "x")]
    table = spark.createDataFrame([(*r, "c", 7) for r in rows], "conv_id long, turn long, role string, text string, log string, since long")
    clashing = conversation_log(table).withColumn("live", F.lit("x")).withColumn("redone", F.lit(3))
    got = {r["conv_id"]: r for r in chat_digest(clashing).collect()}
    for c, g in ((-7, rows[:2]), (1, rows[2:5]), (None, rows[5:])):
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in g).encode()).hexdigest()
        loss = "".join(t or "" for _, _, r, t in g if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    log = [(1, 0, 0, 0, "open", "user", ""), (1, 0, 0, 1, "delta", "user", "hi"), (1, 1, 0, 2, "delta", "assistant", "bad"), (1, 2, 0, 3, "delta", "user", "gone"), (1, 1, 0, 4, "regenerate", "assistant", ""), (1, 1, 0, 5, "delta", "assistant", "go"), (1, 1, 0, 6, "delta", "assistant", "od"), (1, 0, 0, 7, "edit", "user", "hello")]
    events = spark.createDataFrame(log, "conv_id long, turn long, alt long, seq long, kind string, role string, payload string")
    parts = render(fold_messages(events), part_chars=1).orderBy("part").collect()
    assert [list(read_turns(p["formatted"])) for p in parts] == [[("user", "hello")], [("assistant", "good")]]
    assert chat_digest(events.limit(0)).count() == 0


def test_bin_completion():
    rng = np.random.default_rng(0)
    for cap in (10, 64):
        counts = np.bincount(rng.integers(1, cap + 1, 300), minlength=cap + 1)
        plan = packing.bin_completion(counts, cap)
        held = np.zeros(cap + 1, int)
        for pattern, times in plan:
            assert sum(pattern) <= cap
            np.add.at(held, pattern, times)
        assert (held == counts).all() and sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit_decreasing(counts, cap))
    assert packing.bin_completion(np.zeros(11, int), 10) == []


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            i = rooms.index(room)
            put(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best


def test_search_reaches_the_optimum():
    rng, better = np.random.default_rng(2), 0
    for _ in range(150):
        cap = int(rng.integers(10, 40))
        lengths = rng.integers(max(1, cap // 6), cap * 7 // 10, int(rng.integers(4, 12)))
        counts = np.bincount(lengths, minlength=cap + 1)
        got, first = (sum(t for _, t in plan) for plan in (packing.bin_completion(counts, cap), packing.best_fit_decreasing(counts, cap)))
        assert got == fewest(lengths.tolist(), cap) <= first
        better += got < first
    assert better  # the search, not best fit, found some of these


def test_pieces(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    import zlib

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    word = Tokenizer.from_file(path)
    word.encode_special_tokens = True
    want = []
    for i, t in rows_of(docs):
        ids = [*word.encode(t, add_special_tokens=False).ids, 0]
        want += [str((i, k, s, len(own := ids[s : s + 64]), zlib.crc32(np.array(own, "<u4").tobytes()))) for k, s in enumerate(range(0, len(ids), 64))]
    for share in (1 << 20, 3):
        got = packing.best_fit_packing(docs, path, capacity=64, share=share).collect()
        assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(want)
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
        for (a, at, n), (b, then, _) in zip(places, [*places[1:], (None, 0, 0)]):
            assert then == (at + n if a == b else 0) and at + n <= 64
        assert len({r["sequence_id"] for r in got}) == sum(t for _, t in packing.bin_completion(np.bincount([r["length"] for r in got], minlength=65), 64))


def test_tokenizers(spark, docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from scriptloom.llm.bpe import byte_bpe, read_ranks
    from scriptloom.llm.wordtokens import WordTokens

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    texts = [None, "", "a  b\n\nc \n d", "x\xa0  y 　z", "don't I'll 123 ４５ ﬁ", "end  ", "<|endoftext|>", "日本語 ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in byte_bpe(df, path, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    word.encode_special_tokens = True
    for _, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, n = WordTokens.shared(P.path("word_bpe_49k.json")).encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [word.encode(t or "", add_special_tokens=False).ids for t in texts]
    packed = packing.best_fit_packing(docs, P.path("word_bpe_49k.json"), capacity=64).toPandas()
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 64 and g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.best_fit_packing(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def bpe_parts():
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from scriptloom.llm.bpe import read_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def bpe_rows(enc, rows):
    return sorted((str(i), len(ids := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


def test_byte_bpe_cases(spark, docs):
    from scriptloom.llm.bpe import byte_bpe

    path, pattern, encoding = bpe_parts()
    rng = random.Random(6)
    longer = [(90 + k, "".join(rng.choice(letters) for _ in range(n)) + " tail", 1, "a", "b") for k, (n, letters) in enumerate([(255, "ab"), (256, "abcdefghij"), (257, "y"), (1000, "eé"), (8_000, "abcdefghij"), (30_000, "etaoin")])]
    table = docs.union(spark.createDataFrame(longer, DOCS))
    want = bpe_rows(encoding(pattern), rows_of(table))
    for most in (400_000, 20):  # the second begins its numbers anew all the time
        got = byte_bpe(table, path, pattern, most_words=most).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert byte_bpe(table.limit(0), path, pattern).count() == 0


def test_byte_bpe_of_100_000_bytes(spark):
    from scriptloom.llm.bpe import byte_bpe

    path, pattern, encoding = bpe_parts()
    rng = random.Random(7)
    rows = [(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))), (2, "y" * 100_000)]
    got = byte_bpe(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == bpe_rows(encoding(pattern), rows)


def test_pieces_are_stitched():
    from scriptloom.llm.bpe import Stitcher, read_ranks

    path, _, encoding = bpe_parts()
    stitcher, enc, rng = Stitcher(read_ranks(path)), encoding(r"[\s\S]+"), random.Random(8)
    for k in range(600):
        letters = ["ab", "y", "etaoin", "abcdefghijklmnopqrstuvwxyz", "-=", "é ßy", "0123456789", "yyyyyx"][k % 8]
        data = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400))).encode()
        size = rng.choice([1, 2, 3, 5, 7, 16, 31, 128])
        parts = [stitcher.encode(data[i : i + size]) for i in range(0, len(data), size)]
        want = [enc.encode_single_token(t) for t in enc.decode_tokens_bytes(enc._encode_single_piece(data))]
        assert stitcher.stitched(parts) == want


def test_classifiers(spark, docs):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + (" awful person" if k % 4 == 0 else "") + (" !!! ###" * 20 if k % 3 == 0 else "")) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), int(k % 4 == 0)) for k in range(900)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    for got, want in ((toxicity.toxicity(table, labels), lambda k: k % 4 == 0), (quality.quality(table, labels), lambda k: k % 3 != 0)):
        held = [r for r in got.collect() if r["held_out"]]
        assert len(held) > 100 and sum(r["predicted"] == want(r["doc_id"]) for r in held) / len(held) > 0.95
    for f in (toxicity.toxicity, quality.quality):
        assert f(docs, labels.limit(0)).count() == docs.count() and f(docs.limit(0), labels).count() == 0


def test_anchors_at_one_place_go_no_further(spark):
    """Only the stretches of anchors at several places are stored."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(600)
    table = spark.createDataFrame([(k, text(900) + (passage if k < 3 else "")) for k in range(12)], "r1 long, text string").withColumn("r2", F.col("r1"))
    stretches = repeats.stretches_of(repeats.anchor_rows(table, 200)).collect()
    places = {}
    for r in stretches:
        places[r["anchor"]] = places.get(r["anchor"], 0) + r["n"]
    assert places and min(places.values()) > 1
    assert {r["lo"]["r1"] for r in stretches} <= {0, 1, 2}
    assert all(r["kinds"] == sum(x["anchor"] == r["anchor"] for x in stretches) for r in stretches)


def test_byte_bpe_reads_pairs_of_bytes_and_plain_words_at_once():
    import public_tokenizers as P

    from scriptloom.llm.bpe import NO_RANK, Splitter, byte_pairs, plain_units, read_ranks, units

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = read_ranks(path)
    pairs = byte_pairs(ranks)
    pair = lambda a, b: ranks.get(bytes([a, b]), NO_RANK)
    assert all(pairs[ranks[bytes([a])] << 8 | ranks[bytes([b])]] == pair(a, b) for a in range(256) for b in range(256))
    texts = ["a", " ", " \u00e9t\u00e9 \u00d7 \u00f7a don't it's  two\n Gr\u00fc\u00dfe, x1 \u00aa \u4e2d \u0130", "\u00c3\u0083 a\u00a0b c\u0085d \u3000e", "", "\u00e9"]
    column = pa.array(texts)
    for _, data, offsets in blocks(column):
        first, owner = units(data, offsets)
        raw, found = data.tobytes(), []
        for a, b, plain in zip(first, [*first[1:], len(raw)], plain_units(data, first), strict=True):
            word = raw[a:b].decode()
            assert plain == bool(re.fullmatch(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", word))
            found.append(bool(plain))
        assert any(found) and not all(found)
    splitter = Splitter(path, P.PATTERN, 1000)
    words: list[bytes] = []
    for few in (texts[:3], texts[3:]):  # without and with rare white space
        for _, data, offsets in blocks(pa.array(few)):
            _, new, numbers, counts = splitter.split(data, offsets)
            words += new
            ends = np.cumsum(counts)
            for text, a, b in zip(few, ends - counts, ends, strict=True):
                assert [words[k] for k in numbers[a:b]] == [w.encode() for w in splitter.pattern.findall(text)]


@pytest.mark.parametrize("alone", [0, 200_000])
def test_components_join_few_edges_in_one_task(spark, monkeypatch, alone):
    from scriptloom.llm import components as module

    written = []
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or keep(df, name))
    monkeypatch.setattr(module, "ALONE", alone)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(-40, 0)] + [(rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(250)] + [(900, k) for k in range(700, 760)] + [(-99, -99)]
    want = {i: i for e in edges if e[0] != e[1] for i in e}
    while any(want[a] != want[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["id"]: r["comp"] for r in got} == want
    assert (len(written) == 1) == bool(alone)
    assert components(spark.createDataFrame(edges[-1:], "a long, b long")).count() == 0


def test_sets_with_a_common_passage_are_dealt_by_their_rarest_shingles(spark, monkeypatch):
    """Also one large class among them; no set is dealt again under products of signatures."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    passage = rng.sample(words, 40)
    texts = [rng.sample(words, 30) + passage + rng.sample(words, 30) for _ in range(60)]
    texts += [t[:k] + ["changed"] + t[k + 1 :] for t, k in zip(texts[:20], range(0, 100, 5), strict=True)]
    texts += [texts[0][:k] + ["other"] + texts[0][k + 1 :] for k in range(40, 70)]
    monkeypatch.setattr(near, "LOOK", 8)
    monkeypatch.setattr(near, "dealt_again", lambda *a: pytest.fail("dealt again"))
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for _ in range(3):
        for i, j in combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def test_linked_sets_share_a_rarest_shingle():
    rng = np.random.default_rng(3)
    for size in (5, 9, 10, 50, 333):
        x = np.sort(rng.integers(0, 1 << 40, size, dtype=np.uint64)) << np.uint64(24)
        frequent = np.sort(rng.choice(x, size // 2, replace=False)), rng.integers(4, 99, size // 2)
        most = size // 5 if size >= 5 else 0
        shorter = np.delete(x, rng.choice(size, most, replace=False))  # the least that still links
        assert 100 * len(shorter) >= 80 * len(x)
        assert np.intersect1d(near.rarest(x, frequent, 80), near.rarest(shorter, frequent, 80)).size
