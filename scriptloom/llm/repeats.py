"""Repeated passages by suffix arrays: every byte covered by a long enough string that starts anywhere else goes.

1. A window of ``length`` bytes picks, of the ``length`` / 3 -byte strings in it, the one of least hash: its anchor. Equal
   windows pick anchors of equal content, so windows can only be equal around anchors of one hash.
2. The stretch of an anchor holds the windows that pick it. Equal stretches are collapsed to two places, the least and
   the largest, before any bytes move. Only anchors with two places or more go on.
3. The bytes of these places meet in blocks, neighbouring ones of a text as one segment, and are put into suffix arrays
   by two-stage sorting. Suffixes next to each other whose common prefix is long enough mark windows. A stretch that is
   found repeated as a whole between its two places is so at its further places too.
4. An anchor with too many different stretches for one block is split by the next bytes: its windows fall into two
   halves by where they begin, each half shares more bytes with the anchor, and these bytes are the new key. The
   narrowest half is one window, so every group comes down to a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import drop, noted, ready_python, stored
from scriptloom.llm.textnum import blocks, mix

_RNG = np.random.default_rng(11)
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
RATIO = 0xC6A4A7935BD1E995
INVERSE = pow(RATIO, -1, 2**64)
SLICE = 1 << 20
PLACES = np.uint64((1 << 21) - 1)
#: Bytes that are sorted together, about.
SORTED = 400_000
#: Bytes of an anchor's segments that one block takes; the segments of more are split.
BLOCK = 1_000_000
#: Bytes of an anchor's segments that may share a block with the other anchors of its region.
FEW = 4_000
#: Bytes of a text whose anchors share a block.
REGION = 32_768
#: Suffixes whose tails are compared at once.
TIED = 50_000


def _powers(ratio: int, n: int) -> np.ndarray:
    p = np.full(n, ratio, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


POWERS, INVERSES = _powers(RATIO, (1 << 21) + 1), _powers(INVERSE, (1 << 21) + 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * POWERS[: len(data)], dtype=np.uint64)])


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * INVERSES[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, bytes before, bytes after, anchor hash, stretch hash) of the texts' anchors; places count from the
    text's first byte, "after" from the anchor's."""
    k = length // 3
    span = length - k + 1
    n = len(data)
    sizes = np.diff(offsets)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.int64),) * 2
    sums = prefix_sums(data)
    at = np.arange(n - k + 1)
    value = (range_hash(sums, at, at + k) & ~PLACES) | at.astype(np.uint64)
    least, width = value, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][owner[: len(least)]])
    place, first = np.unique((least[starts] & PLACES).astype(np.int64), return_index=True)
    last = np.append(first[1:], len(starts)) - 1  # leftmost least values never move back
    text = owner[place]
    left, right = starts[first], starts[last] + length
    before, after = place - left, right - place
    stretch = mix(range_hash(sums, left, right) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, place - offsets[:-1][text], before, after, range_hash(sums, place, place + k).astype(np.int64), stretch.astype(np.int64)


def packed_anchors(row: np.ndarray, found: tuple[np.ndarray, ...], r1: np.ndarray, r2: np.ndarray) -> pa.RecordBatch:
    """One row per distinct stretch of a block of texts: how often it stands there, its least place and, where there are
    several, its largest and all of them as runs (r1, r2, first place, places)."""
    place, before, after, anchor, stretch = found
    one, two = r1[row], r2[row]
    order = np.lexsort((place, two, one, stretch, anchor))
    one, two, place, before, after, anchor, stretch = (x[order] for x in (one, two, place, before, after, anchor, stretch))
    new = np.ones(len(one), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
    run = new.copy()
    run[1:] |= (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (place[1:] != place[:-1] + 1)
    first, runs = np.flatnonzero(new), np.flatnonzero(run)
    last = np.append(first[1:], len(one)) - 1
    places = np.stack([one[runs], two[runs], place[runs], np.diff(runs, append=len(one))], axis=1).astype("<i8")
    edges = np.searchsorted(runs, np.append(first, len(one)))
    as_met = np.argsort(order[first])  # in the order of the texts, in which a file of them is smallest
    first, last = first[as_met], last[as_met]
    alone = last == first
    more = [None if a is None else places[a:b].tobytes() for a, b in zip(*(np.where(alone, None, e[as_met]) for e in (edges[:-1], edges[1:])), strict=True)]
    block = np.full(len(first), r1[row[0]], np.int64)
    columns = [block, anchor[first], stretch[first], before[first].astype(np.int32), after[first].astype(np.int32), last - first + 1, one[first], two[first], place[first]]
    largest = [pa.array(x[last], mask=alone) for x in (one, two, place)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *largest, pa.array(more, pa.binary())], names=ROWS.names)


class ROWS:
    """The columns of packed anchors."""

    names = ["block", "anchor", "stretch", "before", "after", "n", "r1", "r2", "place", "last1", "last2", "last_place", "more"]
    schema = ", ".join(f"{c} {'int' if c in ('before', 'after') else 'binary' if c == 'more' else 'long'}" for c in names)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """The packed anchors of rows (r1, r2, text). A long text is taken in slices that overlap, so that every window lies
    in one."""

    def run(batches):
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in blocks(batch.column(2), SLICE):
                if len(offsets) == 2 and len(data) > SLICE:
                    for low in range(0, len(data), SLICE // 2):
                        high = min(len(data), low + SLICE // 2 + length - 1)
                        text, place, *rest = anchors(data[low:high], np.array([0, high - low]), length)
                        if len(text):
                            yield packed_anchors(row + text, (place + low, *rest), r1, r2)
                else:
                    text, *rest = anchors(data, offsets, length)
                    if len(text):
                        yield packed_anchors(row + text, tuple(rest), r1, r2)

    return docs.select("r1", "r2", "text").mapInArrow(run, ROWS.schema)


def heads(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    x = np.concatenate([t, np.zeros(7, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    return x


def sorted_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at``, which must fall, by the ``depth`` bytes from each on: by eight bytes, then ties by five more at
    a time, then what is tied still by all the rest. Of equal ones that end the data the shorter comes first."""
    if not len(at):
        return at
    head = heads(np.concatenate([t, np.zeros(depth, np.uint8)]))
    order = at[np.argsort(head[at], kind="stable")]
    group = np.cumsum(np.diff(head[order], prepend=head[order[:1]]) != 0)
    known = 8
    while known < depth:
        where = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(where):
            return order
        tied, of = order[where], group[where].astype(np.uint64)
        if known < 23:
            key = of << np.uint64(40) | head[tied + known] >> np.uint64(24)
            by = np.argsort(key, kind="stable")
            order[where] = tied[by]
            key = key[by]
            fresh = np.zeros(len(order), bool)
            fresh[where] = np.diff(key, prepend=key[:1]) != 0
            group = np.cumsum(fresh | (np.diff(group, prepend=0) != 0))
            known += 5
            continue
        tails = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(depth, np.uint8)]), depth - known)
        cuts = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1)))
        a = 0
        while a < len(tied):  # whole groups, as many as are compared at once
            i = max(int(np.searchsorted(cuts, a + TIED, side="right")) - 1, int(np.searchsorted(cuts, a)) + 1)
            b = int(cuts[i]) if i < len(cuts) and cuts[i] > a else len(tied)
            rows = np.empty((b - a, 8 + depth - known), np.uint8)
            rows[:, :8] = of[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)
            rows[:, 8:] = tails[tied[a:b] + known]
            order[where[a:b]] = tied[a:b][np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")]
            a = b
        return order
    return order


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes at least, by two-stage sorting.

    Those smaller than their successors are sorted directly. The others follow by a scan over the buckets of first
    bytes: a suffix greater than its successor comes, in its bucket, before those sorted and in its successor's order.
    """
    raw = np.frombuffer(data, np.uint8)
    t = raw.astype(np.int64)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.append(np.sign(t[1:] - t[:-1]), -1)  # the last suffix is greater than the empty one
    known = np.flatnonzero(step)
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0
    direct = sorted_directly(raw, np.flatnonzero(smaller)[::-1].copy(), depth)
    edges = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[-1]].append(np.array([n - 1]))  # the empty suffix comes first of all
    out = []
    for c in range(256):
        got = induced[c]
        k = 0
        while k < len(got):  # predecessors with the same byte join the bucket behind their successors
            before = got[k][got[k] > 0] - 1
            before = before[(t[before] == c)]
            if len(before):
                got.append(before)
            k += 1
        bucket = np.concatenate([*got, direct[edges[c] : edges[c + 1]]]) if got else direct[edges[c] : edges[c + 1]]
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        firsts = t[before]
        order = np.argsort(firsts, kind="stable")
        before, firsts = before[order], firsts[order]
        cuts = np.flatnonzero(np.diff(firsts, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(firsts)).tolist(), strict=False):
            induced[int(firsts[a])].append(before[a:b])
    return np.concatenate(out)


def repeated_windows(segments: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(text, first start, last start) of runs of windows in segments (text, place of the first byte, bytes) that occur
    at another place too. Segments can overlap; a window at one place counts once."""
    data = b"".join(s for _, _, s in segments)
    sizes = np.array([len(s) for _, _, s in segments])
    first = np.cumsum(sizes) - sizes
    sa = suffix_array(data, length)
    owner = np.searchsorted(first, sa, side="right") - 1
    sa, owner = (x[sizes[owner] - (sa - first[owner]) >= length] for x in (sa, owner))
    # common prefixes of neighbours, as far as they matter: the whole length or less
    head = heads(np.frombuffer(data, np.uint8))
    alike = (head[sa[:-1]] == head[sa[1:]]) & (head[sa[:-1] + length - 8] == head[sa[1:] + length - 8]) if length >= 8 else np.ones(max(len(sa) - 1, 0), bool)
    maybe = np.flatnonzero(alike)
    alike[maybe] = [data[a : a + length] == data[b : b + length] for a, b in zip(sa[maybe].tolist(), sa[maybe + 1].tolist(), strict=True)]
    rid = np.array([r for r, _, _ in segments], np.int64)[owner]
    start = np.array([p for _, p, _ in segments], np.int64)[owner] + sa - first[owner]
    run = np.cumsum(np.concatenate([[True], ~alike])) if len(sa) else np.zeros(0, np.int64)
    order = np.lexsort((start, rid, run))
    rid, start, run = rid[order], start[order], run[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (rid[1:] != rid[:-1]) | (start[1:] != start[:-1])
    rid, start, run = rid[fresh], start[fresh], run[fresh]
    many = np.isin(run, run[1:][run[1:] == run[:-1]])
    return _runs(rid[many], start[many])


def _runs(rid: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rid)) - 1
    return list(zip(rid[at].tolist(), start[at].tolist(), start[last].tolist(), strict=True)) if len(at) else []


ASK = "struct<key: long, hot: boolean, anchor: long, stretch: long, copy: int, place: long, before: int, after: int, confirm: boolean>"
SEGMENT = f"key long, hot boolean, r1 long, r2 long, copy int, low long, segment binary, asks array<{ASK}>"
FOUND = "r1 long, r2 long, low long, high long, anchor long, stretch long"


def stretches_of(rows: DataFrame) -> DataFrame:
    """One row per stretch of the packed anchors that stand at several places: its least place, its largest if it has
    several, and its anchor's bytes, kinds of stretches and least place. The rows are dealt by anchor once, and anchors
    that stand at one place go no further."""
    lo = F.struct("r1", "r2", "place")
    hi = F.when(F.col("last1").isNull(), lo).otherwise(F.struct(F.col("last1").alias("r1"), F.col("last2").alias("r2"), F.col("last_place").alias("place")))
    dealt = rows.select(*(c for c in ROWS.names if c not in ("block", "more"))).repartition("anchor")
    stretches = dealt.groupBy("anchor", "stretch", "before", "after").agg(F.sum("n").alias("n"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    stretches = stretches.withColumn("hi", F.when(F.col("n") > 1, F.col("hi")))
    stretches = stretches.withColumn("size", (F.col("before") + F.col("after")) * F.when(F.col("n") > 1, 2).otherwise(1))
    of = {"total": F.sum("n"), "bytes": F.sum("size"), "kinds": F.count(F.lit(1)), "home": F.min("lo")}
    own = Window.partitionBy("anchor")
    return stretches.select("*", *(x.over(own).alias(c) for c, x in of.items())).filter("total > 1").drop("total", "size")


def asked_for(wanted: DataFrame) -> DataFrame:
    """(r1, r2, asks): the places of which each block needs the bytes. Two places stand for all of a stretch; a repeated
    row of the table is a further copy of its text."""
    region = F.xxhash64("home.r1", "home.r2", F.floor(F.col("home.place") / REGION))
    few, large = F.col("bytes") <= FEW, F.col("bytes") > BLOCK

    def ask(rep: str, key, hot: bool, copy):
        fields = {"key": key, "hot": F.lit(hot), "anchor": F.col("anchor"), "stretch": F.col("stretch"), "copy": copy, "place": F.col(f"{rep}.place"), "before": F.col("before"), "after": F.col("after"), "confirm": F.col("n") > 2}
        return F.struct(F.col(f"{rep}.r1").alias("r1"), F.col(f"{rep}.r2").alias("r2"), F.struct(*(c.alias(k) for k, c in fields.items())).cast(ASK).alias("ask"))

    block = F.when(few, region).otherwise(F.when(large, F.xxhash64("anchor", "stretch")).otherwise(F.xxhash64("anchor")))
    again = F.when(F.col("lo") == F.col("hi"), 1).otherwise(0)
    both = F.array(ask("lo", block, False, F.lit(0)), ask("hi", block, False, again))
    none = F.array().cast(f"array<struct<r1: long, r2: long, ask: {ASK}>>")
    alone = F.when(large, none).otherwise(F.array(ask("lo", block, False, F.lit(0))))
    split = F.when(large & (F.col("kinds") > 1), F.array(ask("lo", F.xxhash64("anchor"), True, F.lit(0)))).otherwise(none)
    each = wanted.select(F.explode(F.concat(F.when(F.col("n") > 1, both).otherwise(alone), split)).alias("a")).select("a.*")
    return each.groupBy("r1", "r2").agg(F.collect_list("ask").alias("asks"))


def segments_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """SEGMENT rows: the bytes asked for, those of one text and block that touch as one segment; hot ones singly."""

    def run(batches):
        before = None
        for batch in batches:
            rows = []
            for r1, r2, text, asks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (r1, r2) == before:  # a repeated row of the table
                    continue
                before, data = (r1, r2), text.encode()
                asks.sort(key=lambda a: (a["hot"], a["key"], a["copy"], a["place"] - a["before"]))
                held: list[dict] = []
                for a in [*asks, None]:
                    if held and (a is None or a["hot"] or (a["key"], a["copy"]) != (held[0]["key"], held[0]["copy"]) or a["place"] - a["before"] > high):
                        low = held[0]["place"] - held[0]["before"]
                        rows.append((held[0]["key"], held[0]["hot"], r1, r2, held[0]["copy"], low, data[low:high], [h for h in held if h["hot"] or h["confirm"]]))
                        held = []
                    if a is not None:
                        high = max(high, a["place"] + a["after"]) if held else a["place"] + a["after"]
                        held.append(a)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SEGMENT_TYPES, strict=True)], names=["key", "hot", "r1", "r2", "copy", "low", "segment", "asks"])

    return docs.join(asked, ["r1", "r2"]).select("r1", "r2", "text", "asks").mapInArrow(run, SEGMENT)


ASK_TYPE = pa.struct([("key", pa.int64()), ("hot", pa.bool_()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("copy", pa.int32()), ("place", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("confirm", pa.bool_())])
SEGMENT_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(ASK_TYPE))


def sorted_runs(segments: DataFrame, length: int) -> DataFrame:
    """FOUND rows from suffix arrays over blocks of whole keys: the bytes that repeated windows cover (r1, r2, low, high),
    and the stretches (anchor, stretch) that were to be confirmed and are covered."""

    def found(held):
        texts: dict[tuple, int] = {}
        own = [texts.setdefault((r1, r2, copy), len(texts)) for r1, r2, copy, _, _, _ in held]
        runs = repeated_windows([(k, low, segment) for k, (_, _, _, low, segment, _) in zip(own, held, strict=True)], length)
        names = list(texts)
        out = [(*names[k][:2], a, b + length, None, None) for k, a, b in runs]
        begins = np.array([(k << 40) + a for k, a, _ in runs], np.int64)
        for k, (_, _, _, _, _, asks) in zip(own, held, strict=True):
            for ask in asks:
                first, last = ask["place"] - ask["before"], ask["place"] + ask["after"] - length
                i = int(np.searchsorted(begins, (k << 40) + first, side="right")) - 1
                if i >= 0 and runs[i][0] == k and runs[i][2] >= last:
                    out.append((None, None, None, None, ask["anchor"], ask["stretch"]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["r1", "r2", "low", "high", "anchor", "stretch"])

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for k, *rest in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if k != key and size >= SORTED:
                    yield found(held)
                    held, size = [], 0
                key = k
                held.append(rest)
                size += len(rest[4])
        if held:
            yield found(held)

    ordered = segments.select("key", "r1", "r2", "copy", "low", "segment", "asks").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, FOUND)


HALF = "key long, content long, r1 long, r2 long, copy int, place long, least int, most int, low long, segment binary, cell_low int, cell_high int"


def halves(parts: DataFrame, length: int) -> DataFrame:
    """HALF rows of such rows: windows begin ``least`` to ``most`` bytes before the anchor, those of a key ``cell_low`` to
    ``cell_high``. Either half's key is the hash of the bytes that all its windows hold."""

    def digest(*parts) -> int:
        h = hashlib.blake2b(digest_size=8)
        for p in parts:
            h.update(p if isinstance(p, bytes) else int(p).to_bytes(8, "little", signed=True))
        return int.from_bytes(h.digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            rows = []
            for key, _, r1, r2, copy, place, least, most, low, segment, cell_low, cell_high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mid = (cell_low + cell_high) // 2
                for a, b in ((cell_low, mid), (mid + 1, cell_high)):
                    near, far = max(least, a), min(most, b)
                    if near > far:
                        continue
                    own = segment[place - far - low : place - near + length - low]
                    shared = segment[place - a - low : place - b + length - low]
                    rows.append((digest(key, a, b, shared), digest(near, far, own), r1, r2, copy, place, near, far, place - far, own, a, b))
            types = [pa.binary() if c == "segment" else pa.int32() if c in ("copy", "least", "most", "cell_low", "cell_high") else pa.int64() for c in HALF_NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 12, types, strict=True)], names=HALF_NAMES)

    return parts.select(*HALF_NAMES).mapInArrow(run, HALF)


HALF_NAMES = [c.split()[0] for c in HALF.split(", ")]


def split_runs(hot: DataFrame, length: int) -> DataFrame:
    """(r1, r2, low, high) from SEGMENT rows of anchors too large for a block: halves again and again, until each key's
    different contents fit one. Equal contents are met in two places, and only one of these goes on."""
    out = hot.select("r1", "r2", "low", F.col("low").alias("high")).limit(0)
    ask = F.col("asks")[0]
    parts = hot.select("key", F.lit(0).cast("long").alias("content"), "r1", "r2", "copy", ask["place"].alias("place"), (F.lit(length) - ask["after"]).alias("least"), ask["before"].alias("most"), "low", "segment", F.lit(0).alias("cell_low"), F.lit(length - length // 3).alias("cell_high"))
    for _ in range(length.bit_length() + 1):
        if parts.isEmpty():
            break
        rows = stored(halves(parts, length), "halves")
        place = F.struct("r1", "r2", "copy", "place", "low")
        contents = rows.groupBy("key", "content").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), *(F.first(c).alias(c) for c in ("least", "most", "segment", "cell_low", "cell_high")))
        contents = stored(contents, "contents")
        kinds = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("segment")).alias("bytes"))
        sized = stored(contents.join(kinds, "key"), "kinds")
        one = lambda rep, key, confirm: F.struct(key.alias("key"), F.lit(False).alias("hot"), *(F.col(f"{rep}.{c}").alias(c) for c in ("r1", "r2", "copy", "low")), F.col("segment"), confirm.alias("asks"))
        nothing = F.array().cast(f"array<{ASK}>")
        whole = F.struct(F.lit(0), F.lit(False), F.col("key"), F.col("content"), F.lit(0), F.col("lo.place"), F.col("most"), F.lit(length) - F.col("least"), F.lit(True)).cast(ASK)
        pair = F.xxhash64("key", "content", F.lit(1))
        several = F.when(F.col("lo") != F.col("hi"), F.array(one("lo", pair, F.array(whole)), one("hi", pair, nothing)))
        block = F.when((F.col("kinds") > 1) & (F.col("bytes") <= BLOCK), F.array(one("lo", F.col("key"), nothing)))
        kind = f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in SEGMENT.split(', ', 7))}>>"
        segments = sized.select(F.explode(F.concat(*(F.coalesce(c.cast(kind), F.array().cast(kind)) for c in (several, block)))).alias("s")).select("s.*")
        found = stored(sorted_runs(segments, length), "split-runs")
        alike = found.filter("anchor is not null").select(F.col("anchor").alias("key"), F.col("stretch").alias("content"))
        copies = rows.join(alike, ["key", "content"], "left_semi").select("r1", "r2", "low", (F.col("low") + F.octet_length("segment")).alias("high"))
        out = out.union(found.filter("anchor is null").select("r1", "r2", "low", "high")).union(copies)
        parts = sized.filter((F.col("kinds") > 1) & (F.col("bytes") > BLOCK)).select("key", "content", *(F.col(f"lo.{c}").alias(c) for c in ("r1", "r2", "copy", "place")), "least", "most", F.col("lo.low").alias("low"), "segment", "cell_low", "cell_high")
    return out


def further_places(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(r1, r2, low, high) of all places of the confirmed stretches (anchor, stretch), by the blocks that packed them."""

    def run(batches):
        block, held = None, []
        for batch in batches:
            for b, *rest in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if b != block and held:
                    yield out(held)
                    held = []
                block = b
                held.append(rest)
        if held:
            yield out(held)

    def out(held):
        parts = [np.frombuffer(more, "<i8").reshape(-1, 4) if more is not None else np.array([[r1, r2, place, 1]]) for _, _, r1, r2, place, more in held]
        sizes = [len(p) for p in parts]
        p = np.concatenate(parts)
        before, after = (np.repeat([h[i] for h in held], sizes) for i in (0, 1))
        low, high = p[:, 2] - before, p[:, 2] + p[:, 3] - 1 + after
        order = np.lexsort((low, p[:, 1], p[:, 0]))
        one, two, low, high = p[order, 0], p[order, 1], low[order], high[order]
        # ranges of one text that touch are one
        text = np.cumsum((np.diff(one, prepend=one[:1]) != 0) | (np.diff(two, prepend=two[:1]) != 0))
        upto = np.maximum.accumulate(high + (text << 40)) - (text << 40)
        new = np.ones(len(low), bool)
        new[1:] = (text[1:] != text[:-1]) | (low[1:] > upto[:-1])
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (one[first], two[first], low[first], upto[np.append(first[1:], len(low)) - 1])], names=["r1", "r2", "low", "high"])

    hit = rows.join(confirmed.distinct(), ["anchor", "stretch"], "left_semi").select("block", "before", "after", "r1", "r2", "place", "more")
    return hit.repartition("block").sortWithinPartitions("block").mapInArrow(run, "r1 long, r2 long, low long, high long")


def coverage(docs: DataFrame, length: int) -> DataFrame:
    """(r1, r2, low, high): byte ranges, as they come, whose union is what repeated windows cover in rows (r1, r2, text)."""
    spark = docs.sparkSession
    with noted() as made:
        rows = stored(anchor_rows(docs, length), "anchors")
        stretches = stored(stretches_of(rows), "stretches")
        segments = stored(segments_of(docs, asked_for(stretches)), "segments")
        drop(spark, stretches)
        found = stored(sorted_runs(segments.filter("not hot"), length), "runs")
        split = split_runs(segments.filter("hot"), length)
        further = further_places(rows, found.filter("anchor is not null").select("anchor", "stretch"))
        ranges = stored(found.filter("anchor is null").select("r1", "r2", "low", "high").union(further).union(split), "ranges")
    drop(spark, *(path for path in made if path != ranges.stored_at))
    return ranges


def merged(ranges: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted(ranges, key=lambda r: r["low"]):
        if out and r["low"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["high"])
        else:
            out.append([r["low"], min(r["high"], size)])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), text (these, without
    the characters that lost a byte), and the columns named in ``carry``.

    A byte goes if it lies in a ``length``-byte string of its text that starts anywhere else, in the same text too;
    strings are judged on the input. Texts shorter than that, null and empty texts lose nothing. Rows are documents:
    a repeated row is a copy, and both lose what they share. Null ids are kept. An empty table gives no rows.
    """
    if length < 24:
        raise ValueError("a passage of 24 bytes at least is meant")
    ready_python(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [df.schema[c] for c in carry]
    names = F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("r2")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *names, *(F.col(c).alias(f"carry_{c}") for c in carry))
    spans = coverage(docs.select("r1", "r2", "text"), length).groupBy("r1", "r2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = docs.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans", *(f"carry_{c}" for c in carry))
    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "text": "string"}

    def run(batches):
        for batch in batches:
            out = []
            for t, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = t.encode()
                cut = merged(ranges or [], len(data))
                at, kept = 0, []
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                left = [*kept, data[at:]]  # each piece is decoded by itself: bytes of two cut characters never join
                out.append((len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(b"".join(left)).hexdigest(), "".join([p.decode("utf-8", "ignore") for p in left])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(batch.column(3 + k) for k in range(len(rest)))], names=[*kinds, *carry])

    return joined.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest))
