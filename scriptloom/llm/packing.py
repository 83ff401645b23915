"""Best-fit packing by bin completion: documents become token pieces, pieces share sequences with little waste.

The search runs over the histogram of piece lengths, which has at most ``capacity`` entries however large the corpus
is. Around the largest length left it enumerates undominated fillings of a sequence, repeats the chosen one as often
as the histogram allows, prunes by a bound on the total waste, and starts from best-fit decreasing as incumbent.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- search over the histogram


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns ([lengths], times): every length, longest first, goes to the open kind of sequence it fits best."""
    open_kinds: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, kind: tuple[list[int], int]) -> None:
        if room not in open_kinds:
            open_kinds[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_kinds[room].append(kind)

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ([length] * each, left // each))
                    left %= each
                if left:
                    put(capacity - left * length, ([length] * left, 1))
                    left = 0
                continue
            room = rooms[i]
            pattern, times = open_kinds[room].pop()
            if not open_kinds[room]:
                del open_kinds[room]
                rooms.pop(i)
            take = min(times, left)
            if times > take:
                put(room, (pattern, times - take))
            put(room - length, (pattern + [length], take))
            left -= take
    return [kind for kinds in open_kinds.values() for kind in kinds]


def fillings(counts: np.ndarray, room: int, most: int, limit: int, nodes: int) -> list[list[int]]:
    """Up to ``limit`` undominated fillings of ``room`` by lengths of at most ``most``, least waste first."""
    lengths = np.flatnonzero(counts[: min(room, most) + 1]).tolist()
    found: list[tuple[int, list[int]]] = []
    used: dict[int, int] = {}
    spent = 0

    def descend(room: int, upto: int, chosen: list[int]) -> bool:
        nonlocal spent
        spent += 1
        i = bisect_right(lengths, min(room, upto)) - 1
        leaf = True
        while i >= 0 and lengths[i] > 0:
            length = lengths[i]
            if used.get(length, 0) < counts[length]:
                leaf = False
                used[length] = used.get(length, 0) + 1
                done = descend(room - length, length, [*chosen, length])
                used[length] -= 1
                if done or spent > nodes or len(found) >= 4 * limit:
                    return done
            i -= 1
        if leaf:
            found.append((room, chosen))
            return room == 0 and len(found) >= limit
        return False

    descend(room, most, [])

    def dominated(waste: int, chosen: list[int]) -> bool:
        """One length, or two together, could give way to a longer one that is to be had and fits."""
        kinds = sorted(set(chosen))
        sums = [(a,) for a in kinds] + [(a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or chosen.count(a) > 1]
        for group in sums[:64]:
            low, high = sum(group) + (len(group) == 1), sum(group) + waste
            j = bisect_right(lengths, high) - 1
            while j >= 0 and lengths[j] >= low:
                if counts[lengths[j]] > chosen.count(lengths[j]):
                    return True
                j -= 1
        return False

    found.sort(key=lambda x: (x[0], len(x[1])))
    kept = [chosen for waste, chosen in found if not dominated(waste, chosen)]
    return (kept or [chosen for _, chosen in found[:1]])[:limit]


def bin_completion(counts: np.ndarray, capacity: int, limit: int = 4, nodes: int = 400, budget: int = 12_000) -> list[tuple[list[int], int]]:
    """Patterns ([lengths], times) that hold every piece of the histogram ``counts`` once.

    Depth first: each node fills a sequence around the largest length left and repeats the filling. A branch ends
    when its waste exceeds what a better result than the incumbent may waste; the search ends at the lower bound or
    after ``budget`` nodes, with the incumbent.
    """
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    incumbent = best_fit_decreasing(counts, capacity)
    bins = sum(times for _, times in incumbent)
    bound = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))

    def options(left: np.ndarray) -> tuple[int, list[list[int]]]:
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        choices = fillings(left, capacity - largest, largest, limit, nodes)
        left[largest] += 1
        return largest, choices

    spent = 0
    stack: list[list] = []  # of [left, waste, largest, choices, next choice, pattern]
    left, waste = counts, 0
    while spent < budget and bins > bound:
        spent += 1
        if left.any() and waste <= (bins - 1) * capacity - total:
            largest, choices = options(left)
            stack.append([left, waste, largest, choices, 0, None])
        else:
            if not left.any():
                plan = [frame[5] for frame in stack]
                if (n := sum(times for _, times in plan)) < bins:
                    incumbent, bins = plan, n
            while stack and stack[-1][4] >= len(stack[-1][3]):
                stack.pop()
            if not stack:
                break
        frame = stack[-1]
        left, waste, largest, choices, k, _ = frame
        pattern = [largest, *choices[k]]
        kinds, uses = np.unique(pattern, return_counts=True)
        times = int((left[kinds] // uses).min())
        frame[4], frame[5] = k + 1, (pattern, times)
        left = left.copy()
        left[kinds] -= uses * times
        waste += times * (capacity - sum(pattern))
    return incumbent


class Slots:
    """Where the piece with a given length and rank goes. Its size is bounded by the patterns, not by the corpus."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        rows = []
        base = 0
        for pattern, times in patterns:
            at = 0
            for length in pattern:
                first = taken.get(length, 0)
                rows.append((length, first, base, at))
                taken[length] = first + times
                at += length
            base += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.keys, self.first, self.base, self.at = (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (lengths << 48) + ranks, side="right") - 1
        return self.base[i] + ranks - self.first[i], self.at[i]


# -- Spark


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of PIECES; the ids of a document are its text's, then ``end_id``."""
    ready_python(df.sparkSession)

    def cut(batches):
        from scriptloom.llm.textnum import blocks
        from scriptloom.llm.wordtokens import WordTokens

        tokens, end = WordTokens.shared(tokenizer_path), int(end_id).to_bytes(4, "little")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in blocks(batch.column(1)):
                ids, counts = tokens.encode(data, offsets)
                raw, at, rows = ids.tobytes(), 0, []
                for doc_id, count in zip(names[row : row + len(counts)], counts.tolist(), strict=True):
                    own, n = raw[at : at + 4 * count] + end, count + 1
                    at += 4 * count
                    rows += [(doc_id, p, s, min(capacity, n - s), zlib.crc32(own[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, PIECES)


def best_fit_packing(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", share: int = 1 << 20, **search: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``search`` has limits of ``bin_completion``, which bound its time on the driver and leave no piece out; a task ranks
    about ``share`` pieces of one length.

    Only documents longer than ``capacity`` are cut, into pieces of that length; the last may be shorter. Null or
    empty text: one piece that holds the end id alone. Null ids stay null, repeated rows are packed each, ties in
    length are ranked by id and piece. An empty table gives no rows. Other columns are ignored.
    """
    pieces = stored(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    salts = 128 + pieces.count() // share
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    shares = stored(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "shares")
    counts = np.zeros(capacity + 1, np.int64)
    for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    slots = Slots(bin_completion(counts, capacity, **search))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    shares = shares.select("length", "salt", earlier.alias("earlier"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            sequence, offset = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", rank.cast("long")).join(shares, ["length", "salt"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("rank")).alias("rank")).mapInArrow(assign, PIECES + ", sequence_id long, offset long")
