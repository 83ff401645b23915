"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

Python stages cut texts into words and number them by task; only words that a task has not met leave it. They meet by
hash, so that each word of the table is folded once, and its ids go back to the tasks that hold it. The rank map of the
fold is a literal, laid out as a perfect hash of (left id, right id) in two arrays: a look-up costs three array reads.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python
from scriptloom.llm.textnum import LETTER, PERIOD, POWER, SPACE, blocks, mix

NO_RANK = 1 << 30
SLOT_BITS, BUCKET_BITS = 18, 16
#: Bytes of a word that is folded whole, and of the pieces of longer ones: a fold takes n steps of up to n elements.
LONG, PIECE = 256, 128
#: White space as Unicode has it; the pattern's \s is written out, as engines differ in it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes that continue 0xC3 to a letter: the letters of Latin-1.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
_EXACT = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacement of each bucket, key of each slot, rank of each slot). A key is left id * 65,536 + right id for
    each way to put a token together from two; its slot comes from Spark's xxhash64 of it."""
    import xxhash

    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs[left << 16 | right] = rank
    bits = SLOT_BITS
    while len(pairs) > 0.6 * (1 << bits):
        bits += 1
    slots, buckets = 1 << bits, [[] for _ in range(1 << BUCKET_BITS)]
    for key in pairs:
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        buckets[h & ((1 << BUCKET_BITS) - 1)].append((h >> 20 & (slots - 1), key))
    shift = np.zeros(1 << BUCKET_BITS, np.int64)
    keys, values = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    taken = bytearray(slots)
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        own = [f for f, _ in buckets[b]]
        if len(set(own)) < len(own):
            raise ValueError("two pairs of a bucket share their hash")
        d = next(d for d in range(slots) if not any(taken[(f + d) & (slots - 1)] for f in own))
        shift[b] = d
        for f, key in buckets[b]:
            at = (f + d) & (slots - 1)
            taken[at], keys[at], values[at] = 1, key, pairs[key]
    return shift, keys, values


def literal(values: np.ndarray, kind: str) -> Column:
    """An array literal; the optimizer folds the text into it once."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The literal (shifts, keys, ranks) of ``merge_table``; bound once, however often the fold looks ranks up."""
    return F.struct(*(literal(x, kind).alias(name) for x, kind, name in zip(table, ("int", "bigint", "int"), ("shifts", "keys", "ranks"), strict=True)))


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray | None:
    """The rank of each pair of bytes, at left id * 256 + right id; None where the ids of bytes are not the least 256."""
    if sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)):
        return None
    out = np.full(1 << 16, NO_RANK, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            out[ranks[token[:1]] << 8 | ranks[token[1:]]] = rank
    return out


def fold_merges(symbols: Column, table: Column, slots: int, firsts: Column | None = None) -> Column:
    """The ids of a word from the ids of its bytes: the leftmost pair of least rank is merged until none has a rank.

    The state has the ids and the rank of each neighbouring pair; a merge looks up the two new pairs only. With ``firsts``
    (``byte_pairs``) the pairs of bytes cost one array read each."""
    shifts, own, ranked = table["shifts"], table["keys"], table["ranks"]
    none, unranked = F.array().cast("array<int>"), F.lit(NO_RANK)

    def rank(left: Column, right: Column) -> Column:
        key = left.cast("long") * 65_536 + right
        slot = lambda h: (F.shiftrightunsigned(h, 20).bitwiseAND(slots - 1) + F.get(shifts, h.bitwiseAND((1 << BUCKET_BITS) - 1).cast("int"))).bitwiseAND(slots - 1).cast("int")
        at = bind(F.xxhash64(key), slot)
        return bind(at, lambda k: F.when(F.get(own, k) == key, F.get(ranked, k)).otherwise(unranked))

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]

            def put(p: Column) -> Column:
                left = F.when(p > 1, F.array(rank(F.get(ids, p - 2), least))).otherwise(none)
                right = F.when(p < F.size(ranks), F.array(rank(least, F.get(ids, p + 1)))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(ids, F.lit(1), p - 1), F.array(least), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, F.size(ids))).alias("ranks"),
                )

            return F.when(least >= NO_RANK, state).otherwise(bind(F.array_position(ranks, least).cast("int"), put))

        return F.when(F.size(state["ranks"]) == 0, state).otherwise(bind(F.array_min(state["ranks"]), at))

    first = rank if firsts is None else lambda left, right: F.get(firsts, left * 256 + right)
    pairs = F.zip_with(F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1), first)
    start = F.struct(symbols.alias("ids"), pairs.alias("ranks"))
    return F.when(F.size(symbols) < 2, symbols).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(symbols)), start, merge)["ids"])


class Stitcher:
    """Puts together the ids of a long word's pieces. A run of tokens is the encoding of its bytes if each two neighbours
    are the encoding of theirs (merges go by rank, and the first to cross an edge would cross it between the two alone),
    so tokens are made anew around an edge only, as far as they do not fit their neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pieces, self.fitting = ranks, {r: t for t, r in ranks.items()}, {}

    def encode(self, data: bytes) -> list[int]:
        """Merges from a heap, for the few bytes about an edge."""
        n, get = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:  # one of the two has been merged since
                continue
            end[i], end[j], after[i] = to, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(data[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if (k := before[i]) >= 0 and (r := get(data[k:to])) is not None:
                heapq.heappush(heap, (r, k, to))
        return [self.ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def fit(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.fitting:
            self.fitting[key] = self.encode(self.pieces[left] + self.pieces[right]) == [left, right]
        return self.fitting[key]

    def stitched(self, parts: list[list[int]]) -> list[int]:
        out: list[int] = []
        for part in parts:
            width = 4
            while out and part and not self.fit(out[-1], part[0]):
                a, b = max(0, len(out) - width), min(len(part), width)
                middle = self.encode(b"".join([self.pieces[i] for i in out[a:] + part[:b]]))
                if (a == 0 or self.fit(out[a - 1], middle[0])) and (b == len(part) or self.fit(middle[-1], part[b])):
                    out[a:], part = middle, part[b:]
                    break
                width *= 2
            out += part
        return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each unit, text of each unit). Units cut the bytes where the pattern always does: a word takes
    one space before it; of other white space before a word the last character stands alone; the end's is whole."""
    n = len(data)
    space = SPACE[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    prev_space = np.concatenate([[False], space[:-1]]) & ~begins
    word = ~space & (begins | prev_space)  # a run of other characters begins
    run = space & (begins | ~np.concatenate([[False], space[:-1]]))  # a run of white space begins
    starts = run | (word & begins)
    at = np.flatnonzero(word & prev_space)
    last = at - 1  # the white space before a word
    starts[last] = True
    starts[at[data[last] != 32]] = True
    first = np.flatnonzero(starts)
    return first, owner[first]


def plain_units(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each unit has letters of Latin-1 only, but for one space before them."""
    letter = LETTER[data]
    pair = (data[:-1] == 0xC3) & LATIN[data[1:]]
    letter[:-1] |= pair
    letter[1:] |= pair
    spaced = data[first] == 32
    spans = np.diff(first, append=len(data))
    letter[first[spaced]] = True
    return np.logical_and.reduceat(letter, first) & (spans > spaced)


class Splitter:
    """Numbers the words of a task's texts; knows units by a 64-bit hash. Of a word of more than LONG bytes the pieces get
    numbers too, and ``long`` has them by the word's."""

    def __init__(self, ranks_path: str, pattern: str, most: int):
        import regex

        self.ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"(?!\S)", rf"(?![^{WHITE}])").replace(r"\s+", rf"[{WHITE}]+"))
        self.letters = r"| ?\p{L}+|" in pattern  # such a run is a word by itself
        self.odd = regex.compile(f"[{WHITE[5:]}]")
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.long: dict[int, list[int]] = {}
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def number(self, text: str, new: list[bytes]) -> list[int]:
        out = []
        for piece in self.pattern.findall(text):
            word = piece.encode()
            k = self.words.get(word)
            if k is None:
                k = self._new(word, new)
            out.append(k)
        return out

    def _new(self, word: bytes, new: list[bytes]) -> int:
        k = self.words[word] = len(self.words)
        new.append(word if len(word) <= LONG else word[:1])  # what stands for a long word is folded for nothing
        if len(word) > LONG:
            pieces = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
            self.long[k] = [self.words[p] if p in self.words else self._new(p, new) for p in pieces]
        return k

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[bool, list[bytes], np.ndarray, np.ndarray]:
        """(whether numbers begin anew, new words, word numbers of all texts, words of each text)."""
        texts, anew = len(offsets) - 1, len(self.words) > self.most
        if anew:
            self.forget()
        new: list[bytes] = []
        raw = data.tobytes()
        lead, after = data[:-1], data[1:]
        may = (lead == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (lead >= 0xE1) & (lead <= 0xE3)  # how such characters begin
        if may.any() and self.odd.search(raw.decode()):  # rare white space: text by text
            lists = [self.number(raw[a:b].decode(), new) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return anew, new, np.fromiter(itertools.chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists])
        if not len(data):
            return anew, new, np.zeros(0, np.int32), np.zeros(texts, np.int64)
        first, owner = units(data, offsets)
        spans = np.diff(first, append=len(data))
        place = (np.arange(len(data)) - np.repeat(first, spans)) & (PERIOD - 1)
        hashes = mix(np.add.reduceat(_EXACT[data] * POWER[place], first) + spans.astype(np.uint64))
        distinct, seen, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        fresh[inside] = self.hashes[at[inside]] != distinct[inside]
        if fresh.any():
            where = seen[fresh]
            plain = plain_units(data, first)[where] if self.letters else np.zeros(len(where), bool)
            cuts = zip(plain.tolist(), first[where].tolist(), (first + spans)[where].tolist(), strict=True)
            get, lists = self.words.get, []
            for p, a, b in cuts:
                if p:
                    k = get(word := raw[a:b])
                    lists.append([self._new(word, new) if k is None else k])
                else:
                    lists.append(self.number(raw[a:b].decode(), new))
            lengths = np.array([len(x) for x in lists])
            slots = len(self.length) + np.arange(len(lists))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.int32)])
            self.hashes, self.slots = np.insert(self.hashes, at[fresh], distinct[fresh]), np.insert(self.slots, at[fresh], slots)
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slots[at][which]
        lengths = self.length[slot]
        ends = np.cumsum(lengths)
        numbers = self.flat[np.repeat(self.first[slot] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return anew, new, numbers, np.bincount(owner, lengths, texts).astype(np.int64)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte, as zstd."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def widened(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def copied(pool: np.ndarray, place: np.ndarray, spans: np.ndarray, some: int = 1 << 15) -> np.ndarray:
    """The parts of ``pool`` that begin at ``place``, one after the other."""
    out = [np.zeros(0, np.uint8)]
    for i in range(0, len(place), some):
        n = spans[i : i + some]
        ends = np.cumsum(n)
        out.append(pool[np.repeat(place[i : i + some] - (ends - n), n) + np.arange(ends[-1])])
    return np.concatenate(out)


def _table(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)], names=names)


def numbered_texts(texts: DataFrame, ranks_path: str, pattern: str, buckets: int, most: int) -> DataFrame:
    """Rows (key, block, names, numbers, counts, long, words, lengths). A block is what a task numbers together. One kind, its
    key the block's, has texts: their names, the numbers of their words, the words of each, the pieces of new long words. The other, its key a bucket
    of words, has words that the block has not held before, with their numbers. A task that runs again over the same
    rows names its blocks the same way."""
    names = ["key", "block", "names", "numbers", "counts", "long", "words", "lengths"]
    types = (pa.int64(), pa.int64(), *[pa.binary()] * 6)

    def run(batches):
        splitter = Splitter(ranks_path, pattern, most)
        block, told, begun = 0, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, offsets in blocks(batch.column(1)):
                anew, new, numbers, counts = splitter.split(data, offsets)
                if anew or not begun:
                    begun, told = begun + 1, 0
                    named = f"{TaskContext.get().partitionId()} {begun} {ids[row : row + len(counts)]}".encode()
                    block = int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=7, key=hashlib.sha256(named).digest()).digest(), "little")
                rows = [(block + buckets, block, pickle.dumps(ids[row : row + len(counts)]), squeezed(numbers), squeezed(counts), pickle.dumps(splitter.long), None, None)]
                splitter.long = {}
                lengths = np.array([len(w) for w in new], np.int64)
                flat = np.frombuffer(b"".join(new), np.uint8)
                first = np.cumsum(lengths) - lengths
                place = (np.arange(len(flat)) - np.repeat(first, lengths)) & (PERIOD - 1)
                hashes = mix(np.add.reduceat(_EXACT[flat] * POWER[place], first) + lengths.astype(np.uint64)) if new else np.zeros(0, np.uint64)
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[b] : cuts[b + 1]]
                    rows.append((b, block, None, squeezed(told + own), None, None, pa.compress(b"".join([new[k] for k in own.tolist()]), codec="zstd", asbytes=True), squeezed(lengths[own])))
                told += len(new)
                yield _table(rows, types, names)

    return texts.mapInArrow(run, ", ".join(f"{c} long" if k < 2 else f"{c} binary" for k, c in enumerate(names)))


def gathered_words(packs: DataFrame, ranks_path: str, most: int) -> DataFrame:
    """(anew, block, numbers, places, words) of the word rows: the ids of the bytes of words that the task has not met
    before, and where in all of its words each of the block's stands."""

    def run(batches):
        ranks = read_ranks(ranks_path)
        byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        known: dict[bytes, int] = {}
        for batch in batches:
            for block, numbers, words, lengths in zip(*(batch.column(k).to_pylist() for k in (1, 3, 6, 7)), strict=True):
                if words is None:
                    continue
                anew = len(known) > most
                if anew:
                    known = {}
                ends = np.cumsum(widened(lengths))
                data = pa.decompress(words, int(ends[-1]), codec="zstd", asbytes=True)
                own = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                at = len(known)
                places = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
                new = list(itertools.islice(known, at, None))
                sizes = np.fromiter(map(len, new), np.int64, len(new))
                symbols = byte[np.frombuffer(b"".join(new), np.uint8)]
                first, kept = np.cumsum(sizes) - sizes, np.ones(len(symbols), bool)
                for k in [k for k, w in enumerate(new) if w in ranks]:  # a word that is a token needs no merge
                    symbols[first[k]] = ranks[new[k]]
                    kept[first[k] + 1 : first[k] + sizes[k]] = False
                    sizes[k] = 1
                symbols = symbols[kept]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(symbols))
                nested = pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), lists)
                yield pa.RecordBatch.from_arrays([pa.array([anew]), pa.array([block]), pa.array([numbers], pa.binary()), pa.array([squeezed(places)], pa.binary()), nested], names=["anew", "block", "numbers", "places", "words"])

    return packs.mapInArrow(run, "anew boolean, block long, numbers binary, places binary, words array<array<int>>")


def dealt_ids(folded: DataFrame) -> DataFrame:
    """(block, numbers, lengths, ids): the folded ids of a block's words."""

    def run(batches):
        first, length, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                words = batch.column(4).slice(k, 1).flatten()  # one list of ids per word
                if batch.column(0)[k].as_py():
                    first, length, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                sizes = np.diff(words.offsets.to_numpy()) if len(words) else np.zeros(0, np.int64)
                first = np.concatenate([first, len(flat) + np.cumsum(sizes) - sizes])
                length = np.concatenate([length, sizes])
                flat = np.concatenate([flat, words.flatten().to_numpy().astype(np.int64)])
                places = widened(batch.column(3)[k].as_py())
                lengths = length[places]
                ends = np.cumsum(lengths)
                ids = flat[np.repeat(first[places] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
                rows.append((batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), squeezed(lengths), squeezed(ids)))
            yield _table(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), ["block", "numbers", "lengths", "ids"])

    return folded.mapInArrow(run, "block long, numbers binary, lengths binary, ids binary")


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 400_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256.

    Null or empty text: no token. Special tokens are ordinary text. Rows are independent, so repeated rows give equal
    rows; a null id stays null; an empty table gives no rows; other columns are ignored. A task knows at most about
    ``most_words`` words and then begins anew. Words of any length are encoded whole; long ones are folded in pieces.
    """
    spark = df.sparkSession
    ready_python(spark)
    ranks = read_ranks(ranks_path)
    table, firsts = merge_table(ranks), byte_pairs(ranks)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        """Texts of one block and the ids of its words; rows of a bucket of words alone give nothing."""
        ranks = read_ranks(ranks_path) if len(words) else {}
        known = [tuple(map(widened, row)) for row in zip(*(words.column(c).to_pylist() for c in ("numbers", "lengths", "ids")), strict=True)]
        ids = np.concatenate([np.zeros(0, np.int64), *(k[2] for k in known)])
        of, lengths = (np.concatenate([np.zeros(0, np.int64), *(k[i] for k in known)]) for i in (0, 1))
        size = int(of.max(initial=-1)) + 1
        count, first = np.full(size, -1), np.zeros(size, np.int64)
        count[of], first[of] = lengths, np.cumsum(lengths) - lengths
        if long := {k: v for own in texts.column("long").to_pylist() if own is not None for k, v in pickle.loads(own).items()}:
            stitcher, more, at = Stitcher(ranks), [ids], len(ids)
            for k, parts in long.items():
                more.append(np.array(stitcher.stitched([ids[first[p] : first[p] + count[p]].tolist() for p in parts]), np.int64))
                first[k], count[k] = at, len(more[-1])
                at += len(more[-1])
            ids = np.concatenate(more)
        pools = []  # of the words' ids as decimals, a space behind each, and of their bytes
        tokens = sorted(ranks, key=ranks.get)
        for pieces in ([b"%d " % ranks[t] for t in tokens], tokens):
            place, spans = np.zeros(max(ranks.values(), default=0) + 1, np.int64), np.zeros(max(ranks.values(), default=0) + 1, np.int64)
            own = np.fromiter(map(len, pieces), np.int64, len(pieces))
            place[[ranks[t] for t in tokens]], spans[[ranks[t] for t in tokens]] = np.cumsum(own) - own, own
            ends = np.concatenate([[0], np.cumsum(spans[ids])])
            pools.append((copied(np.frombuffer(b"".join(pieces), np.uint8), place[ids], spans[ids]), ends[first], ends[first + np.maximum(count, 0)] - ends[first]))
        rows = []
        for of, numbers, counts in zip(*(texts.column(c).to_pylist() for c in ("names", "numbers", "counts")), strict=True):
            if of is None:
                continue
            numbers, edges = widened(numbers), np.concatenate([[0], np.cumsum(widened(counts))])
            if len(numbers) and (numbers.max() >= size or count[numbers].min() < 0):
                raise RuntimeError("a block's words have no ids: its texts were read anew in another order")
            tokens_to = np.concatenate([[0], np.cumsum(count[numbers])])[edges]
            digests = []
            for k, (pool, place, spans) in enumerate(pools):
                ends = np.concatenate([[0], np.cumsum(spans[numbers])])[edges].tolist()
                data = memoryview(copied(pool, place[numbers], spans[numbers]))
                digests.append([hashlib.sha256(data[a : max(a, b - 1) if k == 0 else b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)])
            rows += zip(pickle.loads(of), np.diff(tokens_to).tolist(), *digests, strict=True)
        return pa.Table.from_batches([_table(rows, types, names)])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one exchange serves both: it brings words together and puts a block's texts where its ids will come
    dealt = numbered_texts(texts, ranks_path, pattern, buckets, most_words).repartition(buckets, "key")
    folded_by = lambda f: bind(rank_map(table), lambda t: F.transform("words", lambda w: fold_merges(w, t, len(table[1]), f)))
    fold = folded_by(None) if firsts is None else bind(literal(firsts, "int"), folded_by)
    folded = gathered_words(dealt, ranks_path, most_words).withColumn("words", fold)
    ids = dealt_ids(folded).withColumn("key", F.col("block") + buckets).repartition(buckets, "key")
    both = dealt.groupBy("key").cogroup(ids.groupBy("key"))
    return both.applyInArrow(join, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
