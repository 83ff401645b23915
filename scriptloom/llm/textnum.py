"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_601)
#: A random number per byte; A-Z have those of a-z, white space has 0.
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE[SPACE] = 0
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[44, 46]] = True
KIND = LETTER.astype(np.uint8) + 2 * STOP.astype(np.uint8)

RATIO = 0x9E3779B97F4A7C15  # odd, so that its powers never vanish
PERIOD = 1 << 16
POWER = np.full(PERIOD, RATIO, np.uint64)
POWER[0] = 1
POWER = np.cumprod(POWER, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over 64 (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Where the words of a batch begin and end in its bytes, their hashes, and the number of words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, stops: bool = False) -> Words:
    """Words are runs of bytes other than white space 9-13 and 32; their hashes ignore the case of A-Z. With ``stops``
    a word also ends between an ASCII letter and a comma or full stop, either way round."""
    n, texts = len(data), len(offsets) - 1
    inside = ~SPACE[data]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        if stops:
            kind = KIND[data]
            first[1:] |= (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
        edges = offsets[:-1][offsets[:-1] < n]
        first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Words(data, starts, starts, np.zeros(0, np.uint64), np.zeros(texts, np.int64))
    spans = np.diff(starts, append=n)
    place = np.arange(starts[0], n) - np.repeat(starts, spans)
    if spans.max() > PERIOD:
        place &= PERIOD - 1
    hashes = np.add.reduceat(BYTE[data[starts[0] :]] * POWER[place], starts - starts[0])
    lengths = np.add.reduceat(inside[starts[0] :], starts - starts[0], dtype=np.int64)
    return Words(data, starts, starts + lengths, mix(hashes + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, offsets)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = 2_000_000):
    """(first row, bytes, offsets) of runs of texts of about ``most`` bytes together, one text at least."""
    data, offsets = text_buffers(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
