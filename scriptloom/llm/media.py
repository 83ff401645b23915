"""Media columns: payloads kept losslessly as AVI motion-JPEG, read back, and cut into timed clips.

A frame is a 24 x 24 image of 8-bit grey samples, coded by itself as a lossless JPEG (SOF3, left-neighbour
prediction). Its Huffman table gives the difference category s a code of 9 - s bits, so that every difference takes 9
bits in all and frames are packed and unpacked as arrays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python

SIDE = 24
FRAME = SIDE * SIDE
FPS = 24
WIDTH = 9  # bits of a coded difference
BLOCK = 4096  # frames handled at once

HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
)
TAIL = b"\xff\xd9"


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Category -> (code, its bits), canonically assigned."""
    codes, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            codes[symbol] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return codes


def difference_tables(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(difference + 255 -> coded word, coded word -> difference) for tables whose words are all WIDTH bits long."""
    write, read = np.zeros(511, np.uint16), np.zeros(1 << WIDTH, np.int16)
    codes = huffman_codes(counts, symbols)
    if any(bits + s != WIDTH for s, (_, bits) in codes.items()):
        raise ValueError("only Huffman tables with words of one width are read")
    for d in range(-255, 256):
        s = abs(d).bit_length()
        word = codes[s][0] << s | (d if d >= 0 else d + (1 << s) - 1)
        write[d + 255], read[word] = word, d
    return write, read


WRITE, _ = difference_tables(bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))


def encode_frames(pixels: np.ndarray) -> list[bytes]:
    """JPEG files of (n, FRAME) samples."""
    out: list[bytes] = []
    for i in range(0, len(pixels), BLOCK):
        x = pixels[i : i + BLOCK].reshape(-1, SIDE, SIDE).astype(np.int16)
        d = x.copy()
        d[:, :, 1:] -= x[:, :, :-1]
        d[:, 1:, 0] -= x[:, :-1, 0]
        d[:, 0, 0] -= 128
        words = WRITE[d.reshape(len(x), FRAME // 8, 8) + 255]
        packed = np.zeros((len(x), FRAME // 8, WIDTH), np.uint8)
        for k in range(8):
            packed[:, :, k] |= (words[:, :, k] >> (k + 1)).astype(np.uint8)
            packed[:, :, k + 1] |= (words[:, :, k] << (7 - k) & 0xFF).astype(np.uint8)
        rows = packed.reshape(len(x), -1)
        out += [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + TAIL for row in rows]
    return out


def parse_head(jpeg: bytes) -> tuple[int, np.ndarray]:
    """(where the scan data begins, coded word -> difference) of a lossless frame."""
    at, table = 2, None
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if marker == 0xC4:
            counts = jpeg[at + 5 : at + 21]
            table = difference_tables(counts, jpeg[at + 21 : at + 21 + sum(counts)])[1]
        elif marker == 0xC3 and struct.unpack_from(">BHHB", jpeg, at + 4) != (8, SIDE, SIDE, 1):
            raise ValueError("not a grey frame of the expected size")
        at += 2 + size
        if marker == 0xDA:
            return at, table


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """(n, FRAME) samples; every frame is decoded from its own data alone."""
    out = np.empty((len(jpegs), FRAME), np.uint8)
    alike: dict[bytes, list[int]] = {}  # frames by their heads, which have the Huffman tables
    for i, jpeg in enumerate(jpegs):
        alike.setdefault(jpeg[: parse_end(jpeg)], []).append(i)
    for head, frames in alike.items():
        at, table = parse_head(head)
        for i in range(0, len(frames), BLOCK):
            part = frames[i : i + BLOCK]
            out[part] = decode_scans([jpegs[k][at:-2].replace(b"\xff\x00", b"\xff") for k in part], table)
    return out


def parse_end(jpeg: bytes) -> int:
    """Where the scan data begins."""
    if jpeg.startswith(HEAD):
        return len(HEAD)
    return parse_head(jpeg)[0]


def decode_scans(scans: list[bytes], table: np.ndarray) -> np.ndarray:
    """Samples of frames that share a table of coded words."""
    b = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), FRAME // 8, WIDTH).astype(np.uint16)
    d = np.empty((len(scans), FRAME // 8, 8), np.int16)
    for k in range(8):
        d[:, :, k] = table[((b[:, :, k] << 8 | b[:, :, k + 1]) >> (7 - k)) & 0x1FF]
    d = d.reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).reshape(len(scans), FRAME).astype(np.uint8)


def chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(jpegs: list[bytes]) -> bytes:
    n, most = len(jpegs), max(map(len, jpegs))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", image)))
    sizes = np.fromiter(map(len, jpegs), np.int64, n)
    steps = 8 + sizes + sizes % 2
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.cumsum(steps) - steps, sizes
    movie = b"".join([p for j in jpegs for p in (b"00dc", len(j).to_bytes(4, "little"), j, b"\0" if len(j) % 2 else b"")])
    body = b"AVI " + head + chunk(b"LIST", b"movi" + movie) + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", body)


def read_avi(data: bytes) -> list[bytes]:
    """The frames that the RIFF index lists, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index = 12, None, None
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif tag == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movie is None or index is None:
        raise ValueError("no movie list or no index")
    starts = (movie + index[:, 2].astype(np.int64) + 8).tolist()
    return [data[s : s + n] for s, n in zip(starts, index[:, 3].tolist(), strict=True)]


def cuts(frames: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.3) -> np.ndarray:
    """Frames that begin a shot: the 16-bin histogram differs from the one before by at least ``least`` (of 1) and by
    more than ``factor`` deviations above the mean difference of up to ``window`` frames on either side."""
    n = len(frames)
    if n < 2:
        return np.zeros(0, np.int64)
    bins = (frames >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * FRAME)
    low = np.maximum(np.arange(n - 1) - window, 0)
    high = np.minimum(np.arange(n - 1) + window + 1, n - 1)
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    others = np.maximum(high - low - 1, 1)
    mean = (s1[high] - s1[low] - d) / others
    spread = np.sqrt(np.maximum((s2[high] - s2[low] - d * d) / others - mean * mean, 0))
    return np.flatnonzero((d >= least) & (d > mean + factor * spread)) + 1


def clips(frames: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start, end in seconds)."""
    edges = [0, *cuts(frames).tolist(), len(frames)]
    return [(k, a, b - a, a / FPS, b / FPS) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text in UTF-8, those bytes with 255 up to a positive multiple of FRAME)."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def _over_texts(df: DataFrame, id_col: str, text_col: str, schema: str, names: list[str], types: list, rows_of) -> DataFrame:
    ready_python(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(i, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): the texts as AVI files. Null text is empty; each row gives one row."""

    def rows(i, t):
        n, payload = payload_of(t)
        yield i, n, write_avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))

    return _over_texts(df, id_col, text_col, "doc_id long, n_bytes long, media binary", ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], rows)


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, n_frames, start_s, end_s) of a column ``media`` of AVI files."""

    def run(batches):
        for batch in batches:
            rows = [(i, *c) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in clips(decode_frames(read_avi(m)))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    ready_python(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, clip int, first_frame long, n_frames long, start_s double, end_s double")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, from the stored bytes as read back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (the frames, and the clips by their first and last second).

    Null or empty text: one frame of 255. Rows are independent, so ties and repeats give equal rows; a null id stays
    null; an empty table gives no rows; other columns are ignored.
    """

    def rows(i, t):
        n, payload = payload_of(t)
        media = write_avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))
        frames = decode_frames(read_avi(media))
        back = frames.tobytes()
        feature = f"frames={len(frames)};clips={','.join(f'{start:.3f}-{end:.3f}' for _, _, _, start, end in clips(frames))}"
        yield i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    types = [pa.int64() if k == "long" else pa.string() for k in kinds]
    return _over_texts(df, id_col, text_col, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), names, types, rows)
