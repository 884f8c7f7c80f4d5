"""Payloads as baseline JPEG: an encoder for 8-bit samples and a parser with a DC-only luminance decoder.

Stored form: one grey sample per 8x8 block.  With the quantiser 8 for DC, a block of constant sample b has the DC
coefficient b - 128 and no AC, so the DC-only thumbnail (a pixel per block) is the payload itself, without loss.  Rows of
WIDTH blocks are restart intervals.  Payloads beyond ROWS rows are several images, one after the other.

The decoder takes any baseline (SOF0) single-scan stream: it parses the markers, removes byte stuffing, splits at restart
markers and Huffman-decodes all intervals of images with equal tables and layout in lockstep; AC symbols are decoded
and passed over, DC sums give the luminance thumbnail.

Defined results: null is empty text, of payload 192 spaces; equal texts give equal bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import text_of

WIDTH = 192
ROWS = 8191
#: Payload bytes that are coded at a time.
GROUP = 1 << 20
#: Huffman tables of the encoder: numbers of codes by length, and symbols; DC has all categories, AC the end of block.
DC_COUNTS, DC_SYMBOLS = [0, 0, 4, 4, 4] + [0] * 11, list(range(12))
AC_COUNTS, AC_SYMBOLS = [1, 1] + [0] * 14, [0x00, 0xF0]


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> code and its length, in canonical order."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    table = lambda kind, counts, symbols: _segment(0xC4, bytes([kind, *counts, *symbols]))
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0]))
        + table(0x00, DC_COUNTS, DC_SYMBOLS)
        + table(0x10, AC_COUNTS, AC_SYMBOLS)
        + _segment(0xDD, struct.pack(">H", WIDTH))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number, by difference + 255, the end-of-block code included."""
    dc, (end, end_bits) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    value, length = np.zeros(511, dtype=np.int64), np.zeros(511, dtype=np.int64)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, bits = dc[category]
        extra = diff if diff >= 0 else diff + (1 << category) - 1
        value[diff + 255] = (((code << category) | extra) << end_bits) | end
        length[diff + 255] = bits + category + end_bits
    return value, length


_VALUE, _LENGTH = _difference_codes()


def encode(images: list[bytes]) -> list[bytes]:
    """A JPEG stream for each image, whose bytes are rows of WIDTH samples."""
    pixels = np.frombuffer(b"".join(images), dtype=np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    diffs = np.diff(pixels, axis=1, prepend=0) + 255
    length = _LENGTH[diffs]
    bits = length.sum(axis=1)
    room = (bits + 7) // 8 * 8  # a row ends on a byte, filled up with ones
    flat, value = length.ravel(), _VALUE[diffs].ravel()
    starts = np.cumsum(room) - room
    at = (starts[:, None] + np.cumsum(length, axis=1) - length).ravel()
    out = np.ones(int(room.sum()), dtype=np.uint8)
    for j in range(int(flat.max())):
        on = flat > j
        out[at[on] + j] = (value[on] >> (flat[on] - 1 - j)) & 1
    coded = np.packbits(out)
    row_bytes = room // 8
    row = np.repeat(np.arange(len(room)), row_bytes)
    stuffed = coded == 0xFF
    place = np.arange(len(coded)) + np.cumsum(stuffed) - stuffed + 2 * row
    ends = np.cumsum(row_bytes)
    ends = ends + np.cumsum(stuffed)[ends - 1] + 2 * np.arange(len(room))
    stream = np.zeros(int(ends[-1]) + 2, dtype=np.uint8)
    stream[place] = coded
    counts = [len(x) // WIDTH for x in images]
    last = np.cumsum(counts) - 1
    nth = np.arange(len(room)) - np.repeat(last + 1 - counts, counts)
    marker = 0xD0 + nth % 8
    marker[last] = 0xD9
    stream[ends], stream[ends + 1] = 0xFF, marker
    data, stops = stream.tobytes(), (ends[last] + 2).tolist()
    return [_header(n) + data[a:b] for n, a, b in zip(counts, [0, *stops], stops)]


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: symbol and code length (symbol << 8 | length); 0 where there is no code."""
    out = np.zeros(1 << 16, dtype=np.int32)
    for symbol, (code, length) in _codes(list(counts), list(symbols)).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return out


def parse(stream: bytes, at: int = 0) -> tuple[dict, int]:
    """The frame that starts at ``at`` (size, layout, tables, intervals), and where it ends."""
    if stream[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quant, huff, restart, frame = at + 2, {}, {}, 0, None
    while True:
        if stream[at] != 0xFF:
            raise ValueError("no marker")
        kind = stream[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        size = struct.unpack_from(">H", stream, at + 2)[0]
        body, at = stream[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                quant[body[p] & 15] = struct.unpack_from(">H", body, p + 1)[0] if wide else body[p + 1]
                p += 129 if wide else 65
        elif kind == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                huff[body[p]] = (body[p + 1 : p + 17], body[p + 17 : p + 17 + n])
                p += 17 + n
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a baseline frame")
        elif kind == 0xDA:
            break
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    intervals, start = [], at
    while True:  # entropy-coded data up to a marker that is no restart
        at = stream.index(0xFF, at)
        following = stream[at + 1]
        if following == 0 or following == 0xFF:
            at += 2 if following == 0 else 1
        else:
            intervals.append(stream[start:at].replace(b"\xff\x00", b"\xff"))
            at += 2
            start = at
            if not 0xD0 <= following <= 0xD7:
                break
    if following != 0xD9:
        raise ValueError("more than one scan")
    single = len(frame) == 1
    h, v = (1, 1) if single else (max(c[1] for c in frame), max(c[2] for c in frame))
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    layout, coders = [], []
    for i, (name, ch, cv, _) in enumerate(frame):
        for y in range(1 if single else cv):
            for x in range(1 if single else ch):
                layout.append((i, x, y))
                coders.append((huff[tables[name] >> 4], huff[0x10 | tables[name] & 15]))
    return {"width": width, "height": height, "across": across, "down": down, "luma": (1, 1) if single else frame[0][1:3], "quant": quant[frame[0][3]], "layout": tuple(layout), "coders": tuple(coders), "restart": restart or across * down, "intervals": intervals}, at


def thumbnails(frames: list[dict]) -> list[np.ndarray]:
    """The DC-only luminance of each frame, a sample per block."""
    out: list[np.ndarray | None] = [None] * len(frames)
    alike = defaultdict(list)
    for i, f in enumerate(frames):
        alike[f["layout"], f["coders"], f["restart"]].append(i)
    for (layout, coders, restart), members in alike.items():
        made = {t: _lookup(*t) for pair in coders for t in pair}
        lanes = [x for i in members for x in frames[i]["intervals"]]
        units = np.array([min(restart, frames[i]["across"] * frames[i]["down"] - k * restart) for i in members for k in range(len(frames[i]["intervals"]))])
        lengths = np.array([len(x) + 8 for x in lanes])
        data = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes), dtype=np.uint8).astype(np.int64)
        window = np.zeros(len(data), dtype=np.int64)  # 32 bits from each byte on
        window[:-3] = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        bit = (np.cumsum(lengths) - lengths) * 8
        final = np.cumsum(lengths) * 8 - 32
        luma = sum(c == 0 for c, _, _ in layout)
        found = np.zeros((len(lanes), int(units.max()), luma), dtype=np.int32)
        sums = np.zeros((max(c for c, _, _ in layout) + 1, len(lanes)), dtype=np.int64)

        def take(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
            at = np.minimum(bit[rows], final[rows])
            code = table[(window[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
            if not (code & 0xFF).all():
                raise ValueError("bad code")
            bit[rows] += code & 0xFF
            return code >> 8

        order = np.argsort(-units, kind="stable")
        for unit in range(int(units.max())):
            rows = order[: int((units > unit).sum())]
            nth = 0
            for (component, _, _), (dc, ac) in zip(layout, coders):
                size = take(rows, made[dc]).astype(np.int64)
                at = bit[rows]
                extra = (window[np.minimum(at, final[rows]) >> 3] >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                bit[rows] += size
                sums[component, rows] += np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
                if component == 0:
                    found[rows, unit, nth] = sums[0, rows]
                    nth += 1
                k, left = np.ones(len(rows), dtype=np.int64), rows
                while len(left):
                    symbol = take(left, made[ac])
                    run, size = symbol >> 4, symbol & 15
                    bit[left] += size
                    k = np.where((size == 0) & (run < 15), 64, k + run + 1)
                    left, k = left[k < 64], k[k < 64]
        lane = 0
        for i in members:
            f, n = frames[i], len(frames[i]["intervals"])
            part = np.concatenate([found[lane + j, : units[lane + j]] for j in range(n)])
            lane += n
            h, v = f["luma"]
            grid = part.reshape(f["down"], f["across"], v, h).transpose(0, 2, 1, 3).reshape(f["down"] * v, f["across"] * h)
            grid = grid[: -(-f["height"] // 8), : -(-f["width"] // 8)]
            out[i] = np.clip(np.round(grid * f["quant"] / 8) + 128, 0, 255).astype(np.uint8)
    return out


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether mean brightness falls from one of 9 column groups to the next, over 8 bands of all rows (few rows: repeated)."""
    height, width = grey.shape
    rows, cuts = np.arange(8) * height // 8, np.arange(10) * width // 9
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, axis=0), cuts[:-1], axis=1)
    wide = np.maximum(1, np.diff(cuts))
    return np.packbits(sums[:, :-1] * wide[1:] > sums[:, 1:] * wide[:-1]).tobytes().hex()


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _groups(sizes: list[int]) -> Iterator[slice]:
    low, held = 0, 0
    for i, n in enumerate(sizes):
        if i > low and held + n > GROUP:
            yield slice(low, i)
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield slice(low, len(sizes))


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (JPEG streams, one after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in _groups([len(x) for x in texts]):
                made = [payload_of(x) for x in texts[part]]
                cut = WIDTH * ROWS
                images = [[p[i : i + cut] for i in range(0, len(p), cut)] for p, _ in made]
                flat = [x for y in images for x in y]
                coded = iter([z for g in _groups([len(x) for x in flat]) for z in encode(flat[g])])
                media = [b"".join(next(coded) for _ in y) for y in images]
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, see RESULT; the feature is the sizes of the images and their thumbnails' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(2).to_pylist()
            for part in _groups([len(x) for x in media]):
                rows, frames, owner = [], [], []
                for i, x in enumerate(media[part]):
                    at = 0
                    while at < len(x):
                        frame, at = parse(x, at)
                        frames.append(frame)
                        owner.append(i)
                pixels = defaultdict(list)
                for g in _groups([sum(map(len, f["intervals"])) for f in frames]):
                    for i, f, t in zip(owner[g], frames[g], thumbnails(frames[g])):
                        pixels[i].append((f"{f['width']}x{f['height']}-{difference_hash(t)}", t.tobytes()))
                for i, x in enumerate(media[part]):
                    payload = b"".join(p for _, p in pixels[i])
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), "+".join(f for f, _ in pixels[i])))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], b.column(1)[part.start : part.stop], *columns], names=[x.split()[0] for x in RESULT.split(", ")])

    return stored.mapInArrow(run, RESULT)
