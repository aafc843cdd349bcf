"""Media columns: AVI motion-JPEG.

``encode_avi`` stores a byte payload losslessly as the quantised coefficients of baseline JPEG frames (a block of
8 x 8 coefficients holds 64 bytes) in a RIFF/AVI file with an ``idx1`` index.  ``read_avi`` parses the RIFF index and decodes
the intra frames: entropy-coded data back to coefficients (and so to the payload), and on to pixels.  Shots are cut where the
difference of luminance histograms exceeds an adaptive threshold, and every shot is a timed clip row.

The decoder takes any baseline, one-component JPEG frame.  Where all Huffman codes of a frame have one length
and one size category, and every block is a restart interval (as the encoder writes them), blocks have equal lengths and are decoded with array operations.

Defined results: a null or empty payload is padded to one block of zero bytes; equal payloads give equal files; frames are
decoded whole, whatever the length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailspark.llm.common import steps

UNIT = 64
ACROSS, DOWN = 8, 4  # blocks of a full frame
FRAME_US = 40_000
BINS = 16
WINDOW = 8  # frame differences that the threshold adapts to
#: A coefficient is the byte plus this, so all of them have size category 9.
BASE, CATEGORY = 256, 9
_DCT = np.array([[(np.sqrt(1 / 8) if k == 0 else np.sqrt(2 / 8)) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _zigzag() -> np.ndarray:
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()
#: Coefficients in zigzag order -> pixels less 128, as one matrix.
_INVERSE = np.ascontiguousarray(np.einsum("ky,lx->klyx", _DCT, _DCT).reshape(64, 64)[ZIGZAG].astype(np.float32))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


# ---- frames ----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, b"\0" + b"\1" * 64)
    # one code of one bit each: size category 9 for DC, no zeros before size category 9 for AC
    + _segment(0xC4, b"\x00" + bytes([1, *[0] * 15]) + bytes([CATEGORY]))
    + _segment(0xC4, b"\x10" + bytes([1, *[0] * 15]) + bytes([CATEGORY]))
    + _segment(0xDD, struct.pack(">H", 1))
)


def encode_frames(payload: bytes) -> list[tuple[bytes, int, int]]:
    """(JPEG file, blocks across, blocks down) of each frame."""
    blocks = len(payload) // UNIT
    if blocks <= ACROSS * DOWN:
        across, down = blocks, 1
    else:
        across, down = ACROSS, DOWN
    per = across * down
    data = np.frombuffer(payload + bytes(-blocks % per * UNIT), np.uint8).reshape(-1, UNIT)
    # a zero bit (the code), then the nine bits of 256 + byte: 80 whole bytes a block
    bits = np.zeros((len(data), UNIT, 10), np.uint8)
    bits[:, :, 1] = 1
    bits[:, :, 2:] = np.unpackbits(data, axis=1).reshape(len(data), UNIT, 8)
    coded = np.packbits(bits.reshape(len(data), UNIT * 10), axis=1)
    head = b"\xff\xd8" + _TABLES + _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0") + _segment(0xDA, b"\1\1\0\0\x3f\0")
    frames = []
    for at in range(0, len(coded), per):
        part = coded[at : at + per]
        # stuff a zero byte after each 0xFF, and a restart marker after each block but the last
        ends = np.cumsum(np.full(len(part), part.shape[1]))[:-1]
        flat = part.reshape(-1)
        after = np.flatnonzero(flat == 0xFF) + 1
        marks = np.stack([np.full(len(ends), 0xFF), 0xD0 + np.arange(len(ends)) % 8], axis=1).reshape(-1)
        where = np.concatenate([after, np.repeat(ends, 2)])
        what = np.concatenate([np.zeros(len(after), np.int64), marks]).astype(np.uint8)
        frames.append((head + np.insert(flat, where, what).tobytes() + b"\xff\xd9", across, down))
    return frames


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _slow_blocks(parts: list[bytes], per_part: int, total: int, dc: dict, ac: dict) -> np.ndarray:
    """Entropy-coded intervals of any baseline frame, bit by bit."""
    out = np.zeros((total, 64), np.int32)
    n = 0
    for part in parts:
        bits, at, last = "".join(f"{b:08b}" for b in part), 0, 0

        def symbol(table: dict) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | (bits[at] == "1")
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such Huffman code")

        def extra(size: int) -> int:
            nonlocal at
            if not size:
                return 0
            v = int(bits[at : at + size], 2)
            at += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(per_part, total - n)):
            last += extra(symbol(dc))
            out[n, 0] = last
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[n, k] = extra(s & 15)
                k += 1
            n += 1
    return out


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Coefficients in zigzag order (a row a block), their quantisers, width and height of a baseline frame with one component."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quant, huff, restart, shape, pick = 2, {}, {}, 0, None, (0, 0, 0)
    while True:
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("one component only")
            shape, pick = (wide, high), (body[8], 0, 0)
        elif marker == 0xDA:
            pick = (pick[0], body[2] >> 4, 16 | body[2] & 15)
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("baseline frames only")
    wide, high = shape
    total = -(-wide // 8) * -(-high // 8)
    data = np.frombuffer(jpeg, np.uint8, offset=at)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0))
    ends = [int(m) for m in marks if not 0xD0 <= data[m + 1] <= 0xD7][:1]
    end = ends[0] if ends else len(data)
    marks = marks[marks < end]
    dc, ac = huff[pick[1]], huff[pick[2]]
    if restart == 1 and len(dc) == len(ac) == 1 and next(iter(ac.values())) >> 4 == 0 and next(iter(ac.values())) & 15:
        (dl, _), ds = next(iter(dc)), next(iter(dc.values()))
        (al, _), as_ = next(iter(ac)), next(iter(ac.values()))
        if dl + ds == al + as_ and (dl + ds) * 64 % 8 == 0 and ds == as_:
            keep = np.ones(end, bool)
            keep[marks] = keep[marks + 1] = False
            keep[np.flatnonzero((data[: end - 1] == 0xFF) & (data[1:end] == 0)) + 1] = False
            width = (dl + ds) * 8
            bits = np.unpackbits(data[:end][keep].reshape(total, width), axis=1).reshape(total, 64, dl + ds)[:, :, dl:]
            value = (bits.astype(np.float32) @ (1 << np.arange(ds - 1, -1, -1)).astype(np.float32)).astype(np.int32)
            value = np.where(bits[:, :, 0] == 1, value, value - (1 << ds) + 1)
            return value.astype(np.int32), quant[pick[0]], wide, high
    edges = [0, *[int(m) + 2 for m in marks]]
    stops = [*[int(m) for m in marks], end]
    parts = [data[a:b].tobytes().replace(b"\xff\x00", b"\xff") for a, b in zip(edges, stops, strict=True)]
    return _slow_blocks(parts, restart or total, total, dc, ac), quant[pick[0]], wide, high


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 pixels of each block, as rows of 64."""
    return np.clip(np.rint((coefficients * quant).astype(np.float32) @ _INVERSE + 128), 0, 255).astype(np.uint8)


# ---- file ------------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    frames = encode_frames(payload)
    across, down = frames[0][1:]
    wide, high = across * 8, down * 8
    largest = max(len(f) for f, _, _ in frames)
    avih = struct.pack("<14I", FRAME_US, 0, 0, 0x10, len(frames), 0, 1, largest, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, wide & 0xFFFF, high & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 8, b"MJPG", wide * high, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movi, index, at = [], [], 4
    for jpeg, _, _ in frames:
        movi.append(c := _chunk(b"00dc", jpeg))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(jpeg)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        n = struct.unpack_from("<I", data, start + 4)[0]
        yield data[start : start + 4], start + 8, min(n, end - start - 8)
        start += 8 + n + (n & 1)


def read_avi(data: bytes) -> tuple[list[bytes], int, int | None]:
    """Frames in the order of the index, microseconds a frame, and the payload length that the file notes."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    micros, movi, index, noted = FRAME_US, None, None, None
    for name, at, n in _walk(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, p, _ in _walk(data, at + 4, at + n):
                if inner == b"avih":
                    micros = struct.unpack_from("<I", data, p)[0]
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, n)
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for inner, p, m in _walk(data, at + 4, at + n):
                if inner == b"ICMT" and data[p : p + 8] == b"payload=":
                    noted = int(data[p + 8 : p + m].rstrip(b"\0"))
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, p) for p in range(at, at + n - 15, 16)]
    if movi is None:
        return [], micros, noted
    if index is None:
        return [data[p : p + m] for name, p, m in _walk(data, movi[0] + 4, sum(movi)) if name[2:] in (b"dc", b"db")], micros, noted
    base = movi[0] if not index or data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
    return [data[base + at + 8 : base + at + 8 + n] for name, _, at, n in index if name[2:] in (b"dc", b"db")], micros, noted


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end) of each shot: a cut where a difference exceeds mean + 2 deviations of those before it in a window."""
    n = len(histograms)
    if n == 0:
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    cuts = [0]
    for i in range(1, len(d)):
        near = d[max(0, i - WINDOW) : i]
        if d[i] > near.mean() + 2 * near.std() + 0.05 and i + 1 - cuts[-1] >= 2:
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def analyse(avi: bytes) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """The stored payload, and (start ms, end ms, frames, mean luminance in hundredths) of each clip."""
    frames, micros, noted = read_avi(avi)
    coefficients, histograms, means = [], [], []
    shaped = [decode_frame(f) for f in frames]
    for c, q, _, _ in shaped:
        p = pixels(c, q)
        histograms.append(np.bincount(p.reshape(-1) >> 4, minlength=BINS) / p.size)
        means.append(int(p.sum(dtype=np.int64)) * 100 // p.size)
        coefficients.append(c)
    payload = (np.concatenate(coefficients) - BASE).astype(np.uint8).tobytes() if coefficients else b""
    clips = [(a * micros // 1000, b * micros // 1000, b - a, sum(means[a:b]) // (b - a)) for a, b in shots(np.array(histograms))]
    return payload if noted is None else payload[:noted], clips


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as an AVI file; the payload is its UTF-8 bytes, padded."""
    source = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_column, 4 << 20):
            data = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            files = [encode_avi(pad(x)) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(files, pa.binary())], names=[id_column, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes long, media binary")


CLIP = "struct<start_ms:bigint,end_ms:bigint,frames:int,luminance:int>"


def clips(media: DataFrame, media_column: str = "media") -> DataFrame:
    """The input without the file, and with (payload, media_bytes, media_sha256, clips): the file read back through its index,
    and its timed clips.  ``select(id, inline(clips))`` gives one row for each clip.  Columns of those names are replaced."""
    names = ["payload", "media_bytes", "media_sha256", "clips"]
    kept = [c for c in media.columns if c not in (media_column, *names)]
    source = media.select(*kept, media_column)
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32()), ("luminance", pa.int32())]))
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept), f"payload binary, media_bytes long, media_sha256 string, clips array<{CLIP}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, media_column, 4 << 20):
            files = batch.column(len(kept)).to_pylist()
            read = [analyse(x) for x in files]
            rows = [[dict(zip(("start_ms", "end_ms", "frames", "luminance"), c, strict=True)) for c in cs] for _, cs in read]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(kept)], pa.array([p for p, _ in read], pa.binary()), pa.array([len(x) for x in files], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(rows, kind),
            ], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def digest(payload: bytes) -> tuple[int, str, int]:
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])
