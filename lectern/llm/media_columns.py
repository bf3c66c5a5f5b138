"""Media columns: texts as AVI motion-JPEG, read back by their RIFF index, with shots found by histogram differences.

A frame is 24 x 24 grey pixels, nine blocks of 64 coefficients, and carries 576 bytes. Bytes are stored in the
format's own unit, the quantised DCT coefficient, so nothing is lost: byte b is the coefficient b - 511, which is
of size category 9 for every b. With one Huffman code for DC (category 9) and one for AC (run 0, size 9), each one
bit long, and a restart marker after each block (so that DC is coded by itself), a coefficient takes ten bits
and a block 80 bytes. Frames are plain baseline JPEG (SOI, DQT, SOF0, DHT, DRI, SOS, EOI) in '00dc' chunks.

Intra frames are decoded to pixels: Huffman codes by the file's tables, dequantised, and transformed back.
coefficients() does so for any baseline JPEG, code by code; for frames with this module's own header, coefficients lie
at fixed places and are unpacked by vectors, all frames of a text at a time.

Shots: each frame has a 16-bin histogram of its pixels; a cut is where the difference to the frame before is
over mean + 3 deviations of the WINDOW differences before it, and over LEAST. The frame that padding fills up takes no
part and belongs to the shot before it. Clips are the runs between cuts.

Defined cases: a null or empty text is one frame of 255s; payloads are padded with 255 to whole frames; equal
texts give equal values; texts of any length (frames are made by vectors over the whole text).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, schema_of

FRAME_BYTES, SIDE, BLOCKS = 576, 24, 9
FPS = 25
BINS, WINDOW, LEAST = 16, 8, 0.12


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15)
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00]) + _ONE_CODE + bytes([9]))
    + _segment(0xC4, bytes([0x10]) + _ONE_CODE + bytes([0x09]))
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
TAIL = b"\xff\xd9"


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * ((-len(text)) % FRAME_BYTES or (0 if text else FRAME_BYTES))


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload of whole frames."""
    g = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS, 16, 4).astype(np.uint16)  # four coefficients take five bytes: (0 0 b7..b0) x 4
    n = len(g)
    packed = np.empty((n, BLOCKS, 16, 5), np.uint8)
    packed[..., 0] = g[..., 0] >> 2
    packed[..., 1] = ((g[..., 0] & 3) << 6) | (g[..., 1] >> 4)
    packed[..., 2] = ((g[..., 1] & 15) << 4) | (g[..., 2] >> 6)
    packed[..., 3] = (g[..., 2] & 63) << 2
    packed[..., 4] = g[..., 3]
    scan = packed.reshape(n, BLOCKS, 80)
    marks = np.zeros((n, BLOCKS, 82), np.uint8)
    marks[:, :, :80] = scan
    marks[:, :, 80], marks[:, :, 81] = 0xFF, 0xD0 + np.arange(BLOCKS) % 8
    frames = []
    stuffed = (scan == 0xFF).any(axis=(1, 2))
    for k in range(n):
        if stuffed[k]:
            body = b"".join(scan[k, b].tobytes().replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + b % 8]) if b < BLOCKS - 1 else b"") for b in range(BLOCKS))
        else:
            body = marks[k].tobytes()[:-2]
        frames.append(HEAD + body + TAIL)
    return frames


def avi_of(frames: list[bytes]) -> bytes:
    """An AVI 1.0 file: hdrl with one video stream, movi with a chunk a frame, idx1."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index)))


def read_index(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of each video frame, by the idx1 chunk of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, entries = 12, -1, b""
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"idx1":
            entries = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    out = []
    for tag, _, offset, size in struct.iter_unpack("<4sIII", entries):
        if tag == b"00dc":
            start = movi + offset
            if data[start : start + 4] != b"00dc" or struct.unpack_from("<I", data, start + 4)[0] != size:
                raise ValueError("the index doesn't fit the chunks")
            out.append((start + 8, size))
    return out


# fixed values: the order in which a block's coefficients are stored, by rows of the 8 x 8 block
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_COSINE = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Stored coefficients of a block (64, in their order) to its pixels (64, by rows), less 128.
_INVERSE = np.einsum("ux,vy->uvxy", _COSINE, _COSINE).reshape(64, 64)[ZIGZAG].astype(np.float32)


def segments_of(frame: bytes) -> tuple[dict[int, list[bytes]], bytes]:
    """A JPEG's marker segments, and its entropy-coded bytes."""
    at, seen = 2, {}
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        seen.setdefault(marker, []).append(frame[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            return seen, frame[at : frame.rindex(TAIL)]


def huffman_codes(tables: list[bytes]) -> dict[int, dict[tuple[int, int], int]]:
    """Class and number of a table -> (length, code) -> symbol."""
    out = {}
    for body in tables:
        while body:
            head, counts = body[0], body[1:17]
            symbols, code, codes = iter(body[17 : 17 + sum(counts)]), 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[length, code] = next(symbols)
                    code += 1
                code <<= 1
            out[head], body = codes, body[17 + sum(counts) :]
    return out


class Bits:
    def __init__(self, data: bytes) -> None:
        data = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left = int.from_bytes(data), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def coefficients(frame: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Coefficients (blocks x 64, as stored) of the first component of a baseline JPEG, its quantisation table, and height and
    width in blocks. Of several components each has to have one block in a unit (no subsampling)."""
    seen, scan = segments_of(frame)
    _, height, width, n = struct.unpack(">BHHB", seen[0xC0][0][:6])
    parts = [seen[0xC0][0][6 + 3 * i : 9 + 3 * i] for i in range(n)]
    if any(p[1] != 0x11 for p in parts[: n if n > 1 else 0]):
        raise ValueError("subsampled components")
    codes, order = huffman_codes(seen[0xC4]), {seen[0xDA][0][1 + 2 * i]: seen[0xDA][0][2 + 2 * i] for i in range(n)}
    tables = {t[0] & 15: np.frombuffer(t[1:65], np.uint8).astype(np.int32) for body in seen[0xDB] for t in (body[i : i + 65] for i in range(0, len(body), 65))}
    shape = -(-height // 8), -(-width // 8)
    every = struct.unpack(">H", seen[0xDD][0])[0] if 0xDD in seen else 0
    total = shape[0] * shape[1]
    runs = re.split(rb"\xff[\xd0-\xd7]", scan)
    out = np.zeros((total, 64), np.int32)
    for r, run in enumerate(runs):
        bits, last = Bits(run), [0] * n
        for block in range(r * every, min(total, (r + 1) * every) if every else total):
            for i, p in enumerate(parts):
                pick, values, k = order[p[0]], [0] * 64, 1
                last[i] += bits.number(bits.symbol(codes[pick >> 4]))
                values[0] = last[i]
                while k < 64:
                    s = bits.symbol(codes[0x10 | pick & 15])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        values[k] = bits.number(s & 15)
                    k += 1
                if i == 0:
                    out[block] = values
    return out, tables[parts[0][2]], shape


def pixels_of(coefs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Pixels (... x blocks x 64) of stored coefficients."""
    return np.clip(np.rint((coefs * table).astype(np.float32) @ _INVERSE) + 128, 0, 255).astype(np.uint8)


def own_coefficients(data: bytes, index: list[tuple[int, int]]) -> np.ndarray:
    """coefficients() of all frames of a file whose frames have this module's header: frames x blocks x 64."""
    scans = []
    for at, size in index:
        s = data[at + len(HEAD) : at + size - 2]
        if len(s) != BLOCKS * 82 - 2:  # stuffed zeros after 0xFF
            raw = np.frombuffer(s, np.uint8)
            keep = np.ones(len(raw), bool)
            keep[1:] = ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
            s = raw[keep].tobytes()
        scans.append(s + b"\xff\xd0")
    p = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, BLOCKS, 82)[:, :, :80].reshape(-1, BLOCKS, 16, 5).astype(np.int32)
    out = np.empty((len(p), BLOCKS, 16, 4), np.int32)
    # the size bits of a code, as JPEG counts negative numbers: v - 511; the code's own bit before them is 0
    out[..., 0] = (p[..., 0] & 127) << 2 | p[..., 1] >> 6
    out[..., 1] = (p[..., 1] & 31) << 4 | p[..., 2] >> 4
    out[..., 2] = (p[..., 2] & 7) << 6 | p[..., 3] >> 2
    out[..., 3] = (p[..., 3] & 1) << 8 | p[..., 4]
    return np.where(out >> 8, out, out - 511).reshape(len(p), BLOCKS, 64)


def decode_frames(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and pixels (frames x blocks x 64) of a motion-JPEG AVI file of frames of one size."""
    index = read_index(data)
    if all(data[at : at + len(HEAD)] == HEAD for at, _ in index):
        coefs = own_coefficients(data, index)
        return coefs, pixels_of(coefs, np.int32(1))
    frames = [coefficients(data[at : at + size])[:2] for at, size in index]
    return np.stack([c for c, _ in frames]), np.stack([pixels_of(c, t) for c, t in frames])


def payload_in(coefs: np.ndarray) -> bytes:
    """The bytes that encode_frames() stored."""
    return (coefs + 511).astype(np.uint8).tobytes()


def cuts_of(pixels: np.ndarray) -> np.ndarray:
    """Frames that begin a shot (the first always does)."""
    flat = pixels.reshape(len(pixels), -1)
    n, size = flat.shape
    hist = np.bincount((np.arange(n)[:, None] * BINS + (flat >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / size
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    before = np.concatenate([[0.0], diff.cumsum()]), np.concatenate([[0.0], (diff * diff).cumsum()])
    i = np.arange(len(diff))
    low = np.maximum(i - WINDOW, 0)
    m = np.maximum(i - low, 1)
    mean = (before[0][i] - before[0][low]) / m
    dev = np.sqrt(np.maximum((before[1][i] - before[1][low]) / m - mean * mean, 0))
    return np.concatenate([[0], 1 + np.flatnonzero(diff > np.maximum(mean + 3 * dev, LEAST))])


def columns_of(text: bytes | None) -> tuple[bytes, bytes, np.ndarray]:
    """Stored bytes, payload read back from them, and shot starts."""
    media = avi_of(encode_frames(payload_of(text)))
    coefs, pixels = decode_frames(media)
    return media, payload_in(coefs), cuts_of(pixels[: max(1, len(text or b"") // FRAME_BYTES)])


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each document: digests of the stored form and of the payload read back, features, and its clips' times."""
    schema = T.StructType([docs.schema["doc_id"], *schema_of("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_sec double, end_sec double>>").fields])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema} | {"doc_id": cols["doc_id"]}
        for t in cols["text"]:
            media, payload, cuts = columns_of(t)
            n = len(payload) // FRAME_BYTES
            ends = [*cuts[1:].tolist(), n]
            longest = max(z - a for a, z in zip(cuts.tolist(), ends, strict=True))
            times = [{"start_sec": a / FPS, "end_sec": z / FPS} for a, z in zip(cuts.tolist(), ends, strict=True)]
            values = (len(t or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={n};shots={len(cuts)};longest={longest}", times)
            for name, v in zip(schema.names[1:], values, strict=True):
                out[name].append(v)
        return out

    return map_rows(docs.select("doc_id", "text"), run, schema)


def clips(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Timed clip rows: ``keys``, clip_no, start_sec, end_sec, n_frames, media (an AVI file of the clip's own frames)."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of("clip_no int, start_sec double, end_sec double, n_frames int, media binary").fields])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        for i, t in enumerate(cols["text"]):
            media, _, cuts = columns_of(t)
            index = read_index(media)
            for c, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(index)], strict=True)):
                row = (*(cols[k][i] for k in keys), c, a / FPS, b / FPS, int(b - a), avi_of([media[s : s + z] for s, z in index[a:b]]))
                for name, v in zip(schema.names, row, strict=True):
                    out[name].append(v)
        return out

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema)
