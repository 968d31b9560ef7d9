"""Media columns: AVI clips of motion JPEG, read back by their RIFF index, and cut into shots.

A payload of bytes is stored as the quantised coefficients of grey baseline JPEG frames, the unit in
which JPEG is exact: 64 bytes are the 64 coefficients of an 8 x 8 block, 16 blocks are a 32 x 32 frame.
A coefficient of size class 8 takes 8 extra bits, which are the byte itself (values 128..255 stand for
themselves, 0..127 for -255..-128). The frames' own Huffman tables give each symbol a code of 8 bits, so
codes and bytes alternate and numpy decodes a frame at once; frames with other tables go through the
general bit-by-bit decoder. Each block restarts the DC prediction. Blocks that the last frame lacks are
coded as empty. Every frame is an intra frame.

Shots: each frame is decoded to its picture (dequantised, inversely transformed) and the pictures' grey
histograms (16 bins) are compared; a cut stands where the L1 difference exceeds `factor` times the running
mean of the differences since the last cut, plus a floor. The transform's basis is in whole numbers, whose
sums are exact, so pictures don't depend on the machine.

Defined results: null text counts as empty: 64 zero bytes, one frame, one shot. Equal texts give equal
values. Repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK, SIDE, FPS = 64, 32, 25
PER_FRAME = (SIDE // 8) ** 2
BINS = 16
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Zigzag order of a block's coefficients, from its rule: along the antidiagonals, turning each time.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))


#: Bits behind the point of the inverse transform's basis.
POINT = 13


def _basis() -> np.ndarray:
    """(64, 64): the pixels of a block that each coefficient in zigzag order adds, in units of 2^-POINT."""
    n = np.arange(8)
    wave = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.array([np.rint(np.outer(wave[r], wave[c]) * (1 << POINT)).ravel() for r, c in ZIGZAG])


BASIS = _basis()


def picture(coefficients: np.ndarray) -> np.ndarray:
    """Pixels (blocks, 64) of dequantised coefficients (blocks, 64) in zigzag order."""
    level = np.floor((coefficients.astype(np.float64) @ BASIS + (1 << POINT - 1)) / (1 << POINT)) + 128
    return np.clip(level, 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: bytes) -> bytes:
    """A Huffman table in which every symbol has a code of 8 bits."""
    return bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols


HEAD = b"".join([
    b"\xff\xd8",
    _segment(0xDB, b"\x00" + b"\x01" * 64),
    _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"),
    _segment(0xC4, _table(0x00, b"\x08\x00") + _table(0x10, b"\x08\x00")),
    _segment(0xDD, b"\x00\x01"),
    _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
])
TAIL = b"\xff\xd9"
EMPTY = b"\x01\x01"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of 64."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    cells = np.zeros((len(data), 2 * BLOCK + 2), np.uint8)
    cells[:, 1 : 2 * BLOCK : 2] = data
    cells[:, -2] = 0xFF
    cells[:, -1] = 0xD0 + np.arange(len(data)) % PER_FRAME % 8
    stuffed, frames = 255 in payload, []
    for at in range(0, len(data), PER_FRAME):
        part = cells[at : at + PER_FRAME]
        if stuffed:
            body = b"".join(c[:-2].tobytes().replace(b"\xff", b"\xff\x00") + c[-2:].tobytes() for c in part)
        else:
            body = part.tobytes()
        for i in range(len(part), PER_FRAME):
            body += EMPTY + bytes([0xFF, 0xD0 + i % 8])
        frames.append(HEAD + body[:-2] + TAIL)
    return frames


def encode_clip(payload: bytes, n_bytes: int) -> bytes:
    """An AVI file: header lists, a comment with the unpadded length, frames and their index."""
    frames = encode_frames(payload)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d\x00" % n_bytes))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + note + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse_clip(data: bytes) -> tuple[list[bytes], int, float]:
    """Frames by the file's index, the noted length (-1: none) and frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, noted, rate = -1, b"", -1, float(FPS)
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                rate = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
            elif name == b"idx1":
                index = data[body : body + size]
            elif name == b"ICMT" and data[body : body + 6] == b"bytes=":
                noted = int(data[body + 6 : body + size].rstrip(b"\x00"))
            at = body + size + size % 2
    if movi < 0:
        raise ValueError("no frames")
    found = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    found = found[found["id"] == b"00dc"]
    return [data[movi + a + 8 : movi + a + 8 + s] for a, s in zip(found["at"].tolist(), found["size"].tolist(), strict=True)], noted, rate


def _general(jpeg: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks, 64) in zigzag order and the quantisers of a grey baseline frame, bit by bit."""
    at, quant, huff, blocks, restart = 2, np.ones(64), {}, 0, 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(float)
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            blocks = -(-height // 8) * -(-width // 8)
        elif marker == 0xC4:
            while body:
                code, lengths, rest, codes = 0, body[1:17], body[17:], {}
                for bits, n in enumerate(lengths, 1):
                    for _ in range(n):
                        codes[bits, code] = rest[0]
                        code, rest = code + 1, rest[1:]
                    code <<= 1
                huff[body[0]], body = codes, rest
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    out, done = np.zeros((blocks, 64), np.int64), 0
    for part in RESTART.split(jpeg[at:-2]):
        part = part.replace(b"\xff\x00", b"\xff")
        bits, pos, dc = int.from_bytes(part, "big"), len(part) * 8, 0

        def take(n: int) -> int:
            nonlocal pos
            pos -= n
            return bits >> pos & (1 << n) - 1

        def symbol(codes: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in codes:
                    return codes[n, code]
            raise ValueError("bad code")

        def value(n: int) -> int:
            v = take(n) if n else 0
            return v if not n or v >> n - 1 else v - (1 << n) + 1

        for _ in range(min(restart or blocks, blocks - done)):
            dc += value(symbol(huff[0x00]))
            out[done, 0], k = dc, 1
            while k < 64:
                s = symbol(huff[0x10])
                if not s:
                    break
                k += s >> 4
                if s & 15:
                    out[done, k] = value(s & 15)
                k += 1
            done += 1
    return out, quant


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The stored samples of a frame, without the blocks it lacks."""
    if jpeg.startswith(HEAD):
        body = b"".join(RESTART.split(jpeg[len(HEAD) : -2])).replace(b"\xff\x00", b"\xff")
        pairs = np.frombuffer(body, np.uint8).reshape(-1, 2)
        if not pairs[:, 0].any():
            return pairs[:, 1]
        return pairs[: int(np.argmax(pairs[:, 0] != 0)), 1]
    coefficients, _ = _general(jpeg)
    kept = coefficients[(np.abs(coefficients) >= 128).all(axis=1)]
    return np.where(kept < 0, kept + 255, kept).astype(np.uint8).ravel()


def pixels(jpeg: bytes) -> np.ndarray:
    """A square grey frame as pixels: dequantised and inversely transformed."""
    coefficients, quant = _general(jpeg)
    side = int(np.sqrt(len(coefficients)))
    return picture(coefficients * quant).reshape(side, side, 8, 8).swapaxes(1, 2).reshape(8 * side, 8 * side)


def histograms(samples: np.ndarray) -> np.ndarray:
    """Grey histograms (frames, BINS) of the pictures of stored samples, some hundred frames at a time."""
    size = BLOCK * PER_FRAME
    n = -(-len(samples) // size)
    out = np.zeros((n, BINS), np.int64)
    for first in range(0, n, 256):
        part = samples[first * size : (first + 256) * size].astype(np.float64).reshape(-1, BLOCK)
        grey = picture(np.where(part < 128, part - 255, part))
        frame = np.arange(grey.size) // size
        found = np.bincount(frame * BINS + grey.ravel() // (256 // BINS)).astype(np.int64)
        out.reshape(-1)[first * BINS : first * BINS + len(found)] = found
    out[-1, 128 // (256 // BINS)] += n * size - len(samples)  # blocks that the last frame lacks are grey
    return out


def clip_histograms(frames: list[bytes], samples: np.ndarray) -> np.ndarray:
    """The same for a clip's frames; those of other encoders are decoded one by one."""
    if all(f.startswith(HEAD) for f in frames):
        return histograms(samples)
    return np.array([np.bincount(pixels(f).ravel() // (256 // BINS), minlength=BINS) for f in frames])


def shots(samples: np.ndarray, factor: float = 2.0, floor: float = 0.05) -> list[tuple[int, int]]:
    """First and last frame of each shot, of stored samples in frames of equal size (the last may be short)."""
    return cuts_of(histograms(samples), factor, floor)


def cuts_of(hist: np.ndarray, factor: float = 2.0, floor: float = 0.05) -> list[tuple[int, int]]:
    """First and last frame of each shot, from the frames' histograms."""
    n = len(hist)
    share = hist / hist.sum(axis=1, keepdims=True)
    moved = np.abs(np.diff(share, axis=0)).sum(axis=1).tolist()
    out, first, total, seen = [], 0, 0.0, 0
    for k, d in enumerate(moved):
        if seen and d > factor * total / seen + floor:
            out.append((first, k))
            first, total, seen = k + 1, 0.0, 0
        else:
            total, seen = total + d, seen + 1
    return [*out, (first, n - 1)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One clip per row: id, media (binary)."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 1000):
                media = [encode_clip(*payload_of(t)) for t in texts.slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), pa.array(media, pa.binary())], ["id", "media"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(work, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot: id, clip, first_frame, last_frame, start_s, end_s."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if media is None:
                    continue
                frames, _, rate = parse_clip(media)
                samples = np.concatenate([decode_frame(f) for f in frames])
                for k, (a, b) in enumerate(cuts_of(clip_histograms(frames, samples))):
                    rows.append({"id": i, "clip": k, "first_frame": a, "last_frame": b, "start_s": a / rate, "end_s": (b + 1) / rate})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(0), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    schema = f"id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double"
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per clip, from its bytes alone: lengths and digests of what is read back, and its shots."""
    kind = df.schema[id_col].dataType.simpleString()
    types = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {n: [] for n in types}
            for media in batch.column(1).to_pylist():
                frames, noted, rate = parse_clip(media)
                samples = np.concatenate([decode_frame(f) for f in frames])
                payload, cuts = samples.tobytes(), cuts_of(clip_histograms(frames, samples))
                times = ",".join(f"{a / rate:.2f}-{(b + 1) / rate:.2f}" for a, b in cuts)
                for n, v in zip(types, (noted, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(frames)};shots={len(cuts)};{times}"), strict=True):
                    found[n].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if types[n] == "bigint" else pa.string()) for n, v in found.items())], ["id", *types])

    schema = ", ".join([f"id {kind}", *(f"{n} {t}" for n, t in types.items())])
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def op5_motion_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a clip and read back."""
    from .common import documents

    return read_media(to_media(documents(spark, sf_dir)))
