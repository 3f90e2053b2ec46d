"""Payloads stored as the coefficients of progressive JPEG images, read back scan by scan.

64 payload bytes make one 8x8 block: the first is its DC coefficient, the others its AC coefficients in zigzag
order, each in a magnitude range that costs a fixed number of bits. All scans are progressive: DC and two spectral
bands without the lowest bit first, the lowest bits by successive approximation. Such files hold the payload
exactly, since nothing is lost after quantisation (all steps 1). The decoder gathers the scans of progressive files
into coefficient arrays if each scan has one component, as those written here; it refuses interleaved scans and
does not know restart markers. Scans whose code has one symbol are read with numpy. An inverse transform in numpy,
chroma upsampling and colour conversion give the full-resolution RGB tensor. A payload of over about 402 MB does
not fit the height of one image.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, slices, texts_of

WIDE = 256  # macroblocks in a row at most; one holds 4 luma and 2 chroma blocks


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index, by walking the diagonals."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def _idct() -> np.ndarray:
    """64x64 matrix from zigzag coefficients to pixels."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(c, c)[ZIGZAG].astype(np.float32)


ZIGZAG = _zigzag()
IDCT = _idct()


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _bits(flags: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    flags = flags.reshape(-1).astype(np.uint8)
    return np.packbits(np.concatenate([flags, np.ones(-len(flags) % 8, np.uint8)])).tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, length: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is `length` zeros."""
    counts = [0] * 16
    counts[length - 1] = 1
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, symbol]))


def _scan(component: int, tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low])) + _stuffed(data)


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a progressive JPEG file (4:2:0)."""
    n = len(payload) // 64
    blocks = -(-n // 6)
    wide = min(blocks, WIDE)
    high = -(-blocks // wide)
    each = wide * high
    values = np.zeros((6 * each, 64), np.uint8)
    values[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    parts = (values[: 4 * each], values[4 * each : 5 * each], values[5 * each :])
    sampling = (0x22, 0x11, 0x11)
    out = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", len(payload))),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([c + 1, sampling[c], 0]) for c in range(3))),
        _table(0, 0, 7, 9),
        _table(1, 0, 1, 7),
        _table(1, 1, 1, 0),
    ]
    dcs = []
    for c, v in enumerate(parts):
        dc = v[:, 0].astype(np.int32)
        dc = np.where(np.arange(len(dc)) % 2 == 0, 512 + dc, -dc)
        dcs.append(dc)
        step = np.diff(dc >> 1, prepend=0)
        out.append(_scan(c + 1, 0, 0, 0, 0, 1, np.where(step < 0, step + 511, step).astype(">u2").tobytes()))
    for begin, end in ((1, 5), (6, 63)):
        for c, v in enumerate(parts):
            out.append(_scan(c + 1, 0, begin, end, 0, 1, (v[:, begin : end + 1] >> 1).tobytes()))
    for c, dc in enumerate(dcs):
        out.append(_scan(c + 1, 0, 0, 0, 1, 0, _bits(dc & 1)))
    for c, v in enumerate(parts):
        low = (v & 1) ^ (v < 128)
        low[:, 0] = 0  # the end-of-band code
        out.append(_scan(c + 1, 1, 1, 63, 1, 0, _bits(low)))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Frame:
    height: int
    width: int
    sampling: list[tuple[int, int, int, int]]  # of each component: identifier, horizontal, vertical, table of steps
    coefficients: list[np.ndarray] = field(default_factory=list)  # blocks x 64, zigzag
    shape: list[tuple[int, int]] = field(default_factory=list)  # blocks down and across
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class _Reader:
    """Bits of one scan's entropy-coded data, its stuffing taken out."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a code of the table")


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _read_any(co: np.ndarray, data: bytes, dc, ac, first: int, last: int, high: int, low: int) -> None:
    """Any non-interleaved progressive scan, bit by bit."""
    r, pred, run = _Reader(data), 0, 0
    for block in co:
        if first == 0:
            if high:
                block[0] |= r.take(1) << low
            else:
                size = r.symbol(dc)
                pred += _extend(r.take(size), size)
                block[0] = pred << low
            continue
        k = first
        if run == 0:
            while k <= last:
                s = r.symbol(ac)
                zeros, size = s >> 4, s & 15
                if size == 0 and zeros < 15:
                    run = (1 << zeros) + (r.take(zeros) if zeros else 0)
                    break
                value = (_extend(r.take(size), size) if not high else (1 if r.take(1) else -1)) << low if size else 0
                if not high:
                    k += zeros
                    if size:
                        block[k] = value
                    k += 1
                    continue
                while k <= last:
                    if block[k]:
                        if r.take(1):
                            block[k] += (1 << low) if block[k] > 0 else -(1 << low)
                    elif zeros == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
        if run:
            if high:
                for k in range(k, last + 1):
                    if block[k] and r.take(1):
                        block[k] += (1 << low) if block[k] > 0 else -(1 << low)
            run -= 1


def _only(codes: dict) -> tuple[int, int] | None:
    """(length, symbol) of a table with a single code."""
    return next(((n, s) for (n, _), s in codes.items()), None) if len(codes) == 1 else None


def _read_scan(co: np.ndarray, data: bytes, dc, ac, first: int, last: int, high: int, low: int) -> None:
    """With numpy where every block takes the same bits, else bit by bit."""
    n, width = len(co), last - first + 1
    if first == 0 and high:
        co[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int32) << low
        return
    only = _only(dc if first == 0 else ac)
    if only and first == 0 and sum(only) == 16 and only[1] < 15:
        v = np.frombuffer(data, ">u2", n).astype(np.int32)
        size = only[1]
        co[:, 0] = np.cumsum(np.where(v >> (size - 1), v, v - (1 << size) + 1)) << low
    elif only and first and not high and sum(only) == 8 and 0 < only[1] < 8:
        v = np.frombuffer(data, np.uint8, n * width).reshape(n, width).astype(np.int32)
        size = only[1]
        co[:, first : last + 1] = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
    elif only and first and high and only == (1, 0) and co[:, first : last + 1].all():
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (width + 1)).reshape(n, width + 1)[:, 1:]
        own = co[:, first : last + 1]
        own += np.where(own > 0, bits.astype(np.int32), -bits.astype(np.int32)) << low
    else:
        _read_any(co, data, dc, ac, first, last, high, low)


def decode(media: bytes) -> Frame:
    """Gather all scans of a progressive JPEG file into coefficient arrays."""
    frame, tables, steps, comment, at = None, {}, {}, b"", 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            frame.steps, frame.comment = steps, comment
            return frame
        (size,) = struct.unpack_from(">H", media, at + 2)
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                steps[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                counts, code, codes, k = body[1:17], 0, {}, 17
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        codes[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = codes
                body = body[k:]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = Frame(height, width, [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)])
            most_h, most_v = max(s[1] for s in frame.sampling), max(s[2] for s in frame.sampling)
            for _, h, v, _ in frame.sampling:
                down, across = -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)
                frame.shape.append((down, across))
                frame.coefficients.append(np.zeros((down * across, 64), np.int32))
        elif marker == 0xDA:
            if body[0] != 1:
                raise ValueError("interleaved scans are not read")
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            which = next(k for k, s in enumerate(frame.sampling) if s[0] == body[1])
            data, at = media[at:end].replace(b"\xff\x00", b"\xff"), end
            _read_scan(frame.coefficients[which], data, tables.get(body[2] >> 4, {}), tables.get(16 | body[2] & 15, {}), body[3], body[4], body[5] >> 4, body[5] & 15)


def payload_of(frame: Frame) -> bytes:
    """The payload bytes from the coefficients of a file that encode() has made."""
    (size,) = struct.unpack(">Q", frame.comment)
    out = []
    for co in frame.coefficients:
        v = np.where(co > 0, co, co + 255)
        dc = co[:, 0]
        v[:, 0] = np.where(np.arange(len(dc)) % 2 == 0, dc - 512, -dc)
        out.append(v.astype(np.uint8))
    return np.concatenate(out).tobytes()[:size]


def rgb_of(frame: Frame) -> np.ndarray:
    """Full-resolution RGB tensor, height x width x 3."""
    planes = []
    most_h, most_v = max(s[1] for s in frame.sampling), max(s[2] for s in frame.sampling)
    for (_, h, v, step), co, (down, across) in zip(frame.sampling, frame.coefficients, frame.shape):
        pixels = (co.astype(np.float32) * frame.steps[step]) @ IDCT
        plane = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.float32).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        planes.append(plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def payload_for(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def _store(batches):
    for batch in batches:
        for part in slices(batch, 4 << 20):
            raw = texts_of(part)
            media = [encode(payload_for(t)) for t in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8")) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _load(batches):
    for batch in batches:
        for part in slices(batch, 2 << 20, "media"):
            payload, tensors, shapes, means = [], [], [], []
            for m in part.column(part.schema.get_field_index("media")).to_pylist():
                frame = decode(m)
                rgb = rgb_of(frame)
                payload.append(payload_of(frame))
                tensors.append(rgb.tobytes())
                shapes.append(list(rgb.shape))
                means.append((rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])).tolist())
            cols = [part.column(0), part.column(1), part.column(2), pa.array(payload, pa.binary()), pa.array(tensors, pa.binary()), pa.array(shapes, pa.list_(pa.int32())), pa.array(means, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media", "payload", "rgb", "shape", "mean_milli"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's payload as a JPEG file. Null text counts as empty (64 zero bytes)."""
    return map_arrow(id_text(docs), _store, "doc_id long, n_bytes long, media binary")


def load_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with payload, rgb (row-major unsigned bytes), shape and channel means in thousandths."""
    return map_arrow(stored.select("doc_id", "n_bytes", "media"), _load, "doc_id long, n_bytes long, media binary, payload binary, rgb binary, shape array<int>, mean_milli array<long>")


def store_and_load(docs: DataFrame) -> DataFrame:
    """store_texts and load_media one after the other in the same worker."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, rgb binary, shape array<int>, mean_milli array<long>"
    return map_arrow(id_text(docs), lambda batches: _load(_store(batches)), schema)
