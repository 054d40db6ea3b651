"""Planes in TIFF files: directories, strips and their compression."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# TIFF tags, sizes of field types, numpy kinds of sample formats, numbers of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 339
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
CLEAR, END, WIDEST = 256, 257, 12


def from_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a code is widened one entry before it has to be."""
    out, table, width, before, bits, have = bytearray(), [], 9, b"", 0, 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("not a sequence of LZW codes")
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
            width = min(max(9, (len(table) + 1).bit_length()), WIDEST)
        before = entry
    return bytes(out)


def to_lzw(data: bytes) -> bytes:
    bits, have, width = CLEAR, 9, 9
    out, table, before = bytearray(), {bytes([k]): k for k in range(256)}, b""
    n = 258

    def grown() -> bool:
        """After one more entry: whether the table is full."""
        nonlocal n, width
        n += 1
        width = min(n.bit_length(), WIDEST)
        return n == (1 << WIDEST) - 2

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    for k in range(len(data)):
        longer = before + data[k : k + 1]
        if longer in table:
            before = longer
            continue
        put(table[before])
        table[longer] = n
        if grown():
            put(CLEAR)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        before = data[k : k + 1]
    if before:
        put(table[before])
        if grown():
            put(CLEAR)
            width = 9
    put(END)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def from_packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += data[k + 1 : k + 2] * (257 - n)
                k += 1
            k += 1
    return bytes(out)


def to_packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as it stands."""
    a = np.frombuffer(data, np.uint8)
    begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for k, n in zip(begins.tolist(), np.diff(np.r_[begins, len(a)]).tolist()):
        if n < 3:
            plain.extend(data[k : k + n])
            continue
        flush()
        while n:
            run = min(n, 128)
            out += bytes([257 - run, data[k]]) if run > 1 else bytes([0, data[k]])
            n -= run
    flush()
    return bytes(out)


UNPACK = {NONE: bytes, LZW: from_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: from_packbits}
PACK = {NONE: bytes, LZW: to_lzw, DEFLATE: zlib.compress, PACKBITS: to_packbits}


@dataclass(frozen=True)
class Layout:
    """Byte order and widths of a file: classic TIFF, or BigTIFF with 64-bit offsets."""

    order: str
    big: bool
    first: int

    @classmethod
    def of(cls, f) -> "Layout":
        f.seek(0)
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        number = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if number not in (42, 43):
            raise ValueError("not a TIFF")
        return cls(order, number == 43, struct.unpack(order + ("Q" if number == 43 else "I"), head[8:16] if number == 43 else head[4:8])[0])

    def entries(self, f, at: int) -> tuple[int, int, int]:
        """Number of tags of the directory at `at`, where they begin, and where the next directory is (0: nowhere)."""
        f.seek(at)
        head, entry, offset = (8, 20, "Q") if self.big else (2, 12, "I")
        n = struct.unpack(self.order + ("Q" if self.big else "H"), f.read(head))[0]
        f.seek(at + head + n * entry)
        return n, at + head, struct.unpack(self.order + offset, f.read(struct.calcsize(offset)))[0]

    def pages(self, f) -> list[int]:
        """Where the directories are; only their lengths and links are read."""
        out, at = [], self.first
        while at:
            if at in out:
                raise ValueError("directories in a circle")
            out.append(at)
            at = self.entries(f, at)[2]
        return out


class Page:
    """One plane of a file."""

    def __init__(self, f, layout: Layout, at: int):
        n, begin, _ = layout.entries(f, at)
        size, count, room = (20, "Q", 8) if layout.big else (12, "I", 4)
        f.seek(begin)
        table, tags = f.read(n * size), {}
        for k in range(n):
            row = table[k * size : (k + 1) * size]
            tag, kind = struct.unpack(layout.order + "HH", row[:4])
            many = struct.unpack(layout.order + count, row[4 : 4 + room])[0]
            if kind in FIELDS:
                form = f"{layout.order}{many}{FIELDS[kind]}"
                value = row[4 + room :]
                if struct.calcsize(form) > room:
                    f.seek(struct.unpack(layout.order + count, value)[0])
                    value = f.read(struct.calcsize(form))
                tags[tag] = struct.unpack(form, value[: struct.calcsize(form)])
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.compression, self.predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if self.compression not in UNPACK or one(SAMPLES, 1) != 1 or TILE_WIDTH in tags or self.predictor not in (1, 2):
            raise ValueError("only strips of one sample a pixel are read, plain or as LZW, Deflate or PackBits")
        self.shape = one(HEIGHT, 0), one(WIDTH, 0)
        self.dtype = np.dtype(f"{layout.order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
        self.rows = min(one(ROWS, self.shape[0]), self.shape[0])
        self.strips = list(zip(tags[OFFSETS], tags.get(COUNTS, (self.shape[0] * self.shape[1] * self.dtype.itemsize,))))

    def parts(self, f) -> Iterator[tuple[int, np.ndarray]]:
        """First row and pixels of each strip."""
        for k, (offset, count) in enumerate(self.strips):
            f.seek(offset)
            rows = min(self.rows, self.shape[0] - k * self.rows)
            data = UNPACK[self.compression](f.read(count))
            part = np.frombuffer(data, self.dtype, rows * self.shape[1]).reshape(rows, self.shape[1])
            if self.predictor == 2:
                part = np.cumsum(part, 1, dtype=self.dtype.newbyteorder("="))
            yield k * self.rows, part

    def plane(self, f) -> np.ndarray:
        return np.concatenate([part for _, part in self.parts(f)])


def decode_tiff(data: bytes) -> list[np.ndarray]:
    """All planes of a file."""
    f = io.BytesIO(data)
    layout = Layout.of(f)
    return [Page(f, layout, at).plane(f) for at in layout.pages(f)]


def encode_stack(planes: np.ndarray, compression: str = "none", rows: int = 0, differences: bool = False) -> bytes:
    """Planes as directories of one file, in strips of `rows` lines (0: a plane), with `differences` of neighbours in a line
    (integers only) instead of values."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for plane in planes:
        plane = np.ascontiguousarray(plane.astype(plane.dtype.newbyteorder("<")))
        height, step = plane.shape[0], rows or plane.shape[0]
        stored = np.diff(plane, axis=1, prepend=np.zeros((height, 1), plane.dtype)).astype(plane.dtype) if differences else plane
        strips = [PACK[NAMES[compression]](stored[k : k + step].tobytes()) for k in range(0, height, step)]
        offsets, counts = [], []
        for strip in strips:
            out += b"\0" * (len(out) % 2)
            offsets.append(len(out))
            counts.append(len(strip))
            out += strip
        out += b"\0" * (len(out) % 2)
        places = {}
        for tag, values in ((OFFSETS, offsets), (COUNTS, counts)):
            places[tag] = len(out) if len(values) > 1 else values[0]
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        kind = {v: k for k, v in KINDS.items()}[plane.dtype.kind]
        tags = [(WIDTH, 4, 1, plane.shape[1]), (HEIGHT, 4, 1, height), (BITS, 3, 1, plane.itemsize * 8), (COMPRESSION, 3, 1, NAMES[compression]), (PHOTOMETRIC, 3, 1, 1), (OFFSETS, 4, len(strips), places[OFFSETS])]
        tags += [(SAMPLES, 3, 1, 1), (ROWS, 4, 1, step), (COUNTS, 4, len(strips), places[COUNTS]), (PREDICTOR, 3, 1, 1 + differences), (FORMAT, 3, 1, kind)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def encode_tiff(plane: np.ndarray, **how) -> bytes:
    return encode_stack(plane[None], **how)
