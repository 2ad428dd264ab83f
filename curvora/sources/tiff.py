"""TIFF files to arrays and back: strips and tiles, PackBits, LZW and Deflate, horizontal differences, 8 to 32 bits.

Files are read as whole binaries by Spark, from any store that it reads, and decoded one a row in tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: tags, compressions, sizes of field types, kinds of samples.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}
CLEAR, END = 256, 257


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count byte up to 127 before so many bytes and one more, above 128 before one byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def codes_of(data: bytes) -> Iterator[int]:
    """LZW codes, highest bit first; the next width comes one code early."""
    held, bits, width, known = 0, 0, 9, END + 1
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        yield code
        if code == END:
            return
        known = END + 1 if code == CLEAR else known + 1
        width = min(12, max(9, known.bit_length()))


def unpack_lzw(data: bytes) -> bytes:
    table, last, out = [], b"", bytearray()
    for code in codes_of(data):
        if code == END:
            break
        if code == CLEAR:
            table, last = [bytes([i]) for i in range(256)] + [b"", b""], b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
    return bytes(out)


UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for entry in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind in TYPES:
            size = struct.calcsize(TYPES[kind]) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place)
    return order, fields


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image: height x width, or height x width x channels, in its own type."""
    order, fields = directory(data)
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, kind, packing = set(fields.get(BITS, (1,))), KINDS.get(one(SAMPLE_FORMAT, 1)), one(COMPRESSION, NONE)
    if len(bits) != 1 or not bits <= {8, 16, 32} or kind is None or packing not in UNPACK:
        raise ValueError(f"unsupported TIFF: bits {sorted(bits)}, compression {packing}")
    size = bits.pop() // 8
    dtype = np.dtype(f"{order}{kind}{size}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    depth = samples // planes
    if TILE_OFFSETS in fields:
        high, wide, offsets, lengths = one(TILE_HEIGHT), one(TILE_WIDTH), fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        high, wide, offsets = min(one(ROWS_PER_STRIP, height), height), width, fields[STRIP_OFFSETS]
        lengths = fields.get(STRIP_BYTES, (len(data) - offsets[0],))
    out = np.zeros((planes, height, width, depth), dtype.newbyteorder("="))
    across = -(-width // wide)
    for k, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
        plane, piece = divmod(k, across * -(-height // high))
        y, x = piece // across * high, piece % across * wide
        rows = high if TILE_OFFSETS in fields else min(high, height - y)
        raw = UNPACK[packing](data[offset : offset + length])
        block = np.frombuffer(raw[: rows * wide * depth * size], dtype).reshape(rows, wide, depth).astype(out.dtype)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("unsupported TIFF predictor")
        kept = block[: height - y, : width - x]
        out[plane, y : y + kept.shape[0], x : x + kept.shape[1]] = kept
    values = out[0] if planes == 1 else np.moveaxis(out[..., 0], 0, -1)
    return values[..., 0] if samples == 1 else values


def encode_tiff(values: np.ndarray, predictor: bool = False) -> bytes:
    """One Deflate strip of 8- or 16-bit gray or RGB, little-endian."""
    values = np.ascontiguousarray(values if values.ndim == 3 else values[..., None])
    height, width, samples = values.shape
    if values.dtype not in (np.uint8, np.uint16):
        raise ValueError(f"unsupported type {values.dtype}")
    body = np.diff(values, axis=1, prepend=np.zeros_like(values[:, :1])) if predictor else values
    packed = zlib.compress(body.astype(values.dtype.newbyteorder("<")).tobytes())
    bits = struct.pack(f"<{samples}H", *[values.dtype.itemsize * 8] * samples)
    fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, samples, bits), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 2 if samples > 1 else 1), (STRIP_OFFSETS, 4, 1, None), (SAMPLES, 3, 1, samples), (ROWS_PER_STRIP, 4, 1, height), (STRIP_BYTES, 4, 1, len(packed)), (PREDICTOR, 3, 1, 2 if predictor else 1)]
    after = 8 + 2 + 12 * len(fields) + 4
    place = after + (len(bits) if len(bits) > 4 else 0)
    head = b"II*\0" + struct.pack("<IH", 8, len(fields))
    for tag, kind, count, value in fields:
        if tag == BITS and len(bits) > 4:
            value = struct.pack("<I", after)
        elif tag == BITS:
            value = bits.ljust(4, b"\0")
        else:
            value = struct.pack("<I", place if value is None else value)
        head += struct.pack("<HHI", tag, kind, count) + value
    return head + b"\0\0\0\0" + (bits if len(bits) > 4 else b"") + packed
