"""Blosc 1 frames with Zstandard inside: one block a frame, byte or bit shuffled. Written from the format's public description."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<BBBBIII")
#: Format versions, flag bits and the compressor's number.
VERSION, CODEC_VERSION = 2, 1
SHUFFLE, MEMCPY, BITSHUFFLE, ONE_STREAM, ZSTD = 0x01, 0x02, 0x04, 0x10, 4 << 5


def bitshuffle(data: bytes, size: int) -> bytes:
    """Bit k of all elements together, for every k; a number of elements that isn't a multiple of 8 stays as it is."""
    n = len(data) // size
    if n % 8 or not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(n, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def unbitshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    if n % 8 or not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def shuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size).T.tobytes() + data[n * size :]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def compress(data: bytes, size: int, level: int, bits: bool) -> bytes:
    import zstandard

    flags = ONE_STREAM | ZSTD | (BITSHUFFLE if bits else SHUFFLE if size > 1 else 0)
    mixed = bitshuffle(data, size) if bits else shuffle(data, size) if size > 1 else data
    # levels 1 to 9 spread over Zstandard's; 0 stores
    body = zstandard.ZstdCompressor(level=1 if level <= 1 else 2 * level - 1).compress(mixed) if level and data else mixed
    if len(body) >= len(data):
        return HEADER.pack(VERSION, CODEC_VERSION, MEMCPY | ZSTD, size, len(data), max(1, len(data)), len(data) + 16) + data
    whole = HEADER.size + 4 + 4 + len(body)
    return HEADER.pack(VERSION, CODEC_VERSION, flags, size, len(data), len(data), whole) + struct.pack("<ii", HEADER.size + 4, len(body)) + body


def decompress(frame: bytes) -> bytes:
    import zstandard

    _, _, flags, size, total, block, _ = HEADER.unpack_from(frame)
    if flags & MEMCPY:
        return bytes(frame[16 : 16 + total])
    if flags >> 5 != ZSTD >> 5:
        raise ValueError("only Zstandard frames are supported")
    out, count = [], -(-total // block)
    for k, start in enumerate(struct.unpack_from(f"<{count}i", frame, 16)):
        length = min(block, total - k * block)
        streams = 1 if flags & ONE_STREAM or length < block else size
        parts, at = [], start
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", frame, at)
            part = frame[at + 4 : at + 4 + n]
            parts.append(part if n == length // streams else zstandard.ZstdDecompressor().decompress(part, max_output_size=length // streams))
            at += 4 + n
        mixed = b"".join(parts)
        out.append(unbitshuffle(mixed, size) if flags & BITSHUFFLE else unshuffle(mixed, size) if flags & SHUFFLE and size > 1 else mixed)
    return b"".join(out)
