"""Checksums and decompressors of container files that Python's library does not have, from their published descriptions."""

from __future__ import annotations

import struct

import numpy as np

# RIPEMD-128 message order, rotations and constants of the two lines.
ORDER = (
    "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 7 4 13 1 10 6 15 3 12 0 9 5 2 14 11 8 3 10 14 4 9 15 8 1 2 7 0 6 13 11 5 12 1 9 11 10 0 8 12 4 13 3 7 15 14 5 6 2",
    "5 14 7 0 9 2 11 4 13 6 15 8 1 10 3 12 6 11 3 7 0 13 5 10 14 15 8 12 4 9 1 2 15 5 1 3 7 14 6 9 11 8 12 2 10 0 4 13 8 6 4 1 3 11 15 0 5 12 2 13 9 7 10 14",
)
ROTATE = (
    "11 14 15 12 5 8 7 9 11 13 14 15 6 7 9 8 7 6 8 13 11 9 7 15 7 12 15 9 11 7 13 12 11 13 6 7 14 9 13 15 14 8 13 6 5 12 7 5 11 12 14 15 14 15 9 8 9 14 5 6 8 6 5 12",
    "8 9 9 11 13 15 15 5 7 7 8 11 14 14 12 6 9 13 15 7 12 8 9 11 7 7 12 7 6 15 13 11 9 7 15 11 8 6 6 14 12 13 5 14 13 13 7 5 15 5 8 11 14 14 6 14 6 9 12 9 12 5 15 8",
)
ADD = ((0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC), (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

_order = [[int(x) for x in line.split()] for line in ORDER]
_rotate = [[int(x) for x in line.split()] for line in ROTATE]
_M = 0xFFFFFFFF
_mix = (
    lambda x, y, z: x ^ y ^ z,
    lambda x, y, z: (x & y) | (~x & _M & z),
    lambda x, y, z: (x | (~y & _M)) ^ z,
    lambda x, y, z: (x & z) | (y & ~z & _M),
)


def ripemd128(data: bytes) -> bytes:
    state = list(START)
    padded = data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    for at in range(0, len(padded), 64):
        x = struct.unpack("<16I", padded[at : at + 64])
        ends = []
        for line in (0, 1):
            a, b, c, d = state
            for j in range(64):
                rnd = j // 16
                t = (a + _mix[rnd if line == 0 else 3 - rnd](b, c, d) + x[_order[line][j]] + ADD[line][rnd]) & _M
                s = _rotate[line][j]
                a, d, c, b = d, c, b, ((t << s) | (t >> (32 - s))) & _M
            ends.append((a, b, c, d))
        (a, b, c, d), (e, f, g, h) = ends
        state = [(state[1] + c + h) & _M, (state[2] + d + e) & _M, (state[3] + a + f) & _M, (state[0] + b + g) & _M]
    return struct.pack("<4I", *state)


def decrypt(data: bytes, key: bytes) -> bytes:
    """Stream cipher of key-block information: swapped nibbles, chained with the byte before it as stored."""
    b = np.frombuffer(data, np.uint8)
    before = np.concatenate([np.array([0x36], np.uint8), b[:-1]])
    k = np.frombuffer(key, np.uint8)
    i = np.arange(len(b))
    return (((b << 4) | (b >> 4)) ^ before ^ i.astype(np.uint8) ^ k[i % len(k)]).astype(np.uint8).tobytes()


def encrypt(data: bytes, key: bytes) -> bytes:
    """Inverse of decrypt, for writing."""
    out, before = bytearray(), 0x36
    for i, b in enumerate(data):
        t = b ^ before ^ (i & 0xFF) ^ key[i % len(key)]
        before = ((t << 4) | (t >> 4)) & 0xFF
        out.append(before)
    return bytes(out)


class Corrupt(ValueError):
    """A block that cannot be decoded."""


def lzo1x(data: bytes, size: int) -> bytes:
    """LZO1X decompression to exactly ``size`` bytes."""
    out = bytearray()
    n, i = len(data), 0

    def count(i: int, base: int) -> tuple[int, int]:
        """A length that goes on over zero bytes."""
        extra = 0
        while i < n and data[i] == 0:
            extra += 255
            i += 1
        if i >= n:
            raise Corrupt("lzo: input ends in a length")
        return base + extra + data[i], i + 1

    def copy(distance: int, length: int) -> None:
        at = len(out) - distance
        if at < 0 or len(out) + length > size:
            raise Corrupt("lzo: match out of bounds")
        for k in range(length):
            out.append(out[at + k])

    def literals(i: int, length: int) -> int:
        if i + length > n or len(out) + length > size:
            raise Corrupt("lzo: literals out of bounds")
        out.extend(data[i : i + length])
        return i + length

    state = 0  # literals copied just before: 0 to 3, or 4 for a long run
    if n and data[0] > 17:
        length = data[0] - 17
        i = literals(1, length)
        state = length if length < 4 else 4
    while i < n:
        t = data[i]
        i += 1
        if t < 16 and state == 0:
            length, i = count(i, 18) if t == 0 else (t + 3, i)
            i = literals(i, length)
            state = 4
            continue
        if t >= 64:
            length, low = (t >> 5) + 1, 1
            distance = (data[i] << 3) + ((t >> 2) & 7) + 1
            tail = t & 3
        elif t >= 32:
            length = (t & 31) + 2
            if length == 2:
                length, i = count(i, 33)
            low = 2
            word = data[i] | data[i + 1] << 8
            distance, tail = (word >> 2) + 1, word & 3
        elif t >= 16:
            length = (t & 7) + 2
            if length == 2:
                length, i = count(i, 9)
            low = 2
            word = data[i] | data[i + 1] << 8
            distance, tail = ((t & 8) << 11) + (word >> 2), word & 3
            if distance == 0:
                break  # end of the stream
            distance += 0x4000
        else:  # a short match after literals
            low = 1
            distance = (data[i] << 2) + (t >> 2) + (0x801 if state == 4 else 1)
            length, tail = (3 if state == 4 else 2), t & 3
        i += low
        copy(distance, length)
        i = literals(i, tail)
        state = tail
    if len(out) != size:
        raise Corrupt(f"lzo: {len(out)} bytes instead of {size}")
    return bytes(out)
