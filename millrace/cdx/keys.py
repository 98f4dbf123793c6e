"""Index keys: byte strings whose order is the order of the values."""

from __future__ import annotations

import datetime as dt
import struct

JULIAN_DAY_ONE = 1721425  # Julian day of ordinal 0


def encode_integer(v: int) -> bytes:
    return struct.pack(">I", (v + (1 << 31)) & 0xFFFFFFFF)


def decode_integer(key: bytes) -> int:
    return struct.unpack(">I", key.ljust(4, b"\0"))[0] - (1 << 31)


def encode_double(v: float) -> bytes:
    bits = struct.unpack(">Q", struct.pack(">d", v + 0.0))[0]
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def decode_double(key: bytes) -> float:
    bits = struct.unpack(">Q", key.ljust(8, b"\0"))[0]
    return struct.unpack(">d", struct.pack(">Q", bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)))[0]


def julian_day(d: dt.date) -> int:
    return d.toordinal() + JULIAN_DAY_ONE


def encode_date(d: dt.date) -> bytes:
    return encode_double(float(julian_day(d)))


def compare(a: bytes, b: bytes, length: int, pad: int) -> int:
    """Trimmed bytes count as padding."""
    x, y = a[:length].ljust(length, bytes((pad,))), b[:length].ljust(length, bytes((pad,)))
    return (x > y) - (x < y)
