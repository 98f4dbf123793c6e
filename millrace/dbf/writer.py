"""Writes tables, memo files and compound indexes; made for fixtures and round trips."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterable, Sequence
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.cdx.keys import encode_date, encode_double, encode_integer
from millrace.dbf.decode import JULIAN_EPOCH, ascii_like

Column = tuple[str, str, int, int]  # name, type, length, decimals


def _cell(kind: str, length: int, decimals: int, v: Any, encoding: str, memo) -> bytes:
    if isinstance(v, bytes):
        return v.ljust(length, b" ")[:length]
    if kind in "CG":
        return ("" if v is None else str(v)).encode(encoding, "replace")[:length].ljust(length, b" ") if v is not None else b"\0" * length
    if kind == "W":
        return b"\0" * length if v is None else str(v).encode("utf-16-le")[:length].ljust(length, b"\0")
    if kind in "NF":
        if v is None:
            return b" " * length
        text = f"{v:.{decimals}f}" if decimals else str(int(v))
        if len(text) > length:
            raise ValueError(f"{text} needs more than {length} characters")
        return text.encode().rjust(length)
    if kind == "I":
        return struct.pack("<i", v or 0)
    if kind == "B":
        return struct.pack("<d", v or 0.0)
    if kind == "Y":
        return struct.pack("<q", int(Decimal(v or 0).scaleb(4)))
    if kind == "D":
        return b" " * 8 if v is None else v.strftime("%Y%m%d").rjust(8, "0").encode()
    if kind == "T":
        if v is None:
            return b"\0" * 8
        days = v.toordinal() - dt.date(1970, 1, 1).toordinal() + JULIAN_EPOCH
        return struct.pack("<ii", days, ((v.hour * 60 + v.minute) * 60 + v.second) * 1000 + v.microsecond // 1000)
    if kind == "L":
        return b"?" if v is None else b"T" if v else b"F"
    if kind == "M":
        n = memo.add(v) if memo is not None and v else None
        if length == 4:
            return struct.pack("<I", n or 0)
        return str(n).encode().rjust(10) if n else b" " * 10
    return b"\0" * length


def _cells(kind: str, length: int, decimals: int, values: pa.Array, encoding: str) -> np.ndarray:
    """What ``_cell`` gives for each value (records x bytes), at once where the values are plain."""
    n, null = len(values), values.is_null().to_numpy(zero_copy_only=False)
    if kind == "I" and pa.types.is_integer(values.type):
        return values.fill_null(0).cast(pa.int32()).to_numpy().astype("<i4").view(np.uint8).reshape(n, 4)
    if kind == "B" and pa.types.is_floating(values.type):
        return values.fill_null(0).cast(pa.float64()).to_numpy().astype("<f8").view(np.uint8).reshape(n, 8)
    if kind == "T" and pa.types.is_timestamp(values.type):
        wall = pc.local_timestamp(values) if values.type.tz else values
        days, micros = np.divmod(wall.cast(pa.timestamp("us"), safe=False).cast(pa.int64()).fill_null(0).to_numpy(), 86_400_000_000)
        pair = np.stack([days + JULIAN_EPOCH, micros // 1000], axis=1)
        pair[null] = 0
        return pair.astype("<i4").view(np.uint8).reshape(n, 8)
    text = None
    if kind == "N" and not decimals and pa.types.is_integer(values.type):
        text = pc.utf8_lpad(values.cast(pa.string()).fill_null(""), length)
    elif kind == "C" and pa.types.is_string(values.type) and ascii_like(encoding) and pc.all(pc.string_is_ascii(values), min_count=0).as_py():
        text = pc.utf8_rpad(pc.utf8_slice_codeunits(values.fill_null(""), 0, length), length)
    if text is not None and pc.all(pc.equal(pc.binary_length(text), length), min_count=0).as_py():
        out = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8).reshape(n, length).copy()
        if kind == "C":
            out[null] = 0
        return out
    return np.frombuffer(b"".join(_cell(kind, length, decimals, v, encoding, None) for v in values.to_pylist()), np.uint8).reshape(n, length)


def encode_records(columns: Sequence[Column], arrays: Sequence[pa.Array], deleted: np.ndarray, encoding: str) -> np.ndarray:
    """Records of a table without memos (records x bytes), its status bytes first."""
    status = np.where(deleted, np.uint8(0x2A), np.uint8(0x20)).reshape(-1, 1)
    return np.ascontiguousarray(np.concatenate([status, *(_cells(k, size, d, v, encoding) for (_, k, size, d), v in zip(columns, arrays))], axis=1))


class MemoWriter:
    def __init__(self, kind: str, encoding: str):
        self.kind, self.encoding = kind, encoding
        self.block = 64 if kind == "foxpro" else 512
        self.data = bytearray(512)

    def add(self, text: str) -> int:
        raw = text.encode(self.encoding, "replace")
        self.data += b"\0" * (-len(self.data) % self.block)
        n = len(self.data) // self.block
        if self.kind == "foxpro":
            self.data += struct.pack(">ii", 1, len(raw)) + raw
        elif self.kind == "four":
            self.data += b"\xff\xff\x08\x00" + struct.pack("<i", len(raw) + 8) + raw
        else:
            self.data += raw + b"\x1a\x1a"
        return n

    def finish(self) -> bytes:
        self.data += b"\0" * (-len(self.data) % self.block)
        if self.kind == "foxpro":
            self.data[:8] = struct.pack(">IHh", len(self.data) // self.block, 0, self.block)
        else:
            self.data[:4] = struct.pack("<I", len(self.data) // self.block)
        return bytes(self.data)


def table_header(columns: Sequence[Column], records: int, version: int = 0x03, driver: int = 0x03, encoding: str = "cp1252") -> bytes:
    record_length = 1 + sum(c[2] for c in columns)
    out = bytearray(struct.pack("<BBBBIHH", version, 124, 1, 15, records, 32 + 32 * len(columns) + 1, record_length).ljust(32, b"\0"))
    out[29] = driver
    for name, k, size, d in columns:
        size_bytes = struct.pack("<h", size) if k in "CW" else bytes((size, d))
        out += name.encode(encoding)[:10].ljust(11, b"\0") + k.encode() + b"\0" * 4 + size_bytes + b"\0" * 14
    return bytes(out) + b"\r"


def write_dbf(path: str, columns: Sequence[Column], rows: Iterable[Sequence[Any]], deleted: Iterable[int] = (), version: int = 0x03, driver: int = 0x03, encoding: str = "cp1252", records: int | None = None, tail: bytes = b"\x1a") -> int:
    """Writes the table and, where a column is a memo, the side file of the version's format; gives the number of rows."""
    kind = "foxpro" if version in (0x30, 0x31, 0xF5, 0xFB) else "three" if version == 0x83 else "four"
    memo = MemoWriter(kind, encoding) if any(c[1] == "M" for c in columns) else None
    gone, body, n = set(deleted), [], 0
    for n, row in enumerate(rows, 1):
        body.append((b"*" if n - 1 in gone else b" ") + b"".join(_cell(k, size, d, v, encoding, memo) for (_, k, size, d), v in zip(columns, row)))
    head = table_header(columns, n if records is None else records, version, driver, encoding)
    with open(path, "wb") as f:
        f.write(head + b"".join(body) + tail)
    if memo:
        with open(path.rsplit(".", 1)[0] + (".fpt" if kind == "foxpro" else ".dbt"), "wb") as f:
            f.write(memo.finish())
    return n


def _leaf(entries: list[tuple[bytes, int]], key_length: int, pad: int, left: int, right: int, attributes: int) -> bytes | None:
    """One 512-byte leaf of all ``entries``, or None where they don't fit."""
    bits_count = max(1, key_length.bit_length())
    rec_bits = 32 - 2 * bits_count if key_length < 256 else 24
    size = (rec_bits + 2 * bits_count + 7) // 8
    front, back, before = bytearray(), b"", b""
    for key, rec in entries:
        bare = key.rstrip(bytes((pad,)))
        trailing = key_length - len(bare)
        same = 0
        while same < min(len(bare), len(before)) and bare[same] == before[same]:
            same += 1
        front += ((trailing << bits_count | same) << rec_bits | rec).to_bytes(8, "little")[:size]
        back = bare[same:] + back
        before = bare
    if len(front) + len(back) > 488:
        return None
    head = struct.pack("<HHiiHIBBBBBB", attributes, len(entries), left, right, 488 - len(front) - len(back), (1 << rec_bits) - 1, (1 << bits_count) - 1, (1 << bits_count) - 1, rec_bits, bits_count, bits_count, size)
    return head + bytes(front) + b"\0" * (488 - len(front) - len(back)) + back


def _tree(entries: list[tuple[bytes, int]], key_length: int, pad: int, base: int) -> tuple[list[bytes], int]:
    """Nodes from offset ``base`` on, and the offset of the root."""
    leaves: list[list[tuple[bytes, int]]] = [[]]
    for e in entries:
        if _leaf([*leaves[-1], e], key_length, pad, -1, -1, 2) is None:
            leaves.append([])
        leaves[-1].append(e)
    at = lambda i: base + 512 * i
    last = len(leaves) - 1
    nodes = [_leaf(x, key_length, pad, at(i - 1) if i else -1, at(i + 1) if i < last else -1, 2 | (last == 0)) for i, x in enumerate(leaves)]
    level = [(x[-1][0] if x else b"\0" * key_length, x[-1][1] if x else 0, at(i)) for i, x in enumerate(leaves)]
    while len(level) > 1:
        room = max(2, 500 // (key_length + 8))
        groups = [level[i : i + room] for i in range(0, len(level), room)]
        first, level = len(nodes), []
        for i, g in enumerate(groups):
            body = b"".join(k.ljust(key_length, bytes((pad,))) + struct.pack(">II", r, o) for k, r, o in g)
            nodes.append(struct.pack("<HHii", int(len(groups) == 1), len(g), at(first + i - 1) if i else -1, at(first + i + 1) if i < len(groups) - 1 else -1) + body.ljust(500, b"\0"))
            level.append((g[-1][0], g[-1][1], at(first + i)))
    return nodes, level[0][2]


def write_cdx(path: str, tags: dict[str, tuple[str, str, int, Iterable[tuple[Any, int]]]], options: dict[str, int] | None = None, descending: Iterable[str] = ()) -> None:
    """``tags``: name -> (key expression, field type, field length, pairs of value and 1-based record number)."""
    encoded = {}
    for name, (expression, kind, length, pairs) in tags.items():
        if kind == "C":
            size, pad, key = length, 0x20, lambda v, n=length: str(v).encode("cp1252", "replace")[:n].ljust(n)
        elif kind == "I":
            size, pad, key = 4, 0, lambda v: encode_integer(int(v))
        elif kind == "D":
            size, pad, key = 8, 0, encode_date
        else:
            size, pad, key = 8, 0, lambda v: encode_double(float(v))
        encoded[name] = (expression, size, pad, sorted((key(v), r) for v, r in pairs if v is not None))
    header = lambda root, size, opts, expression, order=0: (struct.pack("<IiIHBB", root, -1, 0, size, opts, 1).ljust(502, b"\0") + struct.pack("<HHHHH", order, 0, 1, 0, len(expression) + 1) + expression.encode() + b"\0").ljust(1024, b"\0")
    at, blocks, offsets = 1024 + 512 * (1 + len(tags) // 8), [], {}
    for name, (expression, size, pad, entries) in encoded.items():
        nodes, root = _tree(entries, size, pad, at + 1024)
        offsets[name] = at
        blocks.append(header(root, size, 0x60 | (options or {}).get(name, 0), expression, int(name in set(descending))) + b"".join(nodes))
        at += len(blocks[-1])
    directory, root = _tree(sorted((n.upper().encode().ljust(10), o) for n, o in offsets.items()), 10, 0x20, 1024)
    room = 512 * (1 + len(tags) // 8)
    body = b"".join(directory)
    if len(body) > room:
        raise ValueError("too many tags")
    with open(path, "wb") as f:
        f.write(header(root, 10, 0xE0, "") + body.ljust(room, b"\0") + b"".join(blocks))
