"""Long texts kept in a side file, by block number: dBase III, dBase IV and FoxPro formats."""

from __future__ import annotations

import struct

from millrace.dbf.decode import text_decoder
from millrace.dbf.layout import Layout


class Memo:
    """Reads texts of the format that the table's version names."""

    def __init__(self, path: str, layout: Layout):
        self.file = open(path, "rb")
        self.size = self.file.seek(0, 2)
        self.decode = text_decoder(layout.encoding)
        self.kind = "foxpro" if layout.foxpro else "three" if layout.version == 0x83 else "four"
        self.block = 512
        if self.kind == "foxpro":
            self.file.seek(6)
            self.block = struct.unpack(">h", self.file.read(2))[0]
        self.seen: dict[int, str | None] = {}

    def close(self) -> None:
        self.file.close()

    def text(self, number: int) -> str | None:
        if number not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[number] = getattr(self, f"_{self.kind}")(number * self.block)
        return self.seen[number]

    def _read(self, at: int, length: int) -> bytes:
        if at + length > self.size:
            raise ValueError(f"memo block at {at} reaches beyond the memo file of {self.size} bytes")
        self.file.seek(at)
        return self.file.read(length)

    def _string(self, data: bytes) -> str | None:
        if not data or data[0] == 0:
            return None
        return self.decode(data).strip("\0 ")

    def _foxpro(self, at: int) -> str | None:
        kind, length = struct.unpack(">ii", self._read(at, 8))
        if kind != 1 or length <= 0:
            return ""
        v = self._string(self._read(at + 8, length))
        return v if v is None else v.split("\0", 1)[0].rstrip(" ")

    def _four(self, at: int) -> str | None:
        length = struct.unpack_from("<i", self._read(at, 8), 4)[0] - 8
        return "" if length <= 0 else self._string(self._read(at + 8, length))

    def _three(self, at: int) -> str | None:
        """Up to the terminator (0x1A or NUL), over as many blocks as it takes."""
        if at >= self.size:
            return ""
        parts = []
        self.file.seek(at)
        while chunk := self.file.read(self.block):
            ends = [i for i in (chunk.find(b"\x1a"), chunk.find(b"\0")) if i >= 0]
            parts.append(chunk[: min(ends)] if ends else chunk)
            if ends:
                break
        return self.decode(b"".join(parts)).strip("\0 ")
