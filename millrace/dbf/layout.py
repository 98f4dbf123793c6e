"""Layout of xBase table files: header, field descriptors, code pages, and the Spark schema they stand for."""

from __future__ import annotations

import datetime as dt
import os
import struct
from dataclasses import dataclass

from pyspark.sql import types as T

# What the version byte of a table says.
VERSIONS = {
    0x02: "FoxPro", 0x03: "dBase III without memo file", 0x04: "dBase IV without memo file", 0x05: "dBase V without memo file", 0x07: "Visual Objects 1.x",
    0x30: "Visual FoxPro", 0x31: "Visual FoxPro with AutoIncrement field", 0x43: "dBASE IV SQL table files, no memo", 0x63: "dBASE IV SQL system files, no memo",
    0x7B: "dBase IV with memo file", 0x83: "dBase III with memo file", 0x87: "Visual Objects 1.x with memo file", 0x8B: "dBase IV with memo file",
    0x8E: "dBase IV with SQL table", 0xCB: "dBASE IV SQL table files, with memo", 0xF5: "FoxPro with memo file", 0xFB: "FoxPro without memo file",
}
FOXPRO = frozenset((0x30, 0x31, 0xF5, 0xFB))

# Language driver byte -> code page (absent bytes are 1252).
CODE_PAGES = {
    0x01: 437, 0x02: 850, 0x03: 1252, 0x08: 865, 0x09: 437, 0x0A: 850, 0x0B: 437, 0x0D: 437, 0x0E: 850, 0x0F: 437, 0x10: 850, 0x11: 437, 0x12: 850, 0x13: 932,
    0x14: 850, 0x15: 437, 0x16: 850, 0x17: 865, 0x18: 437, 0x19: 437, 0x1A: 850, 0x1B: 437, 0x1C: 863, 0x1D: 850, 0x1F: 852, 0x22: 852, 0x23: 852, 0x24: 860,
    0x25: 850, 0x26: 866, 0x37: 850, 0x40: 852, 0x4D: 936, 0x4E: 949, 0x4F: 950, 0x50: 874, 0x57: 1252, 0x58: 1252, 0x59: 1252, 0x64: 852, 0x65: 866, 0x66: 865,
    0x67: 861, 0x6A: 737, 0x6B: 857, 0x6C: 863, 0x78: 950, 0x79: 949, 0x7A: 936, 0x7B: 932, 0x7C: 874, 0x7D: 1255, 0x7E: 1256, 0x86: 737, 0x87: 852, 0x88: 857, 0xC8: 1250, 0xC9: 1251,
    0xCA: 1254, 0xCB: 1253, 0xCC: 1257,
}
CODECS = {b: "gbk" if p == 936 else f"cp{p}" for b, p in CODE_PAGES.items()} | {0x04: "mac_roman", 0x00: "ascii", 0x96: "mac_cyrillic", 0x97: "mac_latin2", 0x98: "mac_greek", 0xF0: "utf-8"}
UNSUPPORTED = {0x68: 895, 0x69: 620}


def codec_of(driver: int) -> str:
    if driver in UNSUPPORTED:
        raise ValueError(f"code page {UNSUPPORTED[driver]} of language driver 0x{driver:02X} isn't available; name an encoding")
    return CODECS.get(driver, "cp1252")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    start: int
    length: int
    decimals: int
    ordinal: int


@dataclass(frozen=True)
class Layout:
    version: int
    updated: dt.date | None
    records: int  # what the header says; never bounds a scan
    header_length: int
    record_length: int
    driver: int
    fields: tuple[Field, ...]
    encoding: str
    offset: int

    @property
    def foxpro(self) -> bool:
        return self.version in FOXPRO

    @property
    def description(self) -> str:
        return VERSIONS.get(self.version, "Unknown")

    def count(self, size: int) -> int:
        """Whole records in a file of ``size`` bytes."""
        return max(0, (size - self.offset - self.header_length) // self.record_length) if self.record_length else 0


def read_layout(path: str, encoding: str | None = None, offset: int = 0) -> Layout:
    """Header and descriptors; the address a descriptor stores is ignored, fields follow each other behind the status byte."""
    with open(path, "rb") as f:
        f.seek(offset)
        head = f.read(32)
        if len(head) < 32:
            raise ValueError(f"{path}: no table header")
        version, yy, mm, dd, records, header_length, record_length = struct.unpack_from("<BBBBIHH", head)
        driver = head[29]
        codec = encoding or codec_of(driver)
        fields, start = [], 1
        while True:
            d = f.read(32)
            if len(d) < 32 or d[0] == 0x0D:
                break
            name = d[:11].split(b"\0", 1)[0].decode(codec, "replace")
            kind = chr(d[11])
            length, decimals = (struct.unpack_from("<h", d, 16)[0], 0) if kind in "CW" else (d[16], d[17])
            fields.append(Field(name, kind, start, length, decimals, len(fields)))
            start += length
    try:
        updated = dt.date(1900 + yy, mm, dd)
    except ValueError:
        updated = None
    return Layout(version, updated, records, header_length, record_length, driver, tuple(fields), codec, offset)


def spark_type(f: Field, floats_as_decimals: bool = False) -> T.DataType:
    if f.type == "N" or f.type == "F" and floats_as_decimals:
        if f.decimals == 0 and f.type == "N":
            return T.IntegerType() if f.length < 10 else T.LongType()
        return T.DecimalType(min(max(f.length, f.decimals, 1), 38), min(f.decimals, 38))
    if f.type == "I":
        return T.LongType()
    return {"F": T.FloatType(), "B": T.DoubleType(), "Y": T.DecimalType(19, 4), "D": T.DateType(), "T": T.TimestampNTZType(), "L": T.BooleanType()}.get(f.type, T.StringType())


def spark_schema(layout: Layout, floats_as_decimals: bool = False) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, spark_type(f, floats_as_decimals), True, {"dbf_type": f.type, "start": f.start, "length": f.length, "decimals": f.decimals, "ordinal": f.ordinal}) for f in layout.fields]
    )


def memo_path(path: str) -> str | None:
    stem = os.path.splitext(path)[0]
    return next((stem + e for e in (".fpt", ".FPT", ".dbt", ".DBT") if os.path.exists(stem + e)), None)
