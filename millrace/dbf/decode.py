"""Records to columns: one decoder for each field type, over all records of a block at once."""

from __future__ import annotations

import codecs
import datetime as dt
import decimal
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.dbf.layout import Field, Layout

_PLAIN_INT = re.compile(rb"[+-]?\d+")
_PLAIN_DEC = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_BLANK = b" \t\n\v\f\r"
EPOCH = dt.date(1970, 1, 1).toordinal()
JULIAN_EPOCH = 1721425 + EPOCH  # Julian day of 1970-01-01


def _passthrough(error: UnicodeDecodeError):
    """Bytes that a page leaves open stand for the character of the same number."""
    if isinstance(error, UnicodeDecodeError):
        return "".join(map(chr, error.object[error.start : error.end])), error.end
    raise error


codecs.register_error("millrace-open", _passthrough)


class DecodeError(ValueError):
    """A cell that can't be represented, with its record and column."""


def text_decoder(encoding: str) -> Callable[[bytes], str]:
    name = codecs.lookup(encoding).name
    if name == "ascii":
        return lambda b: b.decode("ascii", "replace").replace("�", "?")
    errors = "millrace-open" if name.startswith("cp125") else "replace"
    return lambda b: b.decode(encoding, errors)


def _trimmer(option: str) -> Callable[[str], str]:
    return {"none": lambda s: s, "trim": lambda s: s.strip(" "), "trimstart": lambda s: s.lstrip(" "), "trimend": lambda s: s.rstrip(" ")}[option.lower()]


def _cells(block: np.ndarray, f: Field) -> list[bytes]:
    flat = np.ascontiguousarray(block[:, f.start : f.start + f.length])
    return [x.tobytes() for x in flat]


def _number_text(cell: bytes) -> bytes | None:
    if not cell or cell[0] == 0:
        return None
    return cell.rstrip(b"\0").strip(_BLANK) or None


def _binary(block: np.ndarray, f: Field, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(block[:, f.start : f.start + width]).view(dtype).ravel()


_ASCII_LIKE = ("ascii", "utf-8", "cp437", "cp737", "cp850", "cp852", "cp857", "cp860", "cp861", "cp863", "cp865", "cp866", "cp874", "mac_roman")
_TRIMS = {"none": None, "trim": pc.utf8_trim, "trimstart": pc.utf8_ltrim, "trimend": pc.utf8_rtrim}


def ascii_like(encoding: str) -> bool:
    """Whether ASCII texts are the same bytes in this code page."""
    name = codecs.lookup(encoding).name.replace("-roman", "_roman")
    return name in _ASCII_LIKE or name.startswith("cp125")


def _plain_text(cells: np.ndarray) -> pa.Array | None:
    """Cells of ASCII alone as texts without trailing NULs, null where the first byte is NUL; None where there are others."""
    if cells.size == 0 or cells.max() > 127:
        return None
    text = pa.array(cells.view(f"S{cells.shape[1]}").ravel(), pa.binary()).cast(pa.string())
    empty = cells[:, 0] == 0
    return pc.if_else(pa.array(empty), pa.scalar(None, pa.string()), text) if empty.any() else text


def _plain_numbers(cells: np.ndarray, form: str, kind: pa.DataType) -> pa.Array | None:
    """Numbers where every cell is blank or of the plain form; None where one isn't, for the cell by cell way."""
    text = _plain_text(cells)
    if text is None:
        return None
    text = pc.utf8_trim(text, " ")
    text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
    fits = pc.match_substring_regex(text, form)
    if not pc.all(fits, min_count=0).as_py():
        return None
    try:
        return text.cast(kind)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


def decode_column(block: np.ndarray, f: Field, layout: Layout, trimming: str, floats_as_decimals: bool, first: int, memo=None) -> pa.Array:
    """The values of one field over ``block`` (records x bytes); ``first`` numbers its first record."""
    kind = f.type
    if kind in "CGW":
        if kind != "W" and ascii_like(layout.encoding):
            text = _plain_text(np.ascontiguousarray(block[:, f.start : f.start + f.length]))
            if text is not None:
                cut = _TRIMS[trimming.lower()]
                return text if cut is None else cut(text, " ")
        decode = text_decoder("utf-16-le" if kind == "W" else layout.encoding)
        trim = _trimmer(trimming)
        out: list = []
        seen: dict[bytes, str] = {}
        for cell in _cells(block, f):
            if not cell or cell[0] == 0 and (kind != "W" or cell[:2] == b"\0\0"):
                out.append(None)
                continue
            v = seen.get(cell)
            if v is None:
                if len(seen) > 50_000:
                    seen.clear()
                v = seen[cell] = trim(decode(cell).strip("\0"))
            out.append(v)
        return pa.array(out, pa.string())
    if kind == "N" and f.decimals == 0:
        fast = _plain_numbers(np.ascontiguousarray(block[:, f.start : f.start + f.length]), r"^-?[0-9]{1,18}$", pa.int32() if f.length < 10 else pa.int64())
        if fast is not None:
            return fast
        top = (1 << 31) if f.length < 10 else (1 << 63)
        out = []
        for cell in _cells(block, f):
            t = _number_text(cell)
            v = int(t) if t and _PLAIN_INT.fullmatch(t) else None
            out.append(v if v is not None and -top <= v < top else None)
        return pa.array(out, pa.int32() if f.length < 10 else pa.int64())
    if kind == "N" or kind == "F" and floats_as_decimals:
        p, s = min(max(f.length, f.decimals, 1), 38), min(f.decimals, 38)
        if p <= 28 and s:
            fast = _plain_numbers(np.ascontiguousarray(block[:, f.start : f.start + f.length]), rf"^-?[0-9]{{1,{p - s}}}(\.[0-9]{{1,{s}}})?$", pa.decimal128(p, s))
            if fast is not None:
                return fast
        out = []
        with decimal.localcontext() as context:
            context.prec = 60
            unit = decimal.Decimal(1).scaleb(-s)
            for i, cell in enumerate(_cells(block, f)):
                t = _number_text(cell)
                if not t or not _PLAIN_DEC.fullmatch(t):
                    out.append(None)
                    continue
                v = decimal.Decimal(t.decode())
                if abs(v) > decimal.Decimal("79228162514264337593543950335"):
                    out.append(None)
                    continue
                q = v.quantize(unit)
                if q != v or len(q.as_tuple().digits) > p:
                    raise DecodeError(f"record {first + i}, column {f.name}: {t.decode()} doesn't fit decimal({p},{s})")
                out.append(q)
        return pa.array(out, pa.decimal128(p, s))
    if kind == "F":
        out = []
        for cell in _cells(block, f):
            t = _number_text(cell)
            out.append(float(t) if t and _PLAIN_DEC.fullmatch(t) else None)
        with np.errstate(over="ignore"):
            return pa.array([None if v is None else float(np.float32(v)) for v in out], pa.float32())
    if kind == "I":
        return pa.array(_binary(block, f, "<i4").astype(np.int64))
    if kind == "B":
        return pa.array(_binary(block, f, "<f8"))
    if kind == "Y":
        cents = _binary(block, f, "<i8")
        wide = np.stack([cents, cents >> 63], axis=1)  # 128 bits, the low half first
        return pa.Array.from_buffers(pa.decimal128(19, 4), len(cents), [None, pa.py_buffer(np.ascontiguousarray(wide))])
    if kind == "D":
        text = _plain_text(np.ascontiguousarray(block[:, f.start : f.start + f.length]))
        if text is not None and f.length == 8:
            blank = pc.equal(pc.utf8_trim(text, " "), "")
            days = pc.if_else(blank, pa.scalar(None, pa.string()), text)
            if pc.all(pc.match_substring_regex(days, "^(?:[1-9][0-9]{3}|0[1-9][0-9]{2}|00[1-9][0-9]|000[1-9])(0[1-9]|1[0-2])(0[1-9]|1[0-9]|2[0-8])$"), min_count=0).as_py():
                return pc.strptime(days, format="%Y%m%d", unit="s").cast(pa.date32())
        out = []
        for cell in _cells(block, f):
            t = cell.split(b"\0", 1)[0].strip(_BLANK)
            v = None
            if len(t) == 8 and t.isdigit():
                try:
                    v = dt.date(int(t[:4]), int(t[4:6]), int(t[6:]))
                except ValueError:
                    v = None
            out.append(v)
        return pa.array(out, pa.date32())
    if kind == "T":
        pair = np.ascontiguousarray(block[:, f.start : f.start + 8]).view("<i4").astype(np.int64).reshape(-1, 2)
        micros = (pair[:, 0] - JULIAN_EPOCH) * 86_400_000_000 + pair[:, 1] * 1000
        return pa.array(micros, pa.timestamp("us"), mask=(pair == 0).all(axis=1))
    if kind == "L":
        b = block[:, f.start]
        yes, no = np.isin(b, np.frombuffer(b"YyTt", np.uint8)), np.isin(b, np.frombuffer(b"NnFf", np.uint8))
        return pa.array(yes, pa.bool_(), mask=~(yes | no))
    if kind == "M":
        blocks: list = []
        for cell in _cells(block, f):
            if f.length == 4:
                blocks.append(struct.unpack("<I", cell)[0])
            else:
                t = cell.split(b"\0", 1)[0].strip(_BLANK) if cell else b""
                blocks.append(int(t) if _PLAIN_INT.fullmatch(t) else None)
        out = []
        for i, n in enumerate(blocks):
            if n is None:
                out.append("")
            elif memo is None:
                out.append(None)
            elif n <= 0:
                out.append("")
            else:
                try:
                    out.append(memo.text(n))
                except (ValueError, struct.error) as e:
                    raise DecodeError(f"record {first + i}, column {f.name}: {e}") from e
        return pa.array(out, pa.string())
    return pa.nulls(len(block), pa.string())
