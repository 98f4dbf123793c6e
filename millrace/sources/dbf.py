"""``spark.read.format("dbf")``: xBase tables as a partitioned Arrow source.

Options: ``encoding``, ``stringTrimming`` (none, trim, trimStart, trimEnd), ``readFloatsAsDecimals``, ``skipDeleted``,
``columns`` (ordinals to decode, comma-separated; empty: none), ``metadata`` (adds ``_record_index`` and ``_deleted``),
``startOffset``, ``startRecord``, ``recordCount``, ``recordIds`` (runs ``a-b`` of an index search), ``memo``,
``partitionBytes`` (of a part; of more than ``FEW_TASKS`` parts a task scans several, one by one, of ``TASK_BYTES`` together at most),
``findEnd`` (false: no look at all status bytes while planning, for files known to end where they are full). The file must be
visible to all executors. Records end at the file's end, at a partial record, or at a record whose status byte is 0x1A; the
header's count never bounds a scan.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.dbf import layout as L
from millrace.dbf.decode import decode_column
from millrace.dbf.memo import Memo
from millrace.session import mounted, shared_dir

DELETED, END = 0x2A, 0x1A
#: A task costs some 40 ms of CPU besides what it reads, so many small parts of a scan are gathered.
FEW_TASKS, TASK_BYTES = 200, 16 << 20
_RECORD_INDEX = T.StructField("_record_index", T.LongType(), False)
_IS_DELETED = T.StructField("_deleted", T.BooleanType(), False)


class Range(InputPartition):
    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = runs  # [first, beyond)


def _flag(options, name: str, default: bool) -> bool:
    v = str(options.get(name, default)).lower()
    if v not in ("true", "false", "yes", "no", "1", "0"):
        raise ValueError(f"option {name}: {v} is no truth value")
    return v in ("true", "yes", "1")


def end_of_records(path: str, table: L.Layout, chunk: int = 1 << 16) -> int:
    """Number of records before the end, found by a strided look at the status bytes."""
    count = table.count(os.path.getsize(path))
    if not count:
        return 0
    begin = table.offset + table.header_length
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        for at in range(0, count, chunk):
            n = min(chunk, count - at)
            status = np.ndarray((n,), np.uint8, m, begin + at * table.record_length, (table.record_length,))
            hit = np.flatnonzero(status == END)
            first = int(hit[0]) if len(hit) else -1
            del status
            if first >= 0:
                return at + first
    return count


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _table(self) -> L.Layout:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return L.read_layout(path, self.options.get("encoding") or None, int(self.options.get("startOffset", 0)))

    def _chosen(self, table: L.Layout) -> list[L.Field]:
        columns = self.options.get("columns")
        if columns is None:
            return list(table.fields)
        return [table.fields[int(c)] for c in columns.split(",") if c.strip()]

    def schema(self) -> T.StructType:
        table = self._table()
        full = L.spark_schema(table, _flag(self.options, "readFloatsAsDecimals", False))
        # names may repeat in a table; the source gives ordinals, names are put back by the reader
        fields = [T.StructField(f"c{f.ordinal}", full[f.ordinal].dataType, True, full[f.ordinal].metadata | {"name": f.name}) for f in self._chosen(table)]
        return T.StructType([*fields, _RECORD_INDEX, _IS_DELETED])

    def reader(self, schema: T.StructType) -> DbfReader:
        return DbfReader(dict(self.options), self._table(), self._chosen(self._table()))


class DbfReader(DataSourceReader):
    def __init__(self, options: dict, table: L.Layout, chosen: list[L.Field]):
        self.path = options["path"]
        self.table, self.chosen = table, chosen
        self.trimming = options.get("stringtrimming", options.get("stringTrimming", "trim"))
        self.floats = _flag(options, "readfloatsasdecimals" if "readfloatsasdecimals" in options else "readFloatsAsDecimals", False)
        self.skip = _flag(options, "skipdeleted" if "skipdeleted" in options else "skipDeleted", False)
        get = lambda k, d=None: options.get(k, options.get(k.lower(), d))
        self.start, self.most = int(get("startRecord", 0)), get("recordCount")
        if self.start < 0:
            raise ValueError("startRecord is negative")
        self.ids = get("recordIds")
        self.bytes = int(get("partitionBytes", 16 << 20))
        self.find_end = _flag({"findEnd": get("findEnd", True)}, "findEnd", True)
        self.memo = get("memo") or L.memo_path(self.path)

    def partitions(self) -> list[Range]:
        end = end_of_records(self.path, self.table) if self.find_end else self.table.count(os.path.getsize(self.path))
        if self.most is not None:
            end = min(end, self.start + int(self.most))
        size = max(1, self.bytes // max(self.table.record_length, 1))
        if self.ids is not None:
            runs = [(int(a), int(b) + 1) for a, _, b in (r.partition("-") for r in self.ids.split(",") if r)]
            runs = [(max(a, self.start), min(b, end)) for a, b in runs if max(a, self.start) < min(b, end)]
            out, current, n = [], [], 0
            for a, b in runs:
                current.append((a, b))
                n += b - a
                if n >= size or len(current) >= 2000:
                    out.append(Range(current))
                    current, n = [], 0
            return [*out, *([Range(current)] if current else [])] or [Range([])]
        parts, most = -(-(end - self.start) // size), TASK_BYTES // (size * max(self.table.record_length, 1))
        size *= max(1, min(most, -(-parts // FEW_TASKS)))
        return [Range([(a, min(a + size, end))]) for a in range(self.start, end, size)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        t = self.table
        memo = Memo(self.memo, t) if self.memo and any(f.type == "M" for f in self.chosen) else None
        step = max(1, min(4 << 20, self.bytes) // max(t.record_length, 1))
        with open(self.path, "rb") as f:
            for a, b in partition.runs:
                for at in range(a, b, step):
                    n = min(step, b - at)
                    f.seek(t.offset + t.header_length + at * t.record_length)
                    data = f.read(n * t.record_length)
                    block = np.frombuffer(data, np.uint8, len(data) // t.record_length * t.record_length).reshape(-1, t.record_length)
                    index = np.arange(at, at + len(block), dtype=np.int64)
                    deleted = block[:, 0] == DELETED
                    if self.skip and deleted.any():
                        block, index, deleted = block[~deleted], index[~deleted], deleted[~deleted]
                    arrays = [decode_column(block, c, t, self.trimming, self.floats, at, memo) for c in self.chosen]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(index), pa.array(deleted)], [*(f"c{c.ordinal}" for c in self.chosen), "_record_index", "_deleted"])
        if memo:
            memo.close()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)


def read_dbf_bytes(spark: SparkSession, table: bytes, memo: bytes | None = None, **options):
    """A table held in memory, with its memo file: written to the shared folder and read from there."""
    folder = mounted(shared_dir(spark))
    stem = os.path.join(folder, f"bytes-{uuid.uuid4().hex[:12]}")
    os.makedirs(folder, exist_ok=True)
    with open(f"{stem}.dbf", "wb") as f:
        f.write(table)
    if memo is not None:
        with open(f"{stem}.fpt", "wb") as f:
            f.write(memo)
    return read_dbf(spark, f"{stem}.dbf", **options)


def read_dbf(spark: SparkSession, path: str, metadata: bool = False, **options):
    """The table with its own column names (repeated ones too), and its record numbers and flags where asked for."""
    register(spark)
    reader = spark.read.format("dbf").option("path", path)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    df = reader.load()
    names = [f.metadata.get("name", f.name) for f in df.schema.fields]
    if not metadata:
        return df.drop("_record_index", "_deleted").toDF(*names[:-2])
    return df.toDF(*names)
