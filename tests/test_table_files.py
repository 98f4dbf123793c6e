"""Table files of many rows: written by the tasks in parts, and read by far fewer tasks than small parts."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.dbf.layout import read_layout
from millrace.dbf.writer import encode_records, write_dbf
from millrace.plans import catalog
from millrace.sources.dbf import FEW_TASKS, TASK_BYTES, DbfReader, read_dbf

COLUMNS = (("I", "I", 4, 0), ("N", "N", 6, 0), ("C", "C", 5, 0), ("B", "B", 8, 0), ("T", "T", 8, 0), ("D", "N", 8, 2), ("L", "L", 1, 0))
ROWS = [
    (1, 12, "abc", 1.5, dt.datetime(2020, 1, 2, 3, 4, 5, 678_901), Decimal("12.30"), True), (-7, -99999, "longer text", -0.25, dt.datetime(1969, 12, 31, 23, 59, 59, 999_000), Decimal("-0.05"), False),
    (None,) * 7, (2**31 - 1, 999999, "", float("nan"), dt.datetime(1, 1, 1), Decimal("0.00"), None), (0, 0, "\0x", 1e300, dt.datetime(9999, 12, 31, 12), Decimal("99999.99"), True),
]
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.timestamp("us"), pa.decimal128(8, 2), pa.bool_())


@pytest.mark.parametrize("odd", [[], [(3, 4, "éß", 2.0, dt.datetime(2000, 2, 29), Decimal("1.00"), True)]])
@pytest.mark.parametrize("encoding", ["cp1252", "utf-8", "utf-16-le"])
def test_records_at_once_are_those_of_cell_by_cell(tmp_path, odd, encoding):
    rows, path = [*ROWS, *odd], str(tmp_path / "t.dbf")
    write_dbf(path, COLUMNS, rows, deleted=[1], encoding="cp1252" if encoding == "utf-16-le" else encoding)
    if encoding == "utf-16-le":  # a page in which ASCII isn't itself; names can't be in it, cells can
        write_dbf(path, COLUMNS[:2] + COLUMNS[3:], [(*r[:2], *r[3:]) for r in rows], deleted=[1])
        columns, kinds, rows = COLUMNS[:2] + COLUMNS[3:], KINDS[:2] + KINDS[3:], [(*r[:2], *r[3:]) for r in rows]
    else:
        columns, kinds = COLUMNS, KINDS
    arrays = [pa.array([None, *c], k)[1:] for c, k in zip(zip(*rows), kinds)]  # slices of longer arrays
    got = encode_records(columns, arrays, np.array([i == 1 for i in range(len(rows))]), encoding)
    with open(path, "rb") as f:
        assert f.read()[32 + 32 * len(columns) + 1 : -1] == got.tobytes()


def test_numbers_that_do_not_fit_are_errors():
    for kind, size, v in (("N", 3, 1000), ("I", 4, 2**31)):
        with pytest.raises(ValueError):
            encode_records((("A", kind, size, 0),), [pa.array([v], pa.int64())], np.array([False]), "cp1252")


def test_a_table_is_written_by_the_tasks(spark, tmp_path, monkeypatch):
    """The same file as row by row, in order, with empty partitions, without a row on the driver."""
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("streamed through the driver"))
    rows = [(i, f"é{i % 7}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows[::-1], "k int, t string").repartition(5).orderBy("k").where("k < 400 or k > 2500")
    want = [r for r in rows if not 400 <= r[0] <= 2500]
    columns, a, b = (("K", "I", 4, 0), ("T", "C", 6, 0)), str(tmp_path / "a.dbf"), str(tmp_path / "b.dbf")
    assert catalog.write_table(df, a, columns, F.when(F.col("k") != 9, F.col("k") % 10 == 0)) == len(want)
    write_dbf(b, columns, want, deleted=[i for i, r in enumerate(want) if r[0] % 10 == 0])
    with open(a, "rb") as f, open(b, "rb") as g:
        assert f.read() == g.read()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.dbf", "b.dbf"]


def test_small_parts_share_tasks(spark, tmp_path):
    """More parts than tasks: every record once, in its place, each part read by itself."""
    path = str(tmp_path / "p.dbf")
    write_dbf(path, (("A", "N", 8, 0),), [(i,) for i in range(5003)])
    df = read_dbf(spark, path, metadata=True, partitionBytes=20)  # two records
    assert df.rdd.getNumPartitions() <= FEW_TASKS
    assert [r[0] for r in df.where("A = _record_index").collect()] == list(range(5003))
    reader = DbfReader({"path": path, "partitionBytes": "20", "startRecord": "3"}, t := read_layout(path), list(t.fields))
    tasks = reader.partitions()
    assert len(tasks) <= FEW_TASKS and [a for p in tasks for a, _ in p.runs] == [3, *(b for p in tasks for _, b in p.runs)][:-1]
    sizes = [b.num_rows for p in tasks for b in reader.read(p)]
    assert sizes == [2] * 2500 and sum(sizes) == 5000


def test_parts_of_a_long_file_share_tasks_up_to_a_bound(tmp_path):
    path = tmp_path / "long.dbf"
    write_dbf(str(path), (("A", "C", 999, 0),), [])
    with path.open("r+b") as f:
        f.truncate(path.stat().st_size + (8 << 30))  # a hole
    t = read_layout(str(path))
    ends = lambda n: [p.runs[0] for p in DbfReader({"path": str(path), "partitionBytes": str(n), "findEnd": "false"}, t, []).partitions()]
    assert max(b - a for a, b in ends(3000)) * 1000 <= TASK_BYTES and len(ends(3000)) > FEW_TASKS
    assert max(b - a for a, b in ends(64 << 20)) == (64 << 20) // 1000
