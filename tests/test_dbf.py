import datetime as dt
from decimal import Decimal

import pytest

from millrace.api import Settings, connect
from millrace.cdx import keys
from millrace.cdx.file import CdxError, CdxFile
from millrace.dbf.layout import codec_of, read_layout
from millrace.dbf.writer import write_cdx, write_dbf
from millrace.sources.dbf import read_dbf

ALL = (("N5", "N", 5, 0), ("N12", "N", 12, 0), ("DEC", "N", 10, 2), ("FLT", "F", 12, 4), ("INT", "I", 4, 0), ("DBL", "B", 8, 0), ("CUR", "Y", 8, 4), ("DAY", "D", 8, 0), ("AT", "T", 8, 0), ("YES", "L", 1, 0), ("TXT", "C", 20, 0), ("LONG", "C", 300, 0), ("WIDE", "W", 20, 0), ("_Null", "0", 1, 0))


def test_all_types(spark, tmp_path):
    full = (42, 9999999999, Decimal("12.34"), 1.5, -7, 2.25, Decimal("-20.5000"), dt.date(2026, 7, 6), dt.datetime(2020, 1, 2, 3, 4, 5), True, "été  ", "x" * 300, "日本", None)
    bad = (b"  3.5", b"99999999999x", b"    12x   ", b"1E3", 0, float("nan"), 0, b"20261340", None, None, b"\0abc", b" " * 300, None, None)
    write_dbf(str(tmp_path / "t.dbf"), ALL, [full, bad], deleted=[1])
    rows = read_dbf(spark, str(tmp_path / "t.dbf"), metadata=True).collect()
    a, b = rows
    assert a[:13] == (42, 9999999999, Decimal("12.34"), 1.5, -7, 2.25, Decimal("-20.5000"), dt.date(2026, 7, 6), dt.datetime(2020, 1, 2, 3, 4, 5), True, "été", "x" * 300, "日本") and a[13] is None
    assert b[0] is None and b[1] is None and b[2] is None and b[3] == 1000.0 and b[4] == 0 and b[5] != b[5] and b[7] is None and b[8] is None and b[9] is None and b[10] is None and b[11] == "" and b[12] is None
    assert (a["_record_index"], a["_deleted"], b["_deleted"]) == (0, False, True)


def test_options(spark, tmp_path):
    path = str(tmp_path / "o.dbf")
    write_dbf(path, (("S", "C", 6, 0), ("F", "F", 8, 2)), [("  a ", 1.25), ("b", None)], deleted=[0])
    get = lambda **k: [tuple(r) for r in read_dbf(spark, path, **k).collect()]
    assert get() == [("a", 1.25), ("b", None)]
    assert get(skipDeleted=True) == [("b", None)]
    assert get(stringTrimming="trimEnd")[0][0] == "  a" and get(stringTrimming="none")[0][0] == "  a   "
    assert get(readFloatsAsDecimals=True)[0][1] == Decimal("1.25")
    assert get(columns="1") == [(1.25,), (None,)]
    assert get(startRecord=1) == [("b", None)] and get(startRecord=9) == []
    with pytest.raises(Exception):
        get(startRecord=-1)


@pytest.mark.parametrize(("tail", "records", "want"), [(b"", None, 3), (b"\x1a", None, 3), (b"\x1a", 99, 3), (b" 12", None, 3), (b"\x1a    9 ", None, 3)])
def test_end_of_records(spark, tmp_path, tail, records, want):
    path = str(tmp_path / "e.dbf")
    write_dbf(path, (("A", "N", 5, 0),), [(1,), (2,), (3,)], tail=tail, records=records)
    assert read_dbf(spark, path).count() == want
    assert read_dbf(spark, path, columns="").count() == want


def test_many_partitions_keep_order(spark, tmp_path):
    path = str(tmp_path / "p.dbf")
    write_dbf(path, (("A", "N", 8, 0),), [(i,) for i in range(5000)])
    df = read_dbf(spark, path, metadata=True, partitionBytes=900)
    assert df.rdd.getNumPartitions() > 10
    assert df.where("A = _record_index").count() == 5000


@pytest.mark.parametrize("version", [0x83, 0x8B, 0x30])
def test_memos(spark, tmp_path, version):
    path = str(tmp_path / "m.dbf")
    texts = ["short", "x" * 512, "y" * 1500 + "é", None, " padded "]
    write_dbf(path, (("ID", "N", 6, 0), ("NOTE", "M", 4 if version == 0x30 else 10, 0)), list(enumerate(texts)), version=version)
    got = [r[1] for r in read_dbf(spark, path).orderBy("ID").collect()]
    assert got == ["short", "x" * 512, "y" * 1500 + "é", "", "padded"]


def test_code_pages(spark, tmp_path):
    for driver, codec in ((0x01, "cp437"), (0xC9, "cp1251"), (0x02, "cp850"), (0x7A, "gbk")):
        assert codec_of(driver) == codec
        word = {"cp1251": "Стол", "gbk": "中文"}.get(codec, "Ünïé")
        path = str(tmp_path / f"{codec}.dbf")
        write_dbf(path, (("S", "C", 20, 0),), [(word,)], driver=driver, encoding=codec)
        assert read_dbf(spark, path).first()[0] == word
    with pytest.raises(ValueError):
        codec_of(0x68)
    assert read_layout(path).description == "dBase III without memo file"


def test_keys():
    for v, h in ((0, "80000000"), (1, "80000001"), (-1, "7fffffff"), (-(2**31), "00000000"), (2**31 - 1, "ffffffff")):
        assert keys.encode_integer(v).hex() == h and keys.decode_integer(bytes.fromhex(h)) == v
    assert keys.encode_double(1.0).hex() == "bff0000000000000" and keys.encode_double(-1.0).hex() == "400fffffffffffff"
    values = [-1e9, -1.5, -0.25, 0.0, 0.25, 3.0, 1e12]
    assert sorted(values, key=keys.encode_double) == values
    assert keys.compare(b"ab", b"ab  ", 4, 0x20) == 0 and keys.compare(b"ab", b"abc", 4, 0x20) < 0


@pytest.fixture(scope="module")
def indexed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("idx")
    rows = [(i * 3 % 997 - 200, f"name {i % 71:03d}", i % 13, dt.date(2020, 1, 1) + dt.timedelta(days=i % 40), i / 7 - 20) for i in range(997)]
    write_dbf(str(folder / "t.dbf"), (("ID", "I", 4, 0), ("NAME", "C", 20, 0), ("SIZE", "N", 4, 0), ("DAY", "D", 8, 0), ("VAL", "B", 8, 0)), rows, deleted=range(0, 997, 11))
    at = lambda k: [(r[k], i) for i, r in enumerate(rows, 1)]
    write_cdx(str(folder / "t.cdx"), {"ID": ("ID", "I", 4, at(0)), "NAME": ("NAME", "C", 20, at(1)), "SIZE": ("SIZE", "N", 4, at(2)), "DAY": ("DAY", "D", 8, at(3)), "VAL": ("VAL", "B", 8, at(4)), "UPPER": ("UPPER(NAME)", "C", 20, at(1))})
    return folder


def test_index_structure(indexed):
    index = CdxFile(str(indexed / "t.cdx"))
    assert sorted(index.tag_names) == ["DAY", "ID", "NAME", "SIZE", "UPPER", "VAL"]
    tag = index.tag("id", 0)
    assert len(tag) == 997 and [keys.decode_integer(e.key.ljust(4, b"\0")) for e in tag] == sorted(i - 200 for i in range(997))
    assert len({e.record_number for e in tag}) == 997
    with pytest.raises(CdxError):
        index.tag("NONE")


@pytest.mark.parametrize(
    ("where", "how"),
    [("ID = 5", "index seek (=) on tag 'ID'"), ("ID > 500.5", "index range scan on tag 'ID'"), ("700 <= ID", "index range scan on tag 'ID'"), ("ID between -50 and -40", "index range scan (between) on tag 'ID'"), ("ID = 1.5", "index seek (=) on tag 'ID'"),
     ("NAME = 'name 007'", "index seek (=) on tag 'NAME'"), ("NAME like 'name 01%'", "index prefix scan (like) on tag 'NAME'"), ("NAME >= 'name 065'", "index range scan on tag 'NAME'"), ("SIZE = 12 and ID < 100", "index seek (=) on tag 'SIZE'"),
     ("DAY = '2020-01-05'", "index seek (=) on tag 'DAY'"), ("DAY > '2020-02-01'", "index range scan on tag 'DAY'"), ("VAL < -10.25", "index range scan on tag 'VAL'"), ("ID <> 5", "full scan (no indexable clause)"), ("ID = 1 or ID = 2", "full scan (no indexable clause)"),
     ("NAME = 'é'", "full scan (no matching index tag)"), (f"NAME like '{'n' * 30}%'", "index prefix scan on tag 'NAME' (impossible prefix)")],
)
def test_index_and_scan_agree(spark, indexed, where, how):
    with_index, scan = connect(spark, f"Folder={indexed}"), connect(spark, f"Folder={indexed};UseIndexes=false")
    q = f"select ID, NAME from t where {where}"
    assert with_index.explain(q) == how
    assert sorted(map(tuple, with_index.sql(q).collect())) == sorted(map(tuple, scan.sql(q).collect()))
    assert with_index.scalar(f"select count(*) from t where {where}") == scan.sql(q).count()


def test_explain(spark, indexed, tmp_path):
    c = connect(spark, f"Folder={indexed}")
    assert c.explain("select * from t") == "full scan (select all)"
    assert c.explain("select count(*) from t") == "count via record status scan"
    assert c.explain("select count(*) from t where ID between 1 and 9") == "index range scan (between) on tag 'ID' (count with record status checks)"
    assert c.explain("select top 3 ID from t order by ID desc") == "index order scan (descending) on tag 'ID'"
    assert c.explain("select ID from t where SIZE = 3 order by NAME") == "index seek (=) on tag 'SIZE'; in-memory sort"
    assert connect(spark, f"Folder={indexed};UseIndexes=no").explain("select ID from t where ID = 1") == "full scan (indexes disabled)"
    write_dbf(str(tmp_path / "u.dbf"), (("ID", "I", 4, 0),), [(1,)])
    u = connect(spark, f"Folder={tmp_path}")
    assert u.explain("select ID from u where ID = 1") == "full scan (no index file)"
    (tmp_path / "u.cdx").write_bytes(b"x" * 600)
    assert u.explain("select ID from u where ID = 1") == "full scan (index file unusable)"
    assert u.sql("select ID from u where ID = 1").count() == 1


def test_order_and_limit_in_file_order(spark, indexed):
    c = connect(spark, f"Folder={indexed}")
    rows = [tuple(r) for r in c.sql("select NAME, ID from t order by NAME").collect()]
    plain = [tuple(r) for r in c.sql("select NAME, ID from t").collect()]
    assert rows == sorted(plain, key=lambda r: r[0])
    assert [tuple(r) for r in c.sql("select top 5 NAME, ID from t").collect()] == plain[:5]


def test_settings():
    s = Settings.parse("folder=/x; SKIPDELETEDRECORDS=no;StringTrimming=TrimEnd;Encoding=cp850")
    assert (s.folder, s.skip_deleted, s.trimming, s.encoding) == ("/x", False, "trimEnd", "cp850")
    for bad in ("Colour=red", "UseIndexes=maybe", "StringTrimming=both"):
        with pytest.raises(ValueError):
            Settings.parse(bad)


def test_in_memory_and_start_offset(spark, tmp_path):
    from millrace.sources.dbf import read_dbf_bytes

    path = tmp_path / "b.dbf"
    write_dbf(str(path), (("ID", "N", 6, 0), ("NOTE", "M", 4, 0)), [(1, "long text"), (2, None)], version=0x30)
    data, memo = path.read_bytes(), (tmp_path / "b.fpt").read_bytes()
    assert [tuple(r) for r in read_dbf_bytes(spark, data, memo).collect()] == [(1, "long text"), (2, "")]
    assert [tuple(r) for r in read_dbf_bytes(spark, data).collect()] == [(1, None), (2, None)]
    (tmp_path / "shifted.dbf").write_bytes(b"preamble" + data)
    assert read_dbf(spark, str(tmp_path / "shifted.dbf"), startOffset=8, columns="0").count() == 2


def test_display_and_base_columns(spark, indexed):
    from millrace.functions.display import displayed

    c = connect(spark, f"Folder={indexed}")
    df = c.sql("select top 1 ID as key, DAY from t where ID = 5")
    assert [f.metadata["base_column"] for f in df.schema.fields] == ["ID", "DAY"]
    shown = displayed(spark.createDataFrame([(True, Decimal("1.5"), dt.date(2020, 1, 2), None)], "a boolean, b decimal(9,2), c date, d string")).first()
    assert tuple(shown) == ("T", "1.50", "2020-01-02", None)


@pytest.mark.parametrize("settings", ["", "SkipDeletedRecords=false;"])
@pytest.mark.parametrize("text", ["select top 7 ID, NAME from t order by ID desc", "select top 7 ID, NAME from t order by ID", "select top 2000 ID from t order by ID", "select top 0 ID from t order by ID"])
def test_index_order_reads_only_what_it_needs(spark, indexed, settings, text):
    from millrace.plans import access
    from millrace.sql import lowering, syntax

    with_index, scan = connect(spark, f"{settings}Folder={indexed}"), connect(spark, f"{settings}Folder={indexed};UseIndexes=false")
    assert with_index.sql(text).collect() == scan.sql(text).collect()
    s = with_index.source("t")
    from millrace.dbf.layout import spark_schema

    ids = access.plan(s.path, s.layout, lowering.Lowering(spark_schema(s.layout)), syntax.parse(text), True, not settings).record_ids
    assert len(ids) <= max(7, 2000 * ("2000" in text))
