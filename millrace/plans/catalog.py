"""Queries of the core operators over the tables of a folder, and the SQL they are checked against."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.api import Connection, connect
from millrace.dbf.writer import encode_records, table_header, write_cdx, write_dbf
from millrace.operators import units
from millrace.plans import dialect
from millrace.session import mounted, shared_dir, table
from millrace.sources.dbf import read_dbf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def connection(spark: SparkSession, d: str, names: Sequence[str]) -> Connection:
    return connect(spark, "", {n: table(spark, d, n) for n in names})


def _dialect(text: str, parameters: Any) -> Callable[[SparkSession, str], DataFrame]:
    from millrace.sql.syntax import parse

    name = parse(text).table
    return lambda spark, d: connection(spark, d, [name]).sql(text, parameters)


for _name, (_text, _parameters, _check) in dialect.CASES.items():
    QUERIES[_name] = _dialect(_text, _parameters)
    if _name not in dialect.NO_ORACLE:
        ORACLES[_name] = _check or _text


# -- xBase files made from the folder's tables, read back ---------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    path = os.path.join(mounted(shared_dir(spark)), f"xbase-{uuid.uuid4().hex[:12]}")
    os.makedirs(path, exist_ok=True)
    return path


def write_table(df: DataFrame, path: str, columns: Sequence[tuple[str, str, int, int]], deleted: Column | None = None, **options: Any) -> int:
    """``df`` as a table file, in its order; ``deleted`` tells rows to flag. Tasks encode their partitions beside the file, and
    these are put together; a table with memos, whose blocks follow each other, is streamed through the driver."""
    df = df.select("*", F.coalesce(F.lit(False) if deleted is None else deleted, F.lit(False)).alias("_deleted"))
    if all(c[1] != "M" for c in columns):
        return _write_parts(df, path, columns, **options)
    gone: list[int] = []

    def rows():
        for i, r in enumerate(df.toLocalIterator(prefetchPartitions=True)):
            if r["_deleted"]:
                gone.append(i)
            yield tuple(r)[:-1]

    n = write_dbf(path, columns, rows(), **options)
    if gone:
        with open(path, "r+b") as f:
            f.seek(8)
            head = f.read(4)
            start, length = int.from_bytes(head[:2], "little"), int.from_bytes(head[2:], "little")
            for i in gone:
                f.seek(start + i * length)
                f.write(b"*")
    return n


def _write_parts(df: DataFrame, path: str, columns: Sequence[tuple[str, str, int, int]], version: int = 0x03, driver: int = 0x03, encoding: str = "cp1252") -> int:
    folder = f"{path}-parts"
    os.makedirs(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        name = f"{part}-{uuid.uuid4().hex[:12]}"  # a repeated task writes a file of its own
        with open(f"{folder}/{name}", "wb") as f:
            for b in batches:
                if b.num_rows:
                    f.write(encode_records(columns, b.columns[:-1], b.columns[-1].to_numpy(zero_copy_only=False), encoding))
                    rows += b.num_rows
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n": [rows]})

    try:
        parts = sorted(tuple(r) for r in df.mapInArrow(encode, "part bigint, name string, n bigint").collect())
        n = sum(p[2] for p in parts)
        with open(path, "wb") as out:
            out.write(table_header(columns, n, version, driver, encoding))
            for _, name, _ in parts:
                with open(f"{folder}/{name}", "rb") as f:
                    shutil.copyfileobj(f, out, 8 << 20)
                os.remove(f"{folder}/{name}")  # the table is never there twice
            out.write(b"\x1a")
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return n


NATION = (("N_NATIONKEY", "N", 4, 0), ("N_NAME", "C", 25, 0), ("N_REGIONKEY", "N", 4, 0))
ORDERS = (("O_ORDERKEY", "I", 4, 0), ("O_CUSTKEY", "N", 12, 0), ("O_STATUS", "C", 1, 0), ("O_PRICE", "B", 8, 0), ("O_DATE", "T", 8, 0), ("O_PRIO", "C", 15, 0))
PART = (("P_PARTKEY", "I", 4, 0), ("P_NAME", "C", 40, 0), ("P_TYPE", "C", 25, 0), ("P_SIZE", "N", 4, 0), ("P_PRICE", "N", 12, 2))
PRODUCTS = (("PRODUCTID", "N", 11, 0), ("PRODUCTNAM", "C", 160, 0), ("UNITPRICE", "N", 20, 4), ("DISCONTINU", "L", 1, 0), ("REC_NO", "N", 12, 0))


def _orders(spark: SparkSession, d: str) -> str:
    folder = _folder(spark)
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").orderBy("o_orderkey")
    write_table(df, f"{folder}/orders.dbf", ORDERS, F.col("o_orderkey") % 10 == 0)
    return folder


def _part(spark: SparkSession, d: str) -> str:
    folder = _folder(spark)
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("p"))
    write_table(df, f"{folder}/part.dbf", PART)
    rows = [(r["p_partkey"], r["p_name"], r["p_type"], r["p_size"]) for r in df.toLocalIterator()]
    tags = {"P_PARTKEY": ("P_PARTKEY", "I", 4, [(r[0], i) for i, r in enumerate(rows, 1)]), "P_NAME": ("P_NAME", "C", 40, [(r[1], i) for i, r in enumerate(rows, 1)]), "P_TYPE": ("P_TYPE", "C", 25, [(r[2], i) for i, r in enumerate(rows, 1)]), "P_SIZE": ("P_SIZE", "N", 4, [(r[3], i) for i, r in enumerate(rows, 1)])}
    write_cdx(f"{folder}/part.cdx", tags)
    return folder


def src_dbf_roundtrip_nation(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    write_table(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{folder}/nation.dbf", NATION)
    return read_dbf(spark, f"{folder}/nation.dbf").toDF("n_nationkey", "n_name", "n_regionkey")


def src_dbf_types_orders(spark: SparkSession, d: str) -> DataFrame:
    return read_dbf(spark, f"{_orders(spark, d)}/orders.dbf").toDF("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def src_dbf_types_products(spark: SparkSession, d: str) -> DataFrame:
    """All rows, nulls as blank fields; a blank text and a null one are the same in a file."""
    folder = _folder(spark)
    df = table(spark, d, "dbase_31").select("productid", "productnam", "unitprice", "discontinu", "rec_no")
    write_table(df, f"{folder}/products.dbf", PRODUCTS, driver=0xF0, encoding="utf-8")
    read = read_dbf(spark, f"{folder}/products.dbf").toDF("productid", "productnam", "unitprice", "discontinu", "rec_no")
    return read.select(F.col("productid").cast("bigint").alias("productid"), F.coalesce("productnam", F.lit("")).alias("productnam"), F.col("unitprice").cast("double").alias("unitprice"), "discontinu", "rec_no")


def src_dbf_skip_deleted(spark: SparkSession, d: str) -> DataFrame:
    return connect(spark, f"Folder={_orders(spark, d)}").sql("select O_ORDERKEY as o_orderkey from orders")


def src_dbf_include_deleted(spark: SparkSession, d: str) -> DataFrame:
    return connect(spark, f"Folder={_orders(spark, d)};SkipDeletedRecords=false").sql("select O_ORDERKEY as o_orderkey from orders")


def _memo(version: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        folder = _folder(spark)
        df = table(spark, d, "documents").select("doc_id", "text")
        width = 4 if version == 0x30 else 10
        write_table(df, f"{folder}/docs.dbf", (("DOC_ID", "N", 18, 0), ("TEXT", "M", width, 0)), version=version, driver=0xF0, encoding="utf-8")
        return read_dbf(spark, f"{folder}/docs.dbf").toDF("doc_id", "text")

    return query


def src_dbf_record_index(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_orders(spark, d)}/orders.dbf"
    df = read_dbf(spark, path, metadata=True, startRecord=100, columns="0")
    return df.select(F.col("O_ORDERKEY").alias("o_orderkey"), F.col("_record_index").alias("record_index"), F.col("_deleted").alias("deleted"))


def _index(text: str, rename: Sequence[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: connect(spark, f"Folder={_part(spark, d)}").sql(text).toDF(*rename)


def _builder(f: Callable[[Connection], DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(connection(spark, d, names))


QUERIES |= {
    "src_dbf_roundtrip_nation": src_dbf_roundtrip_nation, "src_dbf_types_orders": src_dbf_types_orders, "src_dbf_types_products": src_dbf_types_products, "src_dbf_skip_deleted": src_dbf_skip_deleted,
    "src_dbf_include_deleted": src_dbf_include_deleted, "src_dbf_memo_three": _memo(0x83), "src_dbf_memo_four": _memo(0x8B), "src_dbf_memo_foxpro": _memo(0x30), "src_dbf_record_index": src_dbf_record_index,
    "idx_seek_eq": _index("select P_PARTKEY, P_NAME from part where P_PARTKEY = 77", ("p_partkey", "p_name")),
    "idx_seek_text": _index("select P_PARTKEY from part where P_TYPE = 'ECONOMY'", ("p_partkey",)),
    "idx_range": _index("select P_PARTKEY from part where P_PARTKEY > 150.5", ("p_partkey",)),
    "idx_range_text": _index("select P_PARTKEY from part where P_NAME >= 'm'", ("p_partkey",)),
    "idx_between": _index("select P_PARTKEY from part where P_SIZE between 10 and 20", ("p_partkey",)),
    "idx_like_prefix": _index("select P_PARTKEY from part where P_NAME like 'blue%'", ("p_partkey",)),
    "idx_order_desc": _index("select top 15 P_PARTKEY from part order by P_PARTKEY desc", ("p_partkey",)),
    "idx_empty": _index("select P_PARTKEY from part where P_PARTKEY = 1.5", ("p_partkey",)),
    "idx_count": _index("select count(*) from part where P_SIZE between 10 and 20", ("count",)),
    "idx_residual": _index("select P_PARTKEY from part where P_SIZE >= 30 and P_TYPE like 'S%' and P_PARTKEY <> 40", ("p_partkey",)),
    "bld_where_order_take": _builder(lambda c: c.table("orders").where(lambda o: (o.o_totalprice >= 200000) & (o.o_orderstatus == "O")).order_by_descending(lambda o: o.o_totalprice).order_by(lambda o: o.o_orderkey).take(25).frame().select("o_orderkey", "o_totalprice"), "orders"),
    "bld_startswith": _builder(lambda c: c.table("part").where(lambda p: p.p_name.startswith("blue")).frame().select("p_partkey"), "part"),
    "bld_contains": _builder(lambda c: c.table("part").where(lambda p: p.p_name.contains("an") | p.p_name.endswith("widget")).frame().select("p_partkey"), "part"),
    "bld_in": _builder(lambda c: c.table("part").where(lambda p: p.p_size.isin([3, 5, 7])).where(lambda p: ~(p.p_type == "ECONOMY")).frame().select("p_partkey"), "part"),
    "bld_null": _builder(lambda c: c.table("client").where(lambda r: (r.city == None) & (r.address != None)).frame().select("rec_no"), "client"),  # noqa: E711
    "bld_count_take": _builder(lambda c: c.spark.createDataFrame([(c.table("customer").where(lambda r: r.c_acctbal > 0).take(1000).count(),)], "n int"), "customer"),
}
ORACLES |= {
    "src_dbf_roundtrip_nation": "select n_nationkey, n_name, n_regionkey from nation",
    "src_dbf_types_orders": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
    "src_dbf_types_products": "select cast(productid as bigint) as productid, coalesce(trim(productnam, ' '), '') as productnam, cast(unitprice as double) as unitprice, discontinu, rec_no from dbase_31",
    "src_dbf_skip_deleted": "select o_orderkey from orders where o_orderkey % 10 <> 0",
    "src_dbf_include_deleted": "select o_orderkey from orders",
    **{f"src_dbf_memo_{k}": "select doc_id, trim(text, chr(32)) as text from documents" for k in ("three", "four", "foxpro")},
    "src_dbf_record_index": "select o_orderkey, record_index, o_orderkey % 10 = 0 as deleted from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as record_index from orders) where record_index >= 100",
    "idx_seek_eq": "select p_partkey, p_name from part where p_partkey = 77",
    "idx_seek_text": "select p_partkey from part where p_type = 'ECONOMY'",
    "idx_range": "select p_partkey from part where p_partkey > 150.5",
    "idx_range_text": "select p_partkey from part where p_name >= 'm'",
    "idx_between": "select p_partkey from part where p_size between 10 and 20",
    "idx_like_prefix": "select p_partkey from part where p_name like 'blue%'",
    "idx_order_desc": "select p_partkey from part order by p_partkey desc limit 15",
    "idx_empty": "select p_partkey from part where false",
    "idx_count": 'select cast(count(*) as integer) as "count" from part where p_size between 10 and 20',
    "idx_residual": "select p_partkey from part where p_size >= 30 and p_type like 'S%' and p_partkey <> 40",
    "bld_where_order_take": "select o_orderkey, o_totalprice from orders where o_totalprice >= 200000 and o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25",
    "bld_startswith": "select p_partkey from part where p_name like 'blue%'",
    "bld_contains": "select p_partkey from part where p_name like '%an%' or p_name like '%widget'",
    "bld_in": "select p_partkey from part where p_size in (3, 5, 7) and not (p_type = 'ECONOMY')",
    "bld_null": "select rec_no from client where city is null and address is not null",
    "bld_count_take": "select cast(least(count(*), 1000) as integer) as n from customer where c_acctbal > 0",
}


# -- quantities in common units -----------------------------------------------------------------------------------------


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "dbase_31"), "rec_no", "productid", "quantitype", "unitprice", "source_sys", "updated_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_matches(_units(spark, d))


def p5_common_units(spark: SparkSession, d: str) -> DataFrame:
    """Contents and price of every record in common units, with the scale its price was kept on."""
    return _units(spark, d).select(
        F.col("key").alias("rec_no"), F.col("product").alias("productid"), F.col("base").alias("unit"), F.round("amount", 6).alias("amount"),
        F.round("pack_price", 4).alias("dollars_per_pack"), "scale",
    )


QUERIES |= {"p5_found": p5_found, "p5_common_units": p5_common_units}
