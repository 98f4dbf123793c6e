"""Queries of the connection's own behaviour: statements that are rejected, plans told, typed and asynchronous rows, options of
the table source, index headers. Each gives a small table, checked against SQL like any other."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.api import NotSupported, connect
from millrace.cdx.file import CdxError, CdxFile
from millrace.functions.display import displayed
from millrace.plans import catalog as C
from millrace.session import shared_dir, table
from millrace.sources.dbf import read_dbf, read_dbf_bytes
from millrace.sql import lowering, syntax

#: Statements that don't parse, with the position that the error names (required values).
REJECTED = {
    "select * frm t": 9, "select from t": 7, "select a, from t": 10, "select * from t where": 21, "select * from t where x": 23, "select * from t limit -1": 22, "select top 1 * from t limit 2": 22,
    "select count(a) from t": 13, "select * from t; x": 17, "select * from t where x in ()": 28, "select * from t where x in (y)": 28, "select top 1.5 * from t": 11, "select count(*) from t order by a": 23, "select a + 1 from t": 9,
}


def _values(rows: dict[str, Any], *names: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in rows.items())}) AS t({', '.join(names)})"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def err_syntax(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for text in REJECTED:
        try:
            syntax.parse(text)
        except syntax.SqlSyntaxError as e:
            out.append((text, e.position))
    return _table(spark, out, "statement string, position int")


#: Statements that can't be bound to ``nation``, with the start of the error (required values).
UNBOUND = {
    "select nope from nation": "Unknown column 'nope' at position 7", "select n_name from nation where n_name = @absent": "missing parameter", "select n_name from nation where n_name > 1": "cannot compare", "select n_name from nation where n_nationkey = true": "cannot compare",
}


def err_binding(spark: SparkSession, d: str) -> DataFrame:
    c, out = connect(spark, "", {"nation": table(spark, d, "nation")}), []
    for text in UNBOUND:
        try:
            c.sql(text)
        except lowering.BindError as e:
            m = str(e)
            out.append((text, m if m.startswith("Unknown") else "missing parameter" if "parameter" in m.lower() else "cannot compare" if "compare" in m.lower() else m))
    return _table(spark, out, "statement string, error string")


#: How statements over the indexed part table are reached (required values); the same with deleted records kept.
PLANS = {
    "select * from part where P_PARTKEY = 7": "index seek (=) on tag 'P_PARTKEY'", "select * from part where P_PARTKEY between 3 and 9": "index range scan (between) on tag 'P_PARTKEY'", "select * from part where P_NAME like 'blue%'": "index prefix scan (like) on tag 'P_NAME'",
    "select * from part where P_PRICE > 3": "full scan (no matching index tag)", "select * from part": "full scan (select all)", "select count(*) from part": "count via record status scan", "select count(*) from part where P_PARTKEY < 9": "index range scan on tag 'P_PARTKEY' (count from index only)",
    "select * from part order by P_PARTKEY desc": "index order scan (descending) on tag 'P_PARTKEY'", "select * from part where P_PARTKEY > 3 order by P_NAME": "index range scan on tag 'P_PARTKEY'; in-memory sort",
}


def api_explain(spark: SparkSession, d: str) -> DataFrame:
    c = connect(spark, f"Folder={C._part(spark, d)};SkipDeletedRecords=false")
    return _table(spark, [(t, c.explain(t)) for t in PLANS], "statement string, plan string")


@dataclasses.dataclass
class Nation:
    N_NATIONKEY: int
    N_NAME: str


def _typed(run: Callable[[Any, str], list[Nation]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = connect(spark, "", {"nation": table(spark, d, "nation")})
        return _table(spark, [(int(n.N_NATIONKEY), n.N_NAME) for n in run(c, "select n_name, n_nationkey from nation where n_nationkey < 12")], "n_nationkey bigint, n_name string")

    return query


def api_scalar(spark: SparkSession, d: str) -> DataFrame:
    c = connect(spark, "", {"orders": table(spark, d, "orders")})
    none = c.scalar("select o_orderkey from orders where o_orderkey < 0")
    return _table(spark, [(c.scalar("select count(*) from orders where o_totalprice > @p", {"p": 100000}), none is None)], "orders int, empty boolean")


def api_schema(spark: SparkSession, d: str) -> DataFrame:
    df = connect(spark, f"Folder={C._part(spark, d)}").sql("select P_SIZE as s, p_name, P_PRICE from part")
    return _table(spark, [(i, f.name, f.dataType.simpleString(), f.metadata["base_column"]) for i, f in enumerate(df.schema.fields)], "ordinal int, name string, type string, base_column string")


def api_getters(spark: SparkSession, d: str) -> DataFrame:
    """Values of a row by name and ordinal, with their types; nulls as such."""
    df = connect(spark, "", {"client": table(spark, d, "client")}).sql("select rec_no, city from client where city is null order by rec_no limit 3")
    return _table(spark, [(r["rec_no"], type(r[0]).__name__, r.city is None, r.asDict()["rec_no"] == r[0]) for r in df.collect()], "rec_no bigint, kind string, city_null boolean, same boolean")


def par_object(spark: SparkSession, d: str) -> DataFrame:
    return connect(spark, "", {"part": table(spark, d, "part")}).sql("select p_partkey from part where p_size >= @low and p_size < @High", SimpleNamespace(low=10, high=20))


def src_dbf_bytes(spark: SparkSession, d: str) -> DataFrame:
    folder = C._folder(spark)
    C.write_table(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{folder}/nation.dbf", C.NATION)
    with open(f"{folder}/nation.dbf", "rb") as f:
        data = f.read()
    return read_dbf_bytes(spark, b"\0" * 64 + data, startOffset=64).toDF("n_nationkey", "n_name", "n_regionkey")


def _orders(**options: Any) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = read_dbf(spark, f"{C._orders(spark, d)}/orders.dbf", **options)
        return df.toDF(*({"O_STATUS": "o_orderstatus", "O_PRICE": "o_totalprice", "O_DATE": "o_orderdate", "O_PRIO": "o_orderpriority"}.get(c, c.lower()) for c in df.columns))

    return query


def src_dbf_iterate(spark: SparkSession, d: str) -> DataFrame:
    df = read_dbf(spark, f"{C._orders(spark, d)}/orders.dbf", columns="0")
    return _table(spark, [(sum(r[0] for r in df.toLocalIterator()),)], "total bigint")


def opt_encoding(spark: SparkSession, d: str) -> DataFrame:
    """A file whose header names one code page, read in another that was written."""
    folder = C._folder(spark)
    df = table(spark, d, "client").select("rec_no", F.translate(F.regexp_replace("client", "[^A-Za-z ]", ""), "aeo", "àéö").alias("c")).where("c is not null")
    C.write_table(df, f"{folder}/c.dbf", (("REC_NO", "N", 12, 0), ("NAME", "C", 30, 0)), driver=0x01, encoding="cp1252")
    return read_dbf(spark, f"{folder}/c.dbf", encoding="cp1252").toDF("rec_no", "name").select("rec_no", F.coalesce("name", F.lit("")).alias("name"))


def opt_trimming(spark: SparkSession, d: str) -> DataFrame:
    folder = C._folder(spark)
    C.write_table(table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("  "), "n_name").alias("n"), "n_regionkey"), f"{folder}/nation.dbf", C.NATION)
    one = lambda t: read_dbf(spark, f"{folder}/nation.dbf", stringTrimming=t).toDF("k", "n", "r").select(F.lit(t).alias("trimming"), F.col("k").cast("bigint").alias("n_nationkey"), F.length("n").alias("size"))
    return one("none").unionByName(one("trim")).unionByName(one("trimStart")).unionByName(one("trimEnd"))


def opt_floats(spark: SparkSession, d: str) -> DataFrame:
    folder = C._folder(spark)
    df = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("p"))
    C.write_table(df, f"{folder}/p.dbf", (("P_PARTKEY", "I", 4, 0), ("P", "F", 14, 2)))
    a, b = read_dbf(spark, f"{folder}/p.dbf", readFloatsAsDecimals=True), read_dbf(spark, f"{folder}/p.dbf")
    kinds = F.lit(f"{a.schema['P'].dataType.typeName()}, {b.schema['P'].dataType.typeName()}")
    return a.withColumnRenamed("P", "exact").join(b.withColumnRenamed("P", "rough"), "P_PARTKEY").select(F.col("P_PARTKEY").alias("p_partkey"), F.col("exact").cast("double").alias("price"), (F.abs(F.col("exact") - F.col("rough")) < 0.005).alias("near"), kinds.alias("kinds"))


def opt_no_index(spark: SparkSession, d: str) -> DataFrame:
    return connect(spark, f"Folder={C._part(spark, d)};UseIndexes=false").sql("select P_PARTKEY from part where P_SIZE between 10 and 20").toDF("p_partkey")


def snk_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/sink-{spark.sparkContext.applicationId}"
    connect(spark, f"Folder={C._orders(spark, d)}").sql("select O_ORDERKEY as o_orderkey, O_PRICE as o_totalprice from orders where O_STATUS = 'F'").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _over_orders(text: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: connect(spark, f"Folder={C._orders(spark, d)}").sql(text).toDF(*names)


def bld_first(spark: SparkSession, d: str) -> DataFrame:
    q = connect(spark, "", {"part": table(spark, d, "part")}).table("part").order_by_descending(lambda p: p.p_partkey)
    try:
        q.where(lambda p: p.p_partkey < 0).first()
        empty = "row"
    except LookupError:
        empty = "error"
    return _table(spark, [(q.first()["p_partkey"], q.where(lambda p: p.p_partkey < 0).first_or_none() is None, empty)], "first bigint, none boolean, empty string")


def bld_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What a builder's lambda can't say is told when it is built; its other values are taken as they are then."""
    q, out, calls = connect(spark, "", {"part": table(spark, d, "part")}).table("part"), [], []
    for name, f in {"percent": lambda p: p.p_name.contains("50%"), "underscore": lambda p: p.p_name.startswith("a_"), "null": lambda p: p.p_name.endswith(None), "null order": lambda p: p.p_size < None, "and": lambda p: p.p_size > 1 and p.p_size < 9}.items():
        try:
            q.where(f)
            out.append((name, 0))
        except NotSupported:
            out.append((name, 1))
    n = q.where(lambda p: p.p_size >= (calls.append(1) or 10) + 5).count()
    return _table(spark, [*out, ("evaluated", len(calls)), ("rows", n)], "what string, n int")


def fun_display(spark: SparkSession, d: str) -> DataFrame:
    df = displayed(connect(spark, f"Folder={C._part(spark, d)}").sql("select P_PARTKEY, P_NAME, P_SIZE, P_PRICE from part"))
    return df.toDF("p_partkey", "p_name", "p_size", "p_price")


def idx_header(spark: SparkSession, d: str) -> DataFrame:
    index = CdxFile(f"{C._part(spark, d)}/part.cdx")
    return _table(spark, [(n, index.tag(n).header.key_length, index.tag(n).header.expression, len(index.tag(n))) for n in index.tag_names], "tag string, key_length int, expression string, entries int")


def idx_damaged(spark: SparkSession, d: str) -> DataFrame:
    """A file cut short, without its flag, or empty is told by an error, and a statement then scans the table."""
    folder = C._part(spark, d)
    with open(f"{folder}/part.cdx", "rb") as f:
        data = bytearray(f.read())
    out = []
    for name, bad in {"empty": b"", "cut": bytes(data[:300]), "flag": bytes(data[:14]) + b"\0" + bytes(data[15:])}.items():
        try:
            CdxFile(bad)
            out.append((name, "opened"))
        except CdxError:
            out.append((name, "error"))
    with open(f"{folder}/part.cdx", "wb") as f:
        f.write(data[:300])
    c = connect(spark, f"Folder={folder}")
    return _table(spark, [*out, ("plan", c.explain("select * from part where P_PARTKEY = 7")), ("rows", str(c.sql("select P_PARTKEY from part where P_PARTKEY = 7").count()))], "what string, outcome string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "err_syntax": err_syntax, "err_binding": err_binding, "api_explain": api_explain, "api_typed_rows": _typed(lambda c, t: c.query(Nation, t)), "api_async": _typed(lambda c, t: c.query_async(Nation, t).result()),
    "api_first_typed": _typed(lambda c, t: [c.query_first(Nation, f"{t} order by n_nationkey desc")]), "api_scalar": api_scalar, "api_schema": api_schema, "api_getters": api_getters, "par_object": par_object,
    "src_dbf_bytes": src_dbf_bytes, "src_dbf_columns": _orders(columns="0,3"), "src_dbf_one_record": _orders(startRecord=7, recordCount=1), "src_dbf_small_parts": _orders(partitionBytes=3000), "src_dbf_iterate": src_dbf_iterate,
    "opt_encoding": opt_encoding, "opt_trimming": opt_trimming, "opt_floats": opt_floats, "opt_no_index": opt_no_index, "snk_parquet": snk_parquet,
    "srt_stable_desc": _over_orders("select top 60 O_ORDERKEY, O_STATUS from orders order by O_STATUS desc", "o_orderkey", "o_orderstatus"),
    "lim_file_order_dbf": _over_orders("select top 7 O_ORDERKEY from orders where O_STATUS = 'O'", "o_orderkey"), "lex_file_name": _over_orders("SELECT O_ORDERKEY FroM orders.dbf WHERE O_STATUS <> 'it''s' aNd O_CUSTKEY < 9", "o_orderkey"),
    "bld_first": bld_first, "bld_rejected": bld_rejected, "fun_display": fun_display, "idx_header": idx_header, "idx_damaged": idx_damaged,
    "idx_count_only": lambda spark, d: connect(spark, f"Folder={C._part(spark, d)};SkipDeletedRecords=false").sql("select count(*) from part where P_PARTKEY < 90"),
    "idx_count_status": lambda spark, d: connect(spark, f"Folder={C._part(spark, d)}").sql("select count(*) from part where P_PARTKEY < 90"),
}

_ALL = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders"
_NATIONS = "select cast(n_nationkey as bigint) as n_nationkey, n_name from nation where n_nationkey < 12"
ORACLES: dict[str, str] = {
    "err_syntax": _values(REJECTED, "statement", "position"), "err_binding": _values(UNBOUND, "statement", "error"), "api_explain": _values(PLANS, "statement", "plan"),
    "api_typed_rows": _NATIONS, "api_async": _NATIONS, "api_first_typed": f"{_NATIONS} order by n_nationkey desc limit 1", "api_scalar": "select cast(count(*) as integer) as orders, true as empty from orders where o_totalprice > 100000",
    "api_schema": "SELECT * FROM (VALUES (0, 's', 'int', 'P_SIZE'), (1, 'p_name', 'string', 'P_NAME'), (2, 'P_PRICE', 'decimal(12,2)', 'P_PRICE')) AS t(ordinal, name, type, base_column)",
    "api_getters": "select rec_no, 'int' as kind, true as city_null, true as same from client where city is null order by rec_no limit 3", "par_object": "select p_partkey from part where p_size >= 10 and p_size < 20",
    "src_dbf_bytes": "select n_nationkey, n_name, n_regionkey from nation", "src_dbf_columns": "select o_orderkey, o_totalprice from orders", "src_dbf_one_record": f"{_ALL} order by o_orderkey limit 1 offset 7", "src_dbf_small_parts": _ALL, "src_dbf_iterate": "select cast(sum(o_orderkey) as bigint) as total from orders",
    "opt_encoding": "select rec_no, trim(translate(regexp_replace(client, '[^A-Za-z ]', '', 'g'), 'aeo', 'àéö'), ' ') as name from client where client is not null",
    "opt_trimming": "select t as trimming, cast(n_nationkey as bigint) as n_nationkey, cast(case t when 'none' then 25 when 'trimStart' then 23 when 'trim' then length(n_name) else length(n_name) + 2 end as integer) as size from nation, (values ('none'), ('trim'), ('trimStart'), ('trimEnd')) as v(t)",
    "opt_floats": "select p_partkey, cast(cast(p_retailprice as decimal(12, 2)) as double) as price, true as near, 'decimal, float' as kinds from part", "opt_no_index": "select p_partkey from part where p_size between 10 and 20", "snk_parquet": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderkey % 10 <> 0",
    "srt_stable_desc": "select o_orderkey, o_orderstatus from orders where o_orderkey % 10 <> 0 order by o_orderstatus desc, o_orderkey limit 60", "lim_file_order_dbf": "select o_orderkey from orders where o_orderkey % 10 <> 0 and o_orderstatus = 'O' order by o_orderkey limit 7", "lex_file_name": "select o_orderkey from orders where o_orderkey % 10 <> 0 and o_custkey < 9",
    "bld_first": "select max(p_partkey) as first, true as none, 'error' as empty from part", "bld_rejected": "select what, n from (values ('percent', 1), ('underscore', 1), ('null', 1), ('null order', 1), ('and', 1), ('evaluated', 1)) as v(what, n) union all select 'rows', cast(count(*) as integer) from part where p_size >= 15",
    "fun_display": "select cast(p_partkey as varchar) as p_partkey, p_name, cast(p_size as varchar) as p_size, cast(cast(p_retailprice as decimal(12, 2)) as varchar) as p_price from part",
    "idx_header": "select tag, key_length, tag as expression, cast((select count(*) from part) as integer) as entries from (values ('P_PARTKEY', 4), ('P_NAME', 40), ('P_TYPE', 25), ('P_SIZE', 8)) as v(tag, key_length)",
    "idx_damaged": "SELECT * FROM (VALUES ('empty', 'error'), ('cut', 'error'), ('flag', 'error'), ('plan', 'full scan (index file unusable)'), ('rows', '1')) AS t(what, outcome)",
    "idx_count_only": 'select cast(count(*) as integer) as "count" from part where p_partkey < 90', "idx_count_status": 'select cast(count(*) as integer) as "count" from part where p_partkey < 90',
}
