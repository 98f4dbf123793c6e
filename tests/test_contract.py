"""Every query of the connection's own behaviour gives what its SQL gives, on a small folder."""

import duckdb
import pytest

from millrace.plans import contract
from millrace.session import mounted

ROWS = {
    "nation": [(i, f"NATION {i}", i % 5) for i in range(25)],
    "part": [(i, f"{'blue' if i % 4 else 'red'} widget {i}", "ECONOMY" if i % 3 else "STANDARD", i % 50, 900 + i / 4) for i in range(1, 121)],
    "orders": [(i, i % 17, "OFP"[i % 3], 1000.5 * (i % 400), f"1995-01-{1 + i % 28:02d}", f"{1 + i % 5}-URGENT") for i in range(1, 301)],
    "client": [(i, f"Alpha {'Bakery' * (i % 3)}" if i % 7 else None, None if i % 5 == 0 else "Town") for i in range(1, 60)],
}
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int", "part": "p_partkey int, p_name string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string", "client": "rec_no bigint, client string, city string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, rows in ROWS.items():
        df = spark.createDataFrame(rows, SCHEMAS[name])
        if name == "orders":
            df = df.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "cast(o_orderdate as timestamp_ntz) as o_orderdate", "o_orderpriority")
        df.repartition(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ROWS:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(contract.ORACLES[name]).df()
    got = contract.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    clean = lambda rows: sorted(tuple(str(round(v, 4) if isinstance(v, float) else v).removesuffix(".0") for v in r) for r in rows)
    assert clean(got.select(cols).toPandas()[cols].itertuples(index=False)) == clean(want[cols].itertuples(index=False))


def test_a_folder_of_another_file_system_is_an_error():
    assert mounted("file:///a/b") == "/a/b" and mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        mounted("store://bucket/a")
