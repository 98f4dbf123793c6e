import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from millrace.api import NotSupported, connect
from millrace.sql import lowering, syntax


def one_row(spark, text, value, kind, parameters=None):
    """The outcome of a condition on column x of one row: True, False or None."""
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)]))
    low = lowering.Lowering(df.schema, parameters)
    cond = low.condition(syntax.parse(f"select * from t where {text}").where)
    return df.toDF("c0").select(cond.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "value", "kind", "want"),
    [
        ("x = 'ab'", "ab  ", T.StringType(), True), ("x = 'ab  '", "ab", T.StringType(), True), ("x = 'AB'", "ab", T.StringType(), False), ("x < 'b'", "a", T.StringType(), True), ("x > ' '", "", T.StringType(), False),
        ("x = 10", 10, T.IntegerType(), True), ("x = 10.0", 10, T.LongType(), True), ("x > 9.5", 10, T.IntegerType(), True), ("10 <= x", 10, T.IntegerType(), True), ("x = -3", -3, T.IntegerType(), True),
        ("x = 0.1", Decimal("0.10"), T.DecimalType(5, 2), True), ("x = 0.5", 0.5, T.DoubleType(), True), ("x > 5", float("nan"), T.DoubleType(), False), ("x < 5", float("nan"), T.DoubleType(), True), ("x >= 5", float("nan"), T.DoubleType(), False),
        ("x = null", 1, T.IntegerType(), None), ("not (x = null)", 1, T.IntegerType(), None), ("x = 1", None, T.IntegerType(), None), ("x = 1 or true = true", None, T.IntegerType(), True), ("x = 1 and true = false", None, T.IntegerType(), False),
        ("x between 1 and 3", 3, T.IntegerType(), True), ("x between 5 and null", 3, T.IntegerType(), False), ("x between 1 and null", 3, T.IntegerType(), None), ("x not between 5 and null", 3, T.IntegerType(), True),
        ("x in (1, null)", 1, T.IntegerType(), True), ("x in (2, null)", 1, T.IntegerType(), None), ("x not in (2, 3)", 1, T.IntegerType(), True), ("x not in (2, null)", 1, T.IntegerType(), None),
        ("x like 'a%'", "abc", T.StringType(), True), ("x like 'a_c'", "abc", T.StringType(), True), ("x like 'a_c'", "abc   ", T.StringType(), True), ("x like 'A%'", "abc", T.StringType(), False), ("x like 'a%c'", "a\nc", T.StringType(), True), ("x like 'a\\b'", "a\\b", T.StringType(), True), ("x not like 'a%'", None, T.StringType(), None),
        ("x is null", None, T.StringType(), True), ("x is not null", None, T.StringType(), False), ("x = true", True, T.BooleanType(), True),
        ("x < '2020-06-15 00:00:01'", dt.date(2020, 6, 15), T.DateType(), True), ("x = '2020-06-15'", dt.date(2020, 6, 15), T.DateType(), True), ("x >= '2020-06-15T12:00:00'", dt.datetime(2020, 6, 15, 12), T.TimestampNTZType(), True),
    ],
)
def test_conditions(spark, text, value, kind, want):
    assert one_row(spark, text, value, kind) is want


@pytest.mark.parametrize(
    ("text", "kind"),
    [("x = 'a'", T.IntegerType()), ("x = 1", T.StringType()), ("x = 1", T.BooleanType()), ("x = true", T.StringType()), ("x = 'soon'", T.DateType()), ("x = '2020-6-15'", T.DateType()), ("x like 'a'", T.IntegerType()), ("x = @p", T.IntegerType()), ("y = 1", T.IntegerType())],
)
def test_type_and_name_errors(spark, text, kind):
    with pytest.raises(lowering.BindError):
        one_row(spark, text, None, kind)


@pytest.mark.parametrize(
    ("text", "position"),
    [("select * frm t", 9), ("select from t", 7), ("select a, from t", 10), ("select * from t where", 21), ("select * from t where x", 23), ("select * from t limit -1", 22), ("select top 1 * from t limit 2", 22), ("select count(*) from t order by a", 23),
     ("select count(a) from t", 13), ("select * from t; x", 17), ("select * from t where x in ()", 28), ("select * from t where x in (y)", 28), ("select top 1.5 * from t", 11), ("select * from t where 'a", 22), ("select * from t where x # 1", 24), ("insert into t", 0)],
)
def test_syntax_errors(text, position):
    with pytest.raises(syntax.SqlSyntaxError) as e:
        syntax.parse(text)
    assert e.value.position == position


def test_words():
    kinds = [(t.kind, t.value) for t in syntax.tokens("1e5 12.5 dbase_03.dbf 2023_data [a b] \"c d\" 'it''s' @p ? != <>")]
    assert kinds == [("name", "1e5"), ("number", Decimal("12.5")), ("name", "dbase_03.dbf"), ("name", "2023_data"), ("delimited", "a b"), ("delimited", "c d"), ("string", "it's"), ("parameter", "p"), ("parameter", None), ("symbol", "<>"), ("symbol", "<>"), ("end", None)]


def test_precedence():
    w = syntax.parse("select * from t where a = 1 or b = 2 and not c = 3").where
    assert w.op == "or" and w.right.op == "and" and isinstance(w.right.right, syntax.Not)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(3, "b", 1.0), (1, None, float("nan")), (2, "a ", None), (4, "a", 2.0), (5, "B", -1.0)]
    return connect(spark, "", {"people": spark.createDataFrame(rows, "id int, name string, score double").repartition(1)})


def test_order_nulls_nan_and_ties(people):
    ids = lambda q: [r[0] for r in people.sql(q).collect()]
    assert ids("select id from people order by score") == [2, 1, 5, 3, 4]
    assert ids("select id from people order by score desc") == [4, 3, 5, 1, 2]
    assert ids("select id from people order by name, id desc") == [1, 5, 4, 2, 3]
    assert ids("select id as key from people order by KEY desc limit 2") == [5, 4]
    assert ids("select top 0 id from people") == []


def test_names_and_counts(people):
    assert people.sql("select ID, name as n from people").columns == ["ID", "n"]
    assert people.scalar("select count(*) from people where name = 'a'") == 2
    assert people.scalar("select top 0 count(*) from people") is None
    assert people.sql("select count(*) from people").dtypes == [("count", "int")]
    assert people.scalar("select count(*) from people where id >= @low and id < ?", {"low": 2, "high": 4}) == 2
    assert people.scalar("select count(*) from people where id >= ? and id < ?", [2, 4]) == 2


def test_builder(people):
    q = people.table("people")
    assert q.where(lambda p: p.name.startswith("a")).count() == 2
    assert q.where(lambda p: (p.id > 1) & ~(p.name == "b")).take(1).count() == 1
    assert [r["id"] for r in q.where(lambda p: p.name != None).order_by_descending(lambda p: p.id).to_list()] == [5, 4, 3, 2]  # noqa: E711
    assert q.where(lambda p: p.id.isin([])).first_or_none() is None
    with pytest.raises(NotSupported):
        q.where(lambda p: p.name.contains("50%"))
    with pytest.raises(NotSupported):
        q.where(lambda p: p.name < None)
    with pytest.raises(LookupError):
        q.where(lambda p: p.id > 99).first()


def test_duplicate_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("p", "p")
    low = lowering.Lowering(df.schema)
    assert lowering._ordinal(low.names, syntax.ColumnRef("P", 0)) == 0
    assert connect(spark, "", {"t": df}).sql("select * from t").collect()[0] == (1, 2)
