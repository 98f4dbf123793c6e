"""A statement tree bound to a table and lowered to DataFrame operations, with the dialect's comparison rules.

Strings compare by code points with trailing blanks ignored; numbers compare exactly, or as doubles where one side is one,
NaN below all numbers; dates and timestamps compare as timestamps, also with texts in three fixed forms; nothing is cast
silently. All of it becomes built-in expressions, so that filters, projections, sorts and limits stay with Catalyst.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sql import syntax as S


class BindError(ValueError):
    """A name, parameter or type that doesn't fit the table."""


def _ordinal(names: Sequence[str], ref: S.ColumnRef) -> int:
    """The first exact match, else the first that differs by case alone."""
    if ref.name in names:
        return names.index(ref.name)
    for i, n in enumerate(names):
        if n.casefold() == ref.name.casefold():
            return i
    raise BindError(f"Unknown column '{ref.name}' at position {ref.position}")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, (T.IntegralType, T.DecimalType)):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "other"


_FORMS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S")


def moment(text: str, position: int) -> dt.datetime:
    for form in _FORMS:
        try:
            out = dt.datetime.strptime(text, form)
        except ValueError:
            continue
        if out.strftime(form) == text:
            return out
    raise BindError(f"'{text}' at position {position} is no date of the form yyyy-MM-dd, yyyy-MM-dd HH:mm:ss or yyyy-MM-ddTHH:mm:ss")


class Lowering:
    """Expressions over a frame whose columns are named c0, c1, ... by ordinal."""

    def __init__(self, schema: T.StructType, parameters: Mapping[str, Any] | Sequence[Any] | None = None):
        self.names = [f.name for f in schema.fields]
        self.types = [f.dataType for f in schema.fields]
        self.named, self.placed = _parameters(parameters)
        self.used: set[int] = set()

    # operands: (column or literal value, kind, position)
    def operand(self, x: Any) -> tuple[Any, str, int]:
        if isinstance(x, S.ColumnRef):
            i = x.ordinal if x.ordinal >= 0 else _ordinal(self.names, x)
            x.ordinal = i
            self.used.add(i)
            return F.col(f"c{i}"), kind_of(self.types[i]), x.position
        if isinstance(x, S.Parameter):
            value = self.parameter(x)
        else:
            value = x.value
        return _Lit(value), _literal_kind(value), x.position

    def parameter(self, p: S.Parameter) -> Any:
        if p.name is not None:
            if p.name.casefold() in self.named:
                return self.named[p.name.casefold()]
            raise BindError(f"Missing parameter '@{p.name}' at position {p.position}")
        if p.index < len(self.placed):
            return self.placed[p.index]
        raise BindError(f"Missing parameter {p.index + 1} at position {p.position}")

    def compare(self, op: str, left: Any, right: Any, position: int) -> Column:
        (a, ka, _), (b, kb, _) = self.operand(left), self.operand(right)
        if ka == "null" or kb == "null":
            return F.lit(None).cast("boolean")
        if ka == kb == "string":
            return _strings(op, a, b)
        if {ka, kb} <= {"number", "double"}:
            if "double" in (ka, kb):
                return _double(op, a, b)
            return _plain(op, _number(a), _number(b))
        if "datetime" in (ka, kb) and {ka, kb} <= {"datetime", "string"}:
            for x, k in ((a, ka), (b, kb)):
                if k == "string" and not isinstance(x, _Lit):
                    raise BindError(f"Cannot compare values of type {ka} and {kb} at position {position}")
            return _plain(op, _moment(a, position), _moment(b, position))
        if ka == kb == "bool":
            return _plain(op, _value(a), _value(b))
        raise BindError(f"Cannot compare values of type {ka} and {kb} at position {position}")

    def condition(self, x: Any) -> Column:
        if isinstance(x, S.Logical):
            a, b = self.condition(x.left), self.condition(x.right)
            return a & b if x.op == "and" else a | b
        if isinstance(x, S.Not):
            return ~self.condition(x.operand)
        if isinstance(x, S.Comparison):
            return self.compare(x.op, x.left, x.right, x.position)
        if isinstance(x, S.Between):
            both = self.compare(">=", x.value, x.low, x.position) & self.compare("<=", x.value, x.high, x.position)
            return ~both if x.negated else both
        if isinstance(x, S.InList):
            some = F.lit(False)
            for item in x.items:
                some = some | self.compare("=", x.value, item, x.position)
            return ~some if x.negated else some
        if isinstance(x, S.IsNull):
            c = _value(self.operand(x.value)[0])
            return c.isNotNull() if x.negated else c.isNull()
        if isinstance(x, S.Like):
            (v, kv, _), (p, kp, _) = self.operand(x.value), self.operand(x.pattern)
            if "null" in (kv, kp):
                return F.lit(None).cast("boolean")
            if kv != "string" or kp != "string":
                raise BindError(f"LIKE at position {x.position} needs texts")
            hit = F.like(_text(v), _value(p), F.lit("\x01"))
            return ~hit if x.negated else hit
        raise BindError(f"Unknown condition {type(x).__name__}")

    def sort_keys(self, ordinal: int, descending: bool) -> list[Column]:
        """Nulls first ascending and last descending; NaN right after nulls."""
        c, kind = F.col(f"c{ordinal}"), kind_of(self.types[ordinal])
        way = (lambda x: x.desc_nulls_last()) if descending else (lambda x: x.asc_nulls_first())
        if kind == "string":
            return [way(F.rtrim(c))]
        if kind == "double":
            return [way(F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2)), way(c)]
        return [way(c)]


class _Lit:
    def __init__(self, value: Any):
        self.value = value


def _literal_kind(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, str):
        return "string"
    if isinstance(v, float):
        return "double"
    if isinstance(v, (int, Decimal)):
        return "number"
    if isinstance(v, (dt.date, dt.datetime)):
        return "datetime"
    raise BindError(f"A value of type {type(v).__name__} can't be compared")


def _value(x: Any) -> Column:
    return F.lit(x.value) if isinstance(x, _Lit) else x


def _number(x: Any) -> Column:
    if isinstance(x, _Lit):
        v = x.value
        if isinstance(v, Decimal) and v == v.to_integral_value() and abs(v) < 2**63:
            v = int(v)
        return F.lit(v)
    return x


def _text(x: Any) -> Column:
    return F.lit(x.value.rstrip(" ")) if isinstance(x, _Lit) else F.rtrim(x)


def _strings(op: str, a: Any, b: Any) -> Column:
    """Trailing blanks ignored. What a comparison with a literal implies of the bare column goes along, since only that
    can be pushed into a scan."""
    if isinstance(a, _Lit) and not isinstance(b, _Lit):
        return _strings({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
    whole = _plain(op, _text(a), _text(b))
    if isinstance(b, _Lit) and not isinstance(a, _Lit):
        text = b.value.rstrip(" ")
        if op == "=" and text:
            return whole & a.startswith(text)
        if op in (">", ">="):
            return whole & _plain(op, a, F.lit(text))
    return whole


def _moment(x: Any, position: int) -> Column:
    if isinstance(x, _Lit):
        v = x.value
        v = moment(v, position) if isinstance(v, str) else v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return F.lit(v.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return x.cast("timestamp_ntz")


def _plain(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _double(op: str, a: Any, b: Any) -> Column:
    """Both sides as doubles, NaN equal to itself and below every number."""
    if isinstance(a, _Lit) and not isinstance(b, _Lit):
        return _double({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
    x = F.lit(float(a.value)) if isinstance(a, _Lit) else a.cast("double")
    if isinstance(b, _Lit):
        k = float(b.value)
        if k == k:
            y = F.lit(k)
            if op in ("<", "<="):
                return F.isnan(x) | _plain(op, x, y)
            return ~F.isnan(x) & _plain(op, x, y) if op in (">", ">=") else _plain(op, x, y)
        y = F.lit(k)
    else:
        y = b.cast("double")
    nx, ny = F.isnan(x), F.isnan(y)
    known = x.isNotNull() & y.isNotNull()
    less = F.when(known, (nx & ~ny) | (~nx & ~ny & (x < y)))
    return {"=": x == y, "<>": x != y, "<": less, "<=": less | (x == y), ">": ~(less | (x == y)), ">=": ~less}[op]


def _parameters(given: Mapping[str, Any] | Sequence[Any] | Any | None) -> tuple[dict[str, Any], list[Any]]:
    """Every named parameter is also a positional one, in the order given."""
    if given is None:
        return {}, []
    if isinstance(given, Mapping):
        return {k.lstrip("@").casefold(): v for k, v in given.items()}, list(given.values())
    if isinstance(given, (list, tuple)):
        return {}, list(given)
    return _parameters(vars(given))


def select(df: DataFrame, order_columns: Sequence[Column], statement: S.Select, parameters: Any = None) -> DataFrame:
    """The statement over ``df``. ``order_columns`` give the records' physical order, for ties and unsorted limits."""
    ordered = needs_order(statement)
    hidden = [c.alias(f"o{i}") for i, c in enumerate(order_columns)] if ordered else []
    return select_over(_by_ordinal(df, hidden), [f"o{i}" for i in range(len(hidden))], Lowering(df.schema, parameters), statement)


def needs_order(statement: S.Select) -> bool:
    """Whether the records' physical order matters: ties of a sort, or which rows an unsorted limit takes."""
    return not statement.count and (bool(statement.order) or statement.limit not in (None, 0))


def select_over(inner: DataFrame, order_names: Sequence[str], low: Lowering, statement: S.Select) -> DataFrame:
    """The statement over a frame with columns c0, c1, ... and hidden ones that give the physical order."""
    items = None if statement.count else statement.items or [S.SelectItem(S.ColumnRef(n, 0, i)) for i, n in enumerate(low.names)]
    for item in items or []:
        if item.column.ordinal < 0:
            item.column.ordinal = _ordinal(low.names, item.column)
    if statement.where is not None:
        inner = inner.where(low.condition(statement.where))
    if statement.count:
        out = inner.agg(F.count(F.lit(1)).cast("int").alias("count"))
        return out if statement.limit is None else out.limit(min(statement.limit, 1))
    keys: list[Column] = []
    for o in statement.order:
        keys += low.sort_keys(_sort_ordinal(low.names, items, statement.items is not None, o), o.descending)
    if needs_order(statement):
        keys += [F.col(n) for n in order_names]
        inner = inner.orderBy(*keys) if keys else inner
    if statement.limit is not None:
        inner = inner.limit(statement.limit)
    # names may repeat, so each output column carries the table's column it comes from
    return inner.select(*(F.col(f"c{i.column.ordinal}").alias(i.output, metadata={"base_column": low.names[i.column.ordinal]}) for i in items))


def _by_ordinal(df: DataFrame, hidden: list[Column]) -> DataFrame:
    names = df.columns
    if len(set(n.casefold() for n in names)) == len(names):
        return df.select(*(F.col(f"`{n.replace('`', '``')}`").alias(f"c{i}") for i, n in enumerate(names)), *hidden)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).select("*", *hidden)


def _sort_ordinal(names: Sequence[str], items: list[S.SelectItem], listed: bool, o: S.OrderItem) -> int:
    """An alias of the select list comes before a column of the table."""
    if listed:
        for same in (str, str.casefold):
            for i in items:
                if i.alias is not None and same(i.alias) == same(o.column.name):
                    return i.column.ordinal
    return _ordinal(names, o.column)
