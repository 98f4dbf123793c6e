"""Connections: a folder of xBase tables beside the session's own tables, queried in the SELECT dialect or by a builder."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dbf import layout as L
from millrace.plans import access
from millrace.sources.dbf import read_dbf
from millrace.sql import lowering, syntax

_OPTIONS = {"folder": ("folder", str), "encoding": ("encoding", str), "skipdeletedrecords": ("skip_deleted", bool), "stringtrimming": ("trimming", str), "readfloatsasdecimals": ("floats_as_decimals", bool), "useindexes": ("use_indexes", bool)}
_TRIMMING = {"none": "none", "trim": "trim", "trimstart": "trimStart", "trimend": "trimEnd"}


@dataclasses.dataclass
class Settings:
    folder: str = ""
    encoding: str | None = None
    skip_deleted: bool = True
    trimming: str = "trim"
    floats_as_decimals: bool = False
    use_indexes: bool = True

    @classmethod
    def parse(cls, text: str) -> Settings:
        """``Key=value;...``; keywords, truth values and trimming names in any case; an unknown keyword is an error."""
        out = cls()
        for part in filter(str.strip, text.split(";")):
            key, sep, value = part.partition("=")
            k, value = "".join(key.split()).lower(), value.strip().strip("\"'")
            if not sep or k not in _OPTIONS:
                raise ValueError(f"Keyword not supported: '{key.strip()}'")
            name, kind = _OPTIONS[k]
            if kind is bool:
                if value.lower() not in ("true", "false", "yes", "no"):
                    raise ValueError(f"'{value}' is no truth value for {key.strip()}")
                setattr(out, name, value.lower() in ("true", "yes"))
            elif name == "trimming":
                if value.lower() not in _TRIMMING:
                    raise ValueError(f"'{value}' is no string trimming")
                out.trimming = _TRIMMING[value.lower()]
            else:
                setattr(out, name, value or None if name == "encoding" else value)
        return out


@dataclasses.dataclass
class Source:
    """A resolved table: how to read it, and its physical order."""

    name: str
    frame: DataFrame | None = None
    order: list[Column] = dataclasses.field(default_factory=list)
    path: str | None = None
    layout: L.Layout | None = None


class Connection:
    def __init__(self, spark: SparkSession, settings: Settings, tables: dict[str, DataFrame] | None = None):
        if settings.folder and not os.path.isdir(settings.folder):
            raise FileNotFoundError(settings.folder)
        self.spark, self.settings = spark, settings
        self.tables = {k.casefold(): v for k, v in (tables or {}).items()}

    def source(self, name: str) -> Source:
        """A registered table, then ``name``, ``name.dbf`` and ``name.DBF`` in the folder, then a table of the session."""
        if name.casefold() in self.tables:
            df = self.tables[name.casefold()]
            return Source(name, df, _file_order(df))
        for candidate in (name, f"{name}.dbf", f"{name}.DBF"):
            path = os.path.join(self.settings.folder, candidate)
            if self.settings.folder and os.path.isfile(path):
                return Source(name, path=path, layout=L.read_layout(path, self.settings.encoding))
        if self.spark.catalog.tableExists(name):
            return Source(name, self.spark.table(name))
        raise FileNotFoundError(f"table '{name}' not found")

    def _read(self, s: Source, skip_deleted: bool | None = None, **options: Any) -> DataFrame:
        skip = self.settings.skip_deleted if skip_deleted is None else skip_deleted
        return read_dbf(self.spark, s.path, True, encoding=self.settings.encoding, stringTrimming=self.settings.trimming, readFloatsAsDecimals=self.settings.floats_as_decimals, skipDeleted=skip, **options)

    def sql(self, text: str, parameters: Any = None) -> DataFrame:
        return self.run(syntax.parse(text), parameters)

    def run(self, statement: syntax.Select, parameters: Any = None, skip_deleted: bool | None = None, use_indexes: bool | None = None) -> DataFrame:
        s = self.source(statement.table)
        if s.frame is not None:
            return lowering.select(s.frame, s.order, statement, parameters)
        schema = L.spark_schema(s.layout, self.settings.floats_as_decimals)
        low = lowering.Lowering(schema, parameters)
        plan = access.plan(s.path, s.layout, low, statement, self.settings.use_indexes if use_indexes is None else use_indexes, self.settings.skip_deleted if skip_deleted is None else skip_deleted)
        used = _columns(statement, low)
        df = self._read(s, skip_deleted, columns=",".join(map(str, used)), recordIds=plan.runs)
        return _pruned_select(df, low, used, statement)

    def explain(self, text: str, parameters: Any = None) -> str:
        """How records are reached, in the words of the access planner."""
        statement = syntax.parse(text)
        s = self.source(statement.table)
        if s.frame is not None:
            return "full scan (spark table)" + ("; in-memory sort" if statement.order else "")
        if statement.count and statement.where is None:
            return "count via record status scan"
        if statement.where is None and not statement.order and statement.items is None and not statement.count and statement.limit is None:
            return "full scan (select all)"
        low = lowering.Lowering(L.spark_schema(s.layout, self.settings.floats_as_decimals), parameters)
        plan = access.plan(s.path, s.layout, low, statement, self.settings.use_indexes, self.settings.skip_deleted)
        if statement.count:
            if plan.record_ids is None:
                return plan.text
            return plan.text + (" (count by reading rows)" if not plan.covers else " (count with record status checks)" if self.settings.skip_deleted else " (count from index only)")
        return plan.text + ("; in-memory sort" if statement.order and not plan.ordered else "")

    def scalar(self, text: str, parameters: Any = None) -> Any:
        row = self.sql(text, parameters).first()
        return row[0] if row is not None else None

    def query(self, cls: type, text: str, parameters: Any = None) -> list[Any]:
        df = self.sql(text, parameters)
        return list(materialise(cls, df))

    def query_first(self, cls: type, text: str, parameters: Any = None) -> Any:
        return next(iter(materialise(cls, self.sql(text, parameters).limit(1))), None)

    def query_async(self, cls: type, text: str, parameters: Any = None) -> Future:
        return _POOL.submit(self.query, cls, text, parameters)

    def table(self, name: str) -> Query:
        return Query(self, name)

    def change_folder(self, folder: str) -> Connection:
        return Connection(self.spark, dataclasses.replace(self.settings, folder=folder), self.tables)


_POOL = ThreadPoolExecutor(4, thread_name_prefix="millrace")


def connect(spark: SparkSession, text: str = "", tables: dict[str, DataFrame] | None = None) -> Connection:
    return Connection(spark, Settings.parse(text), tables)


def _file_order(df: DataFrame) -> list[Column]:
    """File order of a frame read from files, nothing for any other."""
    try:
        df.select("_metadata.file_path")
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    except Exception:  # noqa: BLE001 - the analyser has several errors for it
        return []


def _columns(statement: syntax.Select, low: lowering.Lowering) -> list[int]:
    """Ordinals that the statement needs: the source decodes no others."""
    used: set[int] = set()
    if not statement.count:
        used |= set(range(len(low.names))) if statement.items is None else {lowering._ordinal(low.names, i.column) for i in statement.items}
        for o in statement.order:
            for i in statement.items or []:
                i.column.ordinal = lowering._ordinal(low.names, i.column)
            used.add(lowering._sort_ordinal(low.names, statement.items or [], statement.items is not None, o))

    def visit(x: Any) -> None:
        if isinstance(x, syntax.ColumnRef):
            used.add(lowering._ordinal(low.names, x))
        elif dataclasses.is_dataclass(x):
            for f in dataclasses.fields(x):
                visit(getattr(x, f.name))
        elif isinstance(x, list):
            for y in x:
                visit(y)

    visit(statement.where)
    return sorted(used)


def _pruned_select(df: DataFrame, low: lowering.Lowering, used: list[int], statement: syntax.Select) -> DataFrame:
    """The statement over a frame that holds the used columns alone, by their ordinals."""
    frame = df.toDF(*(f"c{i}" for i in used), "o0", "d0").drop("d0")
    return lowering.select_over(frame, ["o0"], low, statement)


def materialise(cls: type, df: DataFrame) -> Iterator[Any]:
    """Rows as objects: a scalar type takes the one column, a dataclass its fields by name in any case."""
    if cls in (int, float, str, bool, bytes) or not dataclasses.is_dataclass(cls):
        if len(df.columns) != 1:
            raise ValueError("a scalar needs one column")
        yield from (r[0] for r in df.collect())
        return
    names = df.columns
    at = {}
    for f in dataclasses.fields(cls):
        at[f.name] = lowering._ordinal(names, syntax.ColumnRef(f.name, 0))
    optional = {f.name: "None" in str(f.type) or f.type is Any for f in dataclasses.fields(cls)}
    for r in df.collect():
        values = {n: r[i] for n, i in at.items()}
        for n, v in values.items():
            if v is None and not optional[n]:
                raise ValueError(f"column '{n}' is null but the field isn't optional")
        yield cls(**values)


class NotSupported(ValueError):
    """A lambda that has no counterpart in the dialect."""


class Expr:
    """What a builder's lambda gets: comparisons on it build the same tree as the dialect's text."""

    __hash__ = None

    def __init__(self, node: Any):
        self._node = node

    def _compare(self, op: str, other: Any) -> Expr:
        if other is None:
            if op not in ("=", "<>"):
                raise NotSupported("null can only be compared with == and !=")
            return Expr(syntax.IsNull(self._node, op == "<>", 0))
        return Expr(syntax.Comparison(op, self._node, _node(other), 0))

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._compare("=", other)

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._compare("<>", other)

    def __lt__(self, other: Any) -> Expr:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Expr:
        return self._compare("<=", other)

    def __gt__(self, other: Any) -> Expr:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Expr:
        return self._compare(">=", other)

    def __and__(self, other: Expr) -> Expr:
        return Expr(syntax.Logical("and", _condition(self), _condition(other)))

    def __or__(self, other: Expr) -> Expr:
        return Expr(syntax.Logical("or", _condition(self), _condition(other)))

    def __invert__(self) -> Expr:
        return Expr(syntax.Not(_condition(self)))

    def __bool__(self) -> bool:
        raise NotSupported("use &, | and ~ instead of and, or and not")

    def _like(self, text: Any, pattern: str) -> Expr:
        if text is None or "%" in text or "_" in text:
            raise NotSupported("the text of a match can't be null or hold % or _")
        return Expr(syntax.Like(self._node, syntax.Literal(pattern.format(text), 0), False, 0))

    def startswith(self, text: str) -> Expr:
        return self._like(text, "{}%")

    def endswith(self, text: str) -> Expr:
        return self._like(text, "%{}")

    def contains(self, text: str) -> Expr:
        return self._like(text, "%{}%")

    def isin(self, values: Any) -> Expr:
        return Expr(syntax.InList(self._node, [syntax.Literal(v, 0) for v in values], False, 0))

    def between(self, low: Any, high: Any) -> Expr:
        return Expr(syntax.Between(self._node, _node(low), _node(high), False, 0))


def _node(x: Any) -> Any:
    return x._node if isinstance(x, Expr) else syntax.Literal(x, 0)


def _condition(x: Any) -> Any:
    if not isinstance(x, Expr):
        if isinstance(x, bool):
            return syntax.Comparison("=", syntax.Literal(x, 0), syntax.Literal(True, 0), 0)
        raise NotSupported(f"{x!r} is no condition")
    if isinstance(x._node, syntax.ColumnRef):
        return syntax.Comparison("=", x._node, syntax.Literal(True, 0), 0)
    return x._node


class _Row:
    def __getattr__(self, name: str) -> Expr:
        return Expr(syntax.ColumnRef(name, 0))

    def __getitem__(self, name: str) -> Expr:
        return Expr(syntax.ColumnRef(name, 0))


class Query:
    """Where clauses are joined by and, sort keys are appended, and nothing runs before rows are asked for."""

    def __init__(self, connection: Connection, name: str, cls: type | None = None, **state: Any):
        self._c, self._name, self._cls = connection, name, cls
        self._s = {"where": None, "order": (), "take": None, "deleted": None, "indexes": None} | state

    def _with(self, **changes: Any) -> Query:
        return Query(self._c, self._name, changes.pop("cls", self._cls), **(self._s | changes))

    def as_type(self, cls: type) -> Query:
        return self._with(cls=cls)

    def where(self, f: Callable[[Any], Expr]) -> Query:
        new = _condition(f(_Row()))
        return self._with(where=new if self._s["where"] is None else syntax.Logical("and", self._s["where"], new))

    def order_by(self, f: Callable[[Any], Expr]) -> Query:
        return self._with(order=(*self._s["order"], (f(_Row())._node, False)))

    def order_by_descending(self, f: Callable[[Any], Expr]) -> Query:
        return self._with(order=(*self._s["order"], (f(_Row())._node, True)))

    def take(self, n: int) -> Query:
        if n < 0:
            raise ValueError("take needs a count of 0 or more")
        return self._with(take=n)

    def include_deleted(self) -> Query:
        return self._with(deleted=False)

    def without_indexes(self) -> Query:
        return self._with(indexes=False)

    def statement(self) -> syntax.Select:
        names = [f.name for f in dataclasses.fields(self._cls)] if self._cls and dataclasses.is_dataclass(self._cls) else None
        items = [syntax.SelectItem(syntax.ColumnRef(n, 0)) for n in names] if names else None
        order = [syntax.OrderItem(syntax.ColumnRef(n.name, 0), d) for n, d in self._s["order"]]
        return syntax.Select(self._name, items, where=self._s["where"], order=order, limit=self._s["take"])

    def frame(self) -> DataFrame:
        return self._c.run(self.statement(), None, self._s["deleted"], self._s["indexes"])

    def to_list(self) -> list[Any]:
        df = self.frame()
        return list(materialise(self._cls, df)) if self._cls else df.collect()

    def to_list_async(self) -> Future:
        return _POOL.submit(self.to_list)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.to_list())

    def first(self) -> Any:
        rows = self.take(min(1, self._s["take"]) if self._s["take"] is not None else 1).to_list()
        if not rows:
            raise LookupError("the query gives no rows")
        return rows[0]

    def first_or_none(self) -> Any:
        rows = self.take(min(1, self._s["take"]) if self._s["take"] is not None else 1).to_list()
        return rows[0] if rows else None

    def count(self) -> int:
        """Rows the query gives; a take bounds the count itself."""
        s = self.statement()
        s.order, s.items = [], None
        return self._c.run(s, None, self._s["deleted"], self._s["indexes"]).count()
