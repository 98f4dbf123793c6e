"""Values as the text a table viewer shows: flags as T and F, numbers with their field's decimals, dates in one pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shown(c: Column, kind: T.DataType, decimals: int | None = None, date_pattern: str = "yyyy-MM-dd", moment_pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """``c`` as text; null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("T")).when(~c, F.lit("F"))
    if isinstance(kind, T.DecimalType):
        return c.cast(T.DecimalType(38, kind.scale if decimals is None else decimals)).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)) and decimals is not None:
        return F.when(F.isnan(c), F.lit("NaN")).otherwise(F.regexp_replace(F.format_number(c, decimals), ",", ""))
    if isinstance(kind, T.DateType):
        return F.date_format(c, date_pattern)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, moment_pattern)
    return c.cast("string")


def displayed(df: DataFrame) -> DataFrame:
    """Every column as text, numbers with the decimals their field descriptor gives."""
    decimals = lambda f: f.metadata.get("decimals") if f.metadata.get("dbf_type") in ("N", "F", "B") else None
    inner = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return inner.select(*(shown(F.col(f"c{i}"), f.dataType, decimals(f)) for i, f in enumerate(df.schema.fields))).toDF(*df.columns)
