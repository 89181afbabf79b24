"""Declared columns and Spark types, and how values of the dialect become columns.

Stored data never holds blanks for NULL: blanks become NULL on the way in, texts are trimmed.
Kinds are those of dBase fields: C text, N number, D date, L logical.
"""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relengine.plans.ast import Field, SqlError

_TRUE, _FALSE = {"T", "Y"}, {"F", "N"}


def spark_type(f: Field) -> T.DataType:
    if f.kind == "N":
        return T.LongType() if f.decimals == 0 and f.length <= 18 else T.DecimalType(min(f.length, 38), min(f.decimals, 38))
    return {"C": T.StringType(), "D": T.DateType(), "L": T.BooleanType()}[f.kind]


def struct_field(f: Field) -> T.StructField:
    return T.StructField(f.name, spark_type(f), True, {"dbf_type": f.kind, "length": f.length, "decimals": f.decimals})


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "N"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "D"
    return "L" if isinstance(dtype, T.BooleanType) else "C"


def field_of(s: T.StructField) -> Field:
    """A Spark column as it would be declared."""
    m = s.metadata or {}
    if "dbf_type" in m:
        return Field(s.name, m["dbf_type"], m["length"], m["decimals"])
    kind = kind_of(s.dataType)
    if isinstance(s.dataType, T.DecimalType):
        return Field(s.name, "N", s.dataType.precision, s.dataType.scale)
    length = {T.ByteType: 4, T.ShortType: 6, T.IntegerType: 11, T.LongType: 20, T.FloatType: 20, T.DoubleType: 20}.get(type(s.dataType), {"D": 8, "L": 1}.get(kind, 255))
    return Field(s.name, kind, length, 4 if isinstance(s.dataType, (T.FloatType, T.DoubleType)) else 0)


def text_of(column: Column, dtype: T.DataType) -> Column:
    """A value as the dialect writes it."""
    kind = kind_of(dtype)
    if kind == "D":
        return F.date_format(column, "yyyyMMdd")
    if kind == "L":
        return F.when(column, "T").when(~column, "F")
    return column.cast("string")


def as_number(text: str) -> Decimal | int | None:
    if not re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*", text):
        return None
    value = Decimal(text.strip())
    return int(value) if value == value.to_integral_value() and "." not in text else value


def number_literal(value: Decimal | int) -> Column:
    return F.lit(value)


def as_date(text: str) -> str | None:
    """YYYY-MM-DD of a text of YYYYMMDD or YYYY-MM-DD, if it is a date."""
    for form in ("%Y%m%d", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.strip(), form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return None


def as_logical(text: str) -> bool | None:
    first = text.strip()[:1].upper()
    return True if first in _TRUE else False if first in _FALSE else None


def stored(value: str | None, f: Field):
    """A literal's text as the Python value that a field stores; blank is None. Raises if it doesn't fit."""
    if value is None or value.strip() == "":
        return None
    text = value.strip()
    if f.kind == "C":
        if len(text) > f.length:
            raise SqlError(f"{f.name}: {text!r} is longer than {f.length}")
        return text
    if f.kind == "N":
        number = as_number(text)
        if number is None:
            raise SqlError(f"{f.name}: {text!r} is no number")
        if len(text.lstrip("+")) > f.length:
            raise SqlError(f"{f.name}: {text} is longer than {f.length}")
        rounded = Decimal(number).quantize(Decimal(1).scaleb(-f.decimals))
        return int(rounded) if isinstance(spark_type(f), T.LongType) else rounded
    if f.kind == "D":
        date = as_date(text)
        if date is None:
            raise SqlError(f"{f.name}: {text!r} is no date")
        return datetime.strptime(date, "%Y-%m-%d").date()
    logical = as_logical(text)
    if logical is None:
        raise SqlError(f"{f.name}: {text!r} is neither true nor false")
    return logical


def normalised(column: Column, dtype: T.DataType) -> Column:
    """Text without surrounding blanks, and NULL if nothing is left; other kinds as they are."""
    return F.nullif(F.trim(column), F.lit("")) if isinstance(dtype, T.StringType) else column
