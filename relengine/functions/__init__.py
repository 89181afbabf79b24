"""The six functions of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relengine.plans.ast import SqlError
from relengine.types import kind_of, text_of


def trim(column: Column, dtype: T.DataType) -> Column:
    """The value as text without surrounding blanks."""
    return F.trim(text_of(column, dtype))


def aggregate(function: str, column: Column | None, dtype: T.DataType | None, count_nulls: bool = False) -> Column:
    """COUNT, MIN, MAX, SUM or AVG. AVG is the sum divided by the count with the fraction cut off; NULLs don't count unless count_nulls says so."""
    if function == "COUNT":
        return F.count(F.lit(1) if column is None or count_nulls else column)
    if function in ("MIN", "MAX"):
        return (F.min if function == "MIN" else F.max)(column)
    if kind_of(dtype) != "N":
        raise SqlError(f"{function} needs a number column")
    total = F.sum(column)
    if function == "SUM":
        return total
    # DIV cuts towards zero; floats have no such operator. A sum of nothing is NULL, so nothing is divided by 0.
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (total / F.count(column)).cast("long")
    return F.call_function("div", total, F.count(column))
