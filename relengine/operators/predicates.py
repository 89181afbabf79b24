"""Predicates as columns.

A predicate comes in negation normal form (plans/rewrite.py), so what isn't true may be false or
NULL here alike. Comparisons follow the kinds of both sides: numbers with numbers as numbers, other
texts by code point, dates and logicals with a literal of their form as such. IN, EXISTS, ANY and
ALL stay declarative: a semi-join or an existence join for equality, one aggregated row for the
other quantified comparisons, which is computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relengine.plans import ast
from relengine.plans.ast import SqlError
from relengine.types import as_date, as_logical, as_number, kind_of, number_literal, text_of


def null() -> Column:
    return F.lit(None).cast("boolean")


@dataclass(frozen=True)
class Bound:
    """A column that an operand was resolved to."""

    column: Column
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)


Resolve = Callable[[ast.ColumnRef | ast.Call], Bound]
Lower = Callable[[ast.Select], DataFrame]

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _with_literal(b: Bound, x: ast.Literal) -> tuple[Column, Column]:
    """Both sides of a comparison of a column with a literal that isn't NULL."""
    if b.kind == "N":
        number = as_number(x.value)
        if number is not None:
            return b.column, number_literal(number)
    elif b.kind == "D":
        date = as_date(x.value)
        if date is not None:
            return b.column, F.lit(date).cast(b.dtype)
    elif b.kind == "L":
        logical = as_logical(x.value) if len(x.value.strip()) == 1 else None
        if logical is not None:
            return b.column, F.lit(logical)
    return text_of(b.column, b.dtype), F.lit(x.value.strip())


def _with_column(a: Bound, b: Bound) -> tuple[Column, Column]:
    """Both sides of a comparison of two columns: as texts, if their kinds differ."""
    return (a.column, b.column) if a.kind == b.kind else (text_of(a.column, a.dtype), text_of(b.column, b.dtype))


class Predicates:
    """Lowers predicates in a scope. resolve: gives the column of a name or of an aggregate; lower: the rows of a query."""

    def __init__(self, resolve: Resolve, lower: Lower):
        self.resolve, self.lower = resolve, lower

    def operand(self, x: ast.Operand, beside: Bound | None = None) -> Bound | ast.Literal:
        if isinstance(x, ast.Literal):
            return x
        try:
            return self.resolve(x)
        except SqlError:
            # A bare T, F, Y or N beside a logical column that names no column is the logical value.
            if isinstance(x, ast.ColumnRef) and not x.qualifier and beside is not None and beside.kind == "L" and x.name.upper() in ("T", "F", "Y", "N"):
                return ast.Literal("string", x.name)
            raise

    def compare(self, left: Bound, op: str, right: ast.Operand) -> Column:
        right = self.operand(right, left)
        if isinstance(right, Bound):
            return _OPS[op](*_with_column(left, right))
        return null() if right.kind == "null" else _OPS[op](*_with_literal(left, right))

    def __call__(self, p: ast.Predicate) -> Column:
        if isinstance(p, ast.And):
            out = self(p.parts[0])
            for part in p.parts[1:]:
                out = out & self(part)
            return out
        if isinstance(p, ast.Or):
            out = self(p.parts[0])
            for part in p.parts[1:]:
                out = out | self(part)
            return out
        if isinstance(p, ast.Constant):
            return F.lit(p.value)
        if isinstance(p, ast.Not):
            return ~self(p.inner)
        if isinstance(p, ast.Exists):
            some = self.lower(p.query).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
            return some == 0 if p.negated else some > 0
        left = self.operand(p.left)
        if isinstance(left, ast.Literal):
            raise SqlError("a predicate begins with a column")
        if isinstance(p, ast.IsNull):
            return left.column.isNotNull() if p.negated else left.column.isNull()
        if isinstance(p, ast.Compare):
            return self.compare(left, p.op, p.right)
        if isinstance(p, ast.InList):
            return self.in_list(left, p)
        if isinstance(p, ast.Like):
            return self.like(left, p)
        return self.quantified(left, p)

    def in_list(self, left: Bound, p: ast.InList) -> Column:
        sides = [self.operand(x, left) for x in p.items]
        literals = [x for x in sides if isinstance(x, ast.Literal) and x.kind != "null"]
        pairs = [_with_literal(left, x) for x in literals]
        # One IN for the literals that leave the column as it is, which scans can use.
        plain = [v for x, (c, v) in zip(literals, pairs, strict=True) if c is left.column]
        found = [left.column.isin(*plain)] if plain else []
        found += [c == v for c, v in pairs if c is not left.column]
        found += [_OPS["="](*_with_column(left, x)) for x in sides if isinstance(x, Bound)]
        found += [null() for x in sides if isinstance(x, ast.Literal) and x.kind == "null"][:1]
        out = found[0]
        for x in found[1:]:
            out = out | x
        return ~out if p.negated else out

    def like(self, left: Bound, p: ast.Like) -> Column:
        """% and _ are wild, nothing escapes them."""
        text = text_of(left.column, left.dtype)
        pattern = self.operand(p.pattern)
        if isinstance(pattern, ast.Literal):
            if pattern.kind == "null":
                return null()
            out = text.like(pattern.value.replace("\\", "\\\\"))
        else:
            out = F.like(text, F.replace(text_of(pattern.column, pattern.dtype), F.lit("\\"), F.lit("\\\\")))
        return ~out if p.negated else out

    def quantified(self, left: Bound, p: ast.Quantified) -> Column:
        """True where the comparison holds for any or for all rows of the query.

        Of an empty query ANY is false and ALL is true. Unknown comparisons, of NULLs, never make
        ANY true and never let ALL be true.
        """
        rows = self.lower(p.query)
        if len(rows.columns) != 1:
            raise SqlError("a query in a comparison has one column")
        inner = Bound(rows[rows.columns[0]], rows.schema[0].dataType)
        outer_side, inner_side = _with_column(left, inner)
        values = rows.select(inner_side.alias("v"))
        v = F.col("v")
        facts = values.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(v).alias("nn"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias("s")).scalar()
        n, nn, lo, hi = (facts[k] for k in ("n", "nn", "lo", "hi"))
        x = outer_side
        if p.quantifier == "ANY":
            if p.op == "=":
                return x.isin(values.filter(v.isNotNull()))
            if p.op == "<>":
                return (lo != x) | (hi != x)
            return x > lo if p.op == ">" else x >= lo if p.op == ">=" else x < hi if p.op == "<" else x <= hi
        if p.op == "<>":
            # Neither side is NULL here; that the test can't be NULL lets it be an existence join on the key.
            none = ~F.coalesce(x.isin(values.filter(v.isNotNull())), F.lit(False))
        elif p.op == "=":
            none = (lo == x) & (hi == x)
        else:
            none = x > hi if p.op == ">" else x >= hi if p.op == ">=" else x < lo if p.op == "<" else x <= lo
        return (n == 0) | ((n == nn) & x.isNotNull() & none)
