"""SELECT statements as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relengine.functions import aggregate, trim
from relengine.operators.predicates import Bound, Predicates
from relengine.plans import ast
from relengine.plans.ast import SqlError
from relengine.plans.parser import is_aggregate
from relengine.plans.rewrite import simplify


@dataclass(frozen=True)
class ScopeColumn:
    qualifiers: tuple[str, ...]  # in lower case
    name: str
    bound: Bound
    source: int


class Scope:
    """The columns of all sources of a query, each under an internal name of its own."""

    def __init__(self, columns: list[ScopeColumn]):
        self.columns = columns

    def find(self, ref: ast.ColumnRef) -> Bound:
        name, q = ref.name.lower(), ref.qualifier and ref.qualifier.lower()
        found = [c for c in self.columns if c.name.lower() == name and (q is None or q in c.qualifiers)]
        if not found:
            raise SqlError(f"there is no column {ref}")
        if len(found) > 1:
            raise SqlError(f"{ref} is ambiguous")
        return found[0].bound

    def source(self, ref: ast.ColumnRef) -> int:
        bound = self.find(ref)
        return next(c.source for c in self.columns if c.bound is bound)

    def numeric(self, ref: ast.ColumnRef) -> bool:
        try:
            return self.find(ref).kind == "N"
        except SqlError:
            return False


class Lowering:
    """tables: gives the rows of a named table, view or system view. count_nulls: COUNT of a column counts NULLs too."""

    def __init__(self, tables: Callable[[str], DataFrame], count_nulls: bool = False):
        self.tables, self.count_nulls = tables, count_nulls

    def sources(self, sources: tuple[ast.Source, ...]) -> tuple[list[DataFrame], Scope]:
        frames, columns = [], []
        for i, s in enumerate(sources):
            df = self.select(s.query) if s.query else self.tables(s.table)
            own = [f"_{i}_{k}" for k in range(len(df.columns))]
            frames.append(df.toDF(*own))
            columns += [ScopeColumn(s.names, f.name, Bound(F.col(c), f.dataType), i) for c, f in zip(own, df.schema.fields, strict=True)]
        return frames, Scope(columns)

    def select(self, q: ast.Select) -> DataFrame:
        frames, scope = self.sources(q.sources)
        predicates = Predicates(lambda x: self._plain(x, scope), self.select)
        df = frames[0]
        joins = list(q.joins)
        for i, right in enumerate(frames[1:], 1):
            ready = [p for p in joins if self._ready(p, scope, i)]
            joins = [p for p in joins if p not in ready]
            on = simplify(ast.And(tuple(ready))) if ready else None
            # A comma is a cross join here; the optimizer makes an inner join of it if WHERE equates columns.
            df = df.join(right, predicates(on), "inner") if on is not None else df.crossJoin(right)
        where = simplify(q.where, scope.numeric)
        if where is not None:
            df = df.filter(predicates(where))
        grouped = bool(q.group_by or any(is_aggregate(i.value) for i in q.items or ()))
        out = self._grouped(q, df, scope) if grouped else self._projected(q, df, scope)
        return out.distinct() if q.distinct else out

    def _ready(self, p: ast.Predicate, scope: Scope, upto: int) -> bool:
        parts = p.parts if isinstance(p, ast.And) else (p,)
        return max(scope.source(r) for x in parts for r in (x.left, x.right)) <= upto

    def _plain(self, x: ast.ColumnRef | ast.Call, scope: Scope) -> Bound:
        if isinstance(x, ast.ColumnRef):
            return scope.find(x)
        if x.function != "TRIM":
            raise SqlError(f"{x.function} can't stand here")
        b = scope.find(x.column)
        return Bound(trim(b.column, b.dtype), T.StringType())

    def _projected(self, q: ast.Select, df: DataFrame, scope: Scope) -> DataFrame:
        if q.items is None:
            return df.select(*(c.bound.column.alias(c.name) for c in scope.columns))
        return df.select(*(self._plain(i.value, scope).column.alias(i.name) for i in q.items))

    def _aggregate(self, x: ast.Call, scope: Scope) -> Column:
        if x.column is None:
            return aggregate("COUNT", None, None)
        b = scope.find(x.column)
        return aggregate(x.function, b.column, b.dtype, self.count_nulls)

    def _grouped(self, q: ast.Select, df: DataFrame, scope: Scope) -> DataFrame:
        keys = [scope.find(k).column.alias(f"_k{i}") for i, k in enumerate(q.group_by)]
        of_key = {id(scope.find(k)): f"_k{i}" for i, k in enumerate(q.group_by)}
        hidden = [c for c in _calls(q.having) if is_aggregate(c)] if q.having else []
        outputs = [(f"_a{i}", self._aggregate(x.value, scope)) for i, x in enumerate(q.items) if is_aggregate(x.value)]
        outputs += [(f"_h{i}", self._aggregate(x, scope)) for i, x in enumerate(hidden)]
        columns = [c.alias(n) for n, c in outputs]
        if keys and not columns:
            out = df.select(*keys).distinct()
        else:
            out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)

        def shown(i: int, x: ast.Item) -> Column:
            if is_aggregate(x.value):
                return F.col(f"_a{i}")
            ref = x.value.column if isinstance(x.value, ast.Call) else x.value
            b = scope.find(ref)
            if id(b) not in of_key:
                raise SqlError(f"{ref} is neither grouped nor aggregated")
            key = F.col(of_key[id(b)])
            return trim(key, b.dtype) if isinstance(x.value, ast.Call) else key

        if q.having is not None:
            # HAVING sees output names, the first of a name; aggregates may stand in it as well.
            types = {f.name: f.dataType for f in out.schema.fields}
            named: dict[str, Bound] = {}
            probe = out.select(*(shown(i, x).alias(f"_o{i}") for i, x in enumerate(q.items)))
            for i, x in enumerate(q.items):
                named.setdefault(x.name.lower(), Bound(shown(i, x), probe.schema[i].dataType))
            calls = {c: Bound(F.col(f"_h{i}"), types[f"_h{i}"]) for i, c in enumerate(hidden)}

            def resolve(x: ast.ColumnRef | ast.Call) -> Bound:
                if isinstance(x, ast.Call):
                    if x not in calls:
                        raise SqlError(f"{x.function} can't stand in HAVING")
                    return calls[x]
                if x.name.lower() not in named:
                    raise SqlError(f"HAVING: there is no output {x}")
                return named[x.name.lower()]

            out = out.filter(Predicates(resolve, self.select)(simplify(q.having, lambda c: c.name.lower() in named and named[c.name.lower()].kind == "N")))
        return out.select(*(shown(i, x).alias(x.name) for i, x in enumerate(q.items)))


def _calls(p: ast.Predicate | None) -> list[ast.Call]:
    """The function calls of a predicate, each once."""
    found: list[ast.Call] = []
    if isinstance(p, (ast.And, ast.Or)):
        for part in p.parts:
            found += _calls(part)
    elif isinstance(p, ast.Not):
        found += _calls(p.inner)
    elif p is not None:
        for x in (getattr(p, "left", None), getattr(p, "right", None), getattr(p, "pattern", None), *getattr(p, "items", ())):
            if isinstance(x, ast.Call):
                found.append(x)
    return list(dict.fromkeys(found))
