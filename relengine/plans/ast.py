"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field



class SqlError(Exception):
    """A statement that can't be parsed, bound or executed."""


class ParseError(SqlError):
    pass


# Operands and select items


@dataclass(frozen=True)
class ColumnRef:
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    """kind: number (value is its text), string or null."""

    kind: str
    value: str | None = None


@dataclass(frozen=True)
class Call:
    """TRIM or an aggregate of a column; COUNT(*) has no column."""

    function: str
    column: ColumnRef | None


Operand = ColumnRef | Literal | Call


@dataclass(frozen=True)
class Item:
    value: ColumnRef | Call
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if isinstance(self.value, Call):
            return self.value.column.name if self.value.column else "count"
        return self.value.name


# Predicates


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str  # = <> < <= > >=
    right: Operand


@dataclass(frozen=True)
class InList:
    left: Operand
    items: tuple[Operand, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like:
    left: Operand
    pattern: Operand
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    left: Operand
    negated: bool = False


@dataclass(frozen=True)
class Quantified:
    """left op ANY|ALL (query); IN (query) is = ANY."""

    left: Operand
    op: str
    quantifier: str
    query: Select


@dataclass(frozen=True)
class Exists:
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Not:
    inner: Predicate


@dataclass(frozen=True)
class And:
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Constant:
    value: bool


Predicate = Compare | InList | Like | IsNull | Quantified | Exists | Not | And | Or | Constant


# Statements


@dataclass(frozen=True)
class Source:
    """A named table or view, or a query."""

    table: str | None
    query: Select | None
    alias: str | None = None

    @property
    def names(self) -> tuple[str, ...]:
        """What may qualify its columns, in lower case."""
        return tuple(x.lower() for x in (self.table, self.alias) if x)


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    sources: tuple[Source, ...]
    joins: tuple[Predicate, ...] = ()
    where: Predicate | None = None
    group_by: tuple[ColumnRef, ...] = ()
    having: Predicate | None = None
    distinct: bool = False
    text: str = ""


@dataclass(frozen=True)
class Field:
    """A declared column: kind C, N, D or L, as in dBase files."""

    name: str
    kind: str
    length: int
    decimals: int = 0


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class UseDatabase:
    name: str


@dataclass(frozen=True)
class CreateTable:
    name: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Select


@dataclass(frozen=True)
class Drop:
    kind: str  # database, table or view
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]  # empty: all
    values: tuple[Operand, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Operand], ...]
    where: Predicate | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate | None = None


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit or rollback


Statement = Select | CreateDatabase | UseDatabase | CreateTable | CreateIndex | CreateView | Drop | Insert | Update | Delete | Transaction


@dataclass
class Token:
    kind: str  # word, number, string, symbol or end
    text: str
    at: int
    end: int = field(default=0)
