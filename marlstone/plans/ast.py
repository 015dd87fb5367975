"""Syntax trees. ``eq=False`` keeps nodes hashable by identity, which binding relies on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(eq=False)
class Literal:
    value: object


@dataclass(eq=False)
class Name:
    column: str
    table: str | None = None


@dataclass(eq=False)
class Unary:
    op: str
    arg: object


@dataclass(eq=False)
class Binary:
    op: str
    left: object
    right: object


@dataclass(eq=False)
class Subquery:
    query: Query


@dataclass(eq=False)
class Aggregate:
    name: str
    arg: object
    distinct: bool


@dataclass(eq=False)
class Item:
    expr: object  # an expression, an Aggregate or a Star
    alias: str | None = None


@dataclass(eq=False)
class Star:
    table: str | None = None


@dataclass(eq=False)
class TableLeaf:
    name: str
    alias: str


@dataclass(eq=False)
class QueryLeaf:
    query: Query
    alias: str | None
    lateral: bool


@dataclass(eq=False)
class Join:
    kind: str  # inner, left, right, full
    left: object
    right: object
    on: object | None


@dataclass(eq=False)
class Select:
    items: list[Item]
    source: object
    where: object | None
    distinct: bool


@dataclass(eq=False)
class Insert:
    table: str
    columns: list[str]
    rows: list[list[object]]


@dataclass(eq=False)
class Update:
    table: str
    alias: str
    sets: list[tuple[str, object]]
    where: object | None


@dataclass(eq=False)
class Delete:
    table: str
    alias: str
    where: object | None


@dataclass(eq=False)
class Query:
    body: object  # Select, Query, Insert, Update or Delete
    ctes: list[tuple[str, Query]] = field(default_factory=list)


@dataclass(eq=False)
class CreateTable:
    table: str
    columns: list[tuple[str, str]]
    keys: list[str]


@dataclass(eq=False)
class AlterTable:
    table: str
    add: tuple[str, str] | None
    drop: str | None


@dataclass(eq=False)
class DropTable:
    table: str
