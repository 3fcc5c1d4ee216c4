"""Syntax trees of the four statements."""

from __future__ import annotations

from dataclasses import dataclass

from larkspur.errors import Span


@dataclass(frozen=True)
class Name:
    text: str
    span: Span


@dataclass(frozen=True)
class ColumnName:
    qualifier: Name | None
    name: Name
    span: Span

    @property
    def written(self) -> str:
        return f"{self.qualifier.text}.{self.name.text}" if self.qualifier else self.name.text


@dataclass(frozen=True)
class Literal:
    value: bool | int | str | None
    span: Span


@dataclass(frozen=True)
class Binary:
    op: str  # = != < <= > >= AND OR
    left: Expr
    right: Expr
    span: Span


@dataclass(frozen=True)
class Not:
    operand: Expr
    span: Span


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool
    span: Span


Expr = ColumnName | Literal | Binary | Not | IsNull


@dataclass(frozen=True)
class Star:
    span: Span


@dataclass(frozen=True)
class Call:
    function: str  # upper case
    argument: ColumnName | Star
    span: Span


@dataclass(frozen=True)
class Relation:
    table: Name
    alias: Name | None
    span: Span

    @property
    def exposed(self) -> Name:
        return self.alias or self.table


@dataclass(frozen=True)
class Join:
    right: Relation
    on: Expr


@dataclass(frozen=True)
class OrderKey:
    column: ColumnName
    descending: bool
    nulls_first: bool | None
    span: Span


@dataclass(frozen=True)
class Select:
    items: tuple[Star | ColumnName | Call, ...]
    source: Relation
    joins: tuple[Join, ...]
    where: Expr | None
    group_by: tuple[ColumnName, ...]
    order_by: tuple[OrderKey, ...]
    limit: int | None
    span: Span


@dataclass(frozen=True)
class Insert:
    table: Name
    columns: tuple[Name, ...]
    values: tuple[Expr, ...]
    span: Span


@dataclass(frozen=True)
class Update:
    table: Name
    assignments: tuple[tuple[Name, Expr], ...]
    where: Expr | None
    span: Span


@dataclass(frozen=True)
class Delete:
    table: Name
    where: Expr | None
    span: Span


Statement = Select | Insert | Update | Delete
