"""Typed expressions and the logical plan."""

from __future__ import annotations

from dataclasses import dataclass

from larkspur.types import BOOL, Scalar, ValueType


@dataclass(frozen=True)
class ColumnRef:
    """A column of one occurrence of a table in a query."""

    binding: int
    table_id: int
    column_id: int
    relation: str
    name: str
    type: ValueType
    nullable: bool

    @property
    def internal(self) -> str:
        return f"b{self.binding}_c{self.column_id}"


@dataclass(frozen=True)
class Value:
    value: Scalar
    type: ValueType

    @property
    def nullable(self) -> bool:
        return self.value is None


@dataclass(frozen=True)
class Op:
    """A comparison, AND or OR."""

    op: str
    left: TypedExpr
    right: TypedExpr
    type: ValueType = BOOL

    @property
    def nullable(self) -> bool:
        return self.left.nullable or self.right.nullable


@dataclass(frozen=True)
class Negation:
    operand: TypedExpr
    type: ValueType = BOOL

    @property
    def nullable(self) -> bool:
        return self.operand.nullable


@dataclass(frozen=True)
class NullTest:
    operand: TypedExpr
    negated: bool
    type: ValueType = BOOL
    nullable: bool = False


TypedExpr = ColumnRef | Value | Op | Negation | NullTest


@dataclass(frozen=True)
class Aggregate_:
    """One aggregate function over a column, or over rows if there is none."""

    function: str
    argument: ColumnRef | None
    name: str
    type: ValueType
    nullable: bool


@dataclass(frozen=True)
class Scan:
    binding: int
    table_id: int
    table_name: str
    columns: tuple[ColumnRef, ...]


@dataclass(frozen=True)
class Join:
    left: Plan
    right: Scan
    predicate: TypedExpr


@dataclass(frozen=True)
class Filter:
    input: Plan
    predicate: TypedExpr


@dataclass(frozen=True)
class SortKey:
    column: ColumnRef
    descending: bool
    nulls_first: bool


@dataclass(frozen=True)
class Sort:
    input: Plan
    keys: tuple[SortKey, ...]


@dataclass(frozen=True)
class Project:
    input: Plan
    columns: tuple[ColumnRef, ...]


@dataclass(frozen=True)
class Aggregate:
    input: Plan
    keys: tuple[ColumnRef, ...]
    outputs: tuple[ColumnRef | Aggregate_, ...]


@dataclass(frozen=True)
class Limit:
    input: Plan
    rows: int


Plan = Scan | Join | Filter | Sort | Project | Aggregate | Limit


@dataclass(frozen=True)
class Query:
    plan: Plan
    fields: tuple[ColumnRef | Aggregate_, ...]


@dataclass(frozen=True)
class Insert:
    table_id: int
    table_name: str
    values: tuple[TypedExpr, ...]


@dataclass(frozen=True)
class Update:
    table_id: int
    scan: Scan
    assignments: tuple[tuple[ColumnRef, TypedExpr], ...]
    predicate: TypedExpr | None


@dataclass(frozen=True)
class Delete:
    table_id: int
    scan: Scan
    predicate: TypedExpr | None


Statement = Query | Insert | Update | Delete


def scans(plan: Plan) -> list[Scan]:
    """Scans from left to right."""
    if isinstance(plan, Scan):
        return [plan]
    if isinstance(plan, Join):
        return [*scans(plan.left), plan.right]
    return scans(plan.input)


def read_tables(statement: Statement) -> list[int]:
    """Tables that a query reads, by first occurrence; statements that change data read none besides their target."""
    return list(dict.fromkeys(s.table_id for s in scans(statement.plan))) if isinstance(statement, Query) else []


def write_tables(statement: Statement) -> list[int]:
    return [] if isinstance(statement, Query) else [statement.table_id]


def conjuncts(e: TypedExpr) -> list[TypedExpr]:
    """Parts joined by AND."""
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Op) and e.op == "AND" else [e]


def bindings(e: TypedExpr) -> set[int]:
    """Table occurrences that an expression refers to."""
    match e:
        case ColumnRef():
            return {e.binding}
        case Op():
            return bindings(e.left) | bindings(e.right)
        case Negation() | NullTest():
            return bindings(e.operand)
    return set()
