"""Errors.  Compilation stops at the first one and says where, in UTF-8 bytes of the source."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Code(Enum):
    PARSE = "parse"
    UNKNOWN_TABLE = "unknown_table"
    UNKNOWN_COLUMN = "unknown_column"
    UNKNOWN_RELATION_QUALIFIER = "unknown_relation_qualifier"
    DUPLICATE_RELATION_NAME = "duplicate_relation_name"
    AMBIGUOUS_COLUMN = "ambiguous_column"
    TOO_MANY_RELATIONS = "too_many_relations"
    TYPE_MISMATCH = "type_mismatch"
    INCOMPATIBLE_COMPARISON = "incompatible_comparison"
    CANNOT_INFER_NULL_TYPE = "cannot_infer_null_type"
    DUPLICATE_COLUMN = "duplicate_column"
    VALUE_COUNT_MISMATCH = "value_count_mismatch"
    MISSING_REQUIRED_COLUMN = "missing_required_column"
    NULL_NOT_ALLOWED = "null_not_allowed"
    INSERT_VALUE_REFERENCES_COLUMN = "insert_value_references_column"
    UNGROUPED_COLUMN = "ungrouped_column"
    WILDCARD_NOT_SUPPORTED_WITH_GROUP_BY = "wildcard_not_supported_with_group_by"
    ORDER_BY_NOT_SUPPORTED_WITH_GROUPING = "order_by_not_supported_with_grouping"
    INVALID_AGGREGATE_ARGUMENT = "invalid_aggregate_argument"
    INVALID_AGGREGATE_TYPE = "invalid_aggregate_type"


@dataclass(frozen=True)
class Span:
    start: int
    end: int

    def to(self, other: Span) -> Span:
        return Span(self.start, other.end)


class EngineError(Exception):
    """Anything this engine refuses."""


class CompileError(EngineError):
    def __init__(self, code: Code, message: str, span: Span):
        super().__init__(message)
        self.code, self.message, self.span = code, message, span


class SchemaError(EngineError):
    """A table definition or schema document that isn't valid."""


class FingerprintMismatch(SchemaError):
    """Stored data was created under another table definition."""


class InvalidRow(EngineError):
    """A row value of the wrong number, type or nullability."""


class ExpectedQuery(EngineError):
    """A statement that changes data where only a query is allowed."""


class AggregateOverflow(EngineError):
    def __init__(self, output: str):
        super().__init__(f"overflow in {output}")
        self.output = output


class TransactionError(EngineError):
    """A transaction used out of order, on another table, or by another engine."""


class IndexRefused(EngineError):
    """An index that exists already or names no column."""


class ResultTooLarge(EngineError):
    def __init__(self, limit: int):
        super().__init__(f"the result has more than {limit} rows")
        self.limit = limit


class Unauthorized(EngineError):
    def __init__(self, action: str, table_id: int):
        super().__init__(f"{action} is not allowed on table {table_id}")
        self.action, self.table_id = action, table_id
