"""The four aggregate functions: result types and Spark expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.types import INT64, U64_MAX, UINT64, Physical, ValueType

#: Begins the message of an overflow that Spark doesn't raise by itself.
OVERFLOW = "aggregate overflow: "


def result_type(function: str, argument: ValueType | None) -> ValueType | None:
    """None if the function doesn't take the argument.  Counts and sums lose the nominal name, extremes keep it."""
    if function == "COUNT":
        return UINT64
    if function == "SUM":
        return {Physical.INT64: INT64, Physical.UINT64: UINT64}.get(argument.physical)
    return argument


def column(function: str, argument: Column | None, argument_type: ValueType | None, name: str) -> Column:
    """Null inputs are skipped; sums are checked (ANSI mode raises for signed ones)."""
    if function == "COUNT":
        return F.count(F.lit(1) if argument is None else argument)
    if function == "SUM":
        total = F.sum(argument)
        if argument_type.physical is Physical.UINT64:
            over = F.raise_error(F.lit(OVERFLOW + name))
            total = F.when(total > F.lit(Decimal(U64_MAX)), over.cast("decimal(30,0)")).otherwise(total).cast("decimal(20,0)")
        return total
    return F.min(argument) if function == "MIN" else F.max(argument)
