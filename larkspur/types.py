"""Value types: four physical ones, each optionally under a nominal name."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

I64_MIN, I64_MAX, U64_MAX = -(2**63), 2**63 - 1, 2**64 - 1


class Physical(Enum):
    BOOL = "BOOL"
    INT64 = "INT64"
    UINT64 = "UINT64"
    TEXT = "TEXT"

    @property
    def spark(self) -> T.DataType:
        """Spark's type: an unsigned 64-bit number needs twenty decimal digits."""
        return _SPARK[self]


_SPARK = {Physical.BOOL: T.BooleanType(), Physical.INT64: T.LongType(), Physical.UINT64: T.DecimalType(20, 0), Physical.TEXT: T.StringType()}


@dataclass(frozen=True)
class ValueType:
    """Types agree only if both the physical type and the nominal name (or its absence) do."""

    physical: Physical
    name: str | None = None

    def __str__(self) -> str:
        return self.name or self.physical.value


BOOL, INT64, UINT64, TEXT = (ValueType(p) for p in Physical)

Scalar = bool | int | str | None


def fits(value: Scalar, physical: Physical) -> bool:
    """Whether a non-null Python value is of the physical type."""
    if physical is Physical.BOOL:
        return isinstance(value, bool)
    if physical is Physical.TEXT:
        return isinstance(value, str)
    low, high = (I64_MIN, I64_MAX) if physical is Physical.INT64 else (0, U64_MAX)
    return isinstance(value, int) and not isinstance(value, bool) and low <= value <= high
