"""Parquet files that others wrote, read as declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import SchemaError
from larkspur.schema import TableDef
from larkspur.types import U64_MAX, Physical

#: What each physical type may be stored as.
_STORED = {
    Physical.BOOL: (T.BooleanType,),
    Physical.INT64: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    Physical.UINT64: (T.DecimalType,),
    Physical.TEXT: (T.StringType,),
}


class ExternalTable:
    """Read-only.  Declared columns are picked by name and widened; others aren't exposed.

    Unsigned numbers are decimals of scale 0 and twenty digits at most; one
    below 0 or above 64 bits fails the statement that reads it.  That a column
    declared non-null holds no NULL is taken from the definition; ``verify``
    counts both in one pass over the declared columns.
    """

    def __init__(self, table: TableDef, frame: DataFrame, verify: bool = False):
        self.table = table
        stored = {f.name: f.dataType for f in frame.schema.fields}
        for c in table.columns:
            if c.name not in stored:
                raise SchemaError(f"{table.name}: the files have no column {c.name}")
            found = stored[c.name]
            if not isinstance(found, _STORED[c.type.physical]) or (isinstance(found, T.DecimalType) and (found.scale or found.precision > 20)):
                raise SchemaError(f"{table.name}.{c.name}: {found.simpleString()} isn't {c.type.physical.value}")
        q = lambda n: F.col("`" + n.replace("`", "``") + "`")
        columns = {c.name: q(c.name).cast(c.type.physical.spark) for c in table.columns}
        odd = {c.name: (columns[c.name] < 0) | (columns[c.name] > F.lit(str(U64_MAX)).cast("decimal(20,0)")) for c in table.columns if c.type.physical is Physical.UINT64}
        if verify and table.columns:
            wrong = [F.count_if((F.lit(False) if c.nullable else columns[c.name].isNull()) | F.coalesce(odd.get(c.name, F.lit(False)), F.lit(False))) for c in table.columns]
            for c, n in zip(table.columns, frame.agg(*wrong).first(), strict=True):
                if n:
                    raise SchemaError(f"{table.name}.{c.name}: {n} rows hold no {c.type.physical.value}{'' if c.nullable else ' that is not NULL'}")
        for name, beyond in odd.items():
            columns[name] = F.when(beyond, F.raise_error(F.lit(f"{table.name}.{name} holds a number that isn't UINT64"))).otherwise(columns[name])
        self._frame = frame.select([columns[c.name].alias(c.name, metadata=c.field().metadata) for c in table.columns])

    def frame(self) -> DataFrame:
        return self._frame
