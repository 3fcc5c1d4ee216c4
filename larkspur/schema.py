"""Declared schemas: validation, a stable fingerprint, and the JSON document that declares them."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from larkspur.errors import SchemaError
from larkspur.types import Physical, ValueType

#: Fixed values of the canonical encoding.
MAGIC, ENCODING_VERSION = b"NBTS", 1
TYPE_TAGS = {Physical.BOOL: 1, Physical.INT64: 2, Physical.UINT64: 3, Physical.TEXT: 4}
U32 = 2**32 - 1


@dataclass(frozen=True)
class ColumnDef:
    id: int
    name: str
    type: ValueType
    nullable: bool = False
    #: Told to readers, never enforced.
    primary_key: bool = False

    def field(self) -> T.StructField:
        told = {"id": self.id, "physical": self.type.physical.value, "semantic": self.type.name, "primary_key": self.primary_key}
        return T.StructField(self.name, self.type.physical.spark, self.nullable, told)


@dataclass(frozen=True)
class TableDef:
    id: int
    name: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)

    def __init__(self, id: int, name: str, columns: Sequence[ColumnDef] = ()):  # noqa: A002
        object.__setattr__(self, "id", id)
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "columns", tuple(columns))
        self._validate()

    def _validate(self) -> None:
        if not self.name:
            raise SchemaError("a table needs a name")
        if not 0 <= self.id < 2**64:
            raise SchemaError(f"table {self.name}: the id isn't an unsigned 64-bit number")
        if len(self.columns) > U32:
            raise SchemaError(f"table {self.name}: too many columns")
        ids, names = set(), set()
        for c in self.columns:
            if not c.name:
                raise SchemaError(f"table {self.name}: a column needs a name")
            if c.type.name == "":
                raise SchemaError(f"column {self.name}.{c.name}: an empty nominal type")
            if not 0 <= c.id <= U32:
                raise SchemaError(f"column {self.name}.{c.name}: the id isn't an unsigned 32-bit number")
            if c.id in ids:
                raise SchemaError(f"table {self.name}: column id {c.id} twice")
            if c.name in names:
                raise SchemaError(f"table {self.name}: column {c.name} twice")
            ids.add(c.id)
            names.add(c.name)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    def spark(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def canonical(self) -> bytes:
        """Bytes that say all of the definition: little-endian numbers, strings led by their length."""

        def text(s: str) -> bytes:
            b = s.encode()
            return struct.pack("<I", len(b)) + b

        out = MAGIC + struct.pack("<HHQ", ENCODING_VERSION, 0, self.id) + text(self.name) + struct.pack("<I", len(self.columns))
        for c in self.columns:
            out += struct.pack("<I", c.id) + text(c.name) + bytes([TYPE_TAGS[c.type.physical]])
            out += b"\0" if c.type.name is None else b"\1" + text(c.type.name)
            out += bytes([c.nullable, c.primary_key])
        return out

    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical()).hexdigest()


@dataclass(frozen=True)
class Schema:
    tables: tuple[TableDef, ...]

    def __init__(self, tables: Sequence[TableDef] = ()):
        object.__setattr__(self, "tables", tuple(tables))
        for what, seen in (("id", [t.id for t in self.tables]), ("name", [t.name for t in self.tables])):
            if len(set(seen)) < len(seen):
                raise SchemaError(f"two tables with one {what}")

    def table(self, name: str) -> TableDef | None:
        return next((t for t in self.tables if t.name == name), None)

    def by_id(self, table_id: int) -> TableDef | None:
        return next((t for t in self.tables if t.id == table_id), None)


def _only(what: str, given: Any, keys: dict[str, type | tuple[type, ...]]) -> dict:
    """``given`` if it is an object with just these keys and kinds of values."""
    if not isinstance(given, dict) or set(given) != set(keys):
        raise SchemaError(f"{what}: expected just the fields {', '.join(keys)}")
    for k, kind in keys.items():
        if not isinstance(given[k], kind) or isinstance(given[k], bool) and kind is int:
            raise SchemaError(f"{what}: field {k} is of the wrong kind")
    return given


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise SchemaError("a field is given twice")
    return dict(pairs)


def load_schema(document: str | bytes) -> Schema:
    """The schema that a JSON document of version 1 declares; all fields are needed, no others are allowed."""
    try:
        doc = json.loads(document, object_pairs_hook=_no_repeats)
    except ValueError as e:
        raise SchemaError(f"not JSON: {e}") from e
    _only("schema", doc, {"version": int, "tables": list})
    if doc["version"] != 1:
        raise SchemaError(f"version {doc['version']} isn't known")
    tables = []
    for t in doc["tables"]:
        _only("table", t, {"id": int, "name": str, "columns": list})
        columns = []
        for c in t["columns"]:
            _only("column", c, {"id": int, "name": str, "physical_type": str, "semantic_type": (str, type(None)), "nullable": bool, "primary_key": bool})
            if c["physical_type"] not in {p.value.lower() for p in Physical}:
                raise SchemaError(f"column {c['name']}: physical type {c['physical_type']} isn't known")
            columns.append(ColumnDef(c["id"], c["name"], ValueType(Physical[c["physical_type"].upper()], c["semantic_type"]), c["nullable"], c["primary_key"]))
        tables.append(TableDef(t["id"], t["name"], columns))
    return Schema(tables)


def dump_schema(schema: Schema) -> str:
    """The document that :func:`load_schema` reads."""
    column = lambda c: {"id": c.id, "name": c.name, "physical_type": c.type.physical.value.lower(), "semantic_type": c.type.name, "nullable": c.nullable, "primary_key": c.primary_key}
    return json.dumps({"version": 1, "tables": [{"id": t.id, "name": t.name, "columns": [column(c) for c in t.columns]} for t in schema.tables]}, indent=2)
