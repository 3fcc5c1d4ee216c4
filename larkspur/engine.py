"""The engine: statements over declared tables, changes in transactions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import AggregateOverflow, CompileError, EngineError, ExpectedQuery, SchemaError, TransactionError
from larkspur.functions.aggregates import OVERFLOW
from larkspur.plans import logical as L
from larkspur.plans import lower
from larkspur.plans.bind import bind
from larkspur.schema import Schema, TableDef
from larkspur.sources.external import ExternalTable
from larkspur.sources.managed import ManagedTable
from larkspur.sql.parser import parse
from larkspur.types import Physical, ValueType

#: What results depend on: checked arithmetic, exact names, one time zone.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}


class State(Enum):
    ACTIVE = "active"
    ROLLBACK_REQUIRED = "rollback_required"
    COMMIT_PENDING = "commit_pending"
    ROLLBACK_PENDING = "rollback_pending"
    COMMITTED = "committed"
    ROLLED_BACK = "rolled_back"


class Transaction:
    """Changes to one table that become permanent together."""

    _numbers = itertools.count(1)

    def __init__(self, engine: Engine, table: ManagedTable):
        self.number = next(self._numbers)
        self.engine, self.table, self.state = engine, table, State.ACTIVE

    def _need(self, *states: State) -> None:
        if self.state not in states:
            raise TransactionError(f"the transaction is {self.state.value}")

    def commit(self) -> None:
        self._need(State.ACTIVE)
        self.state = State.COMMIT_PENDING
        try:
            if self.engine._writer(self.table) is self:
                self.table.commit()
        except Exception:
            self._end(State.ROLLED_BACK)
            raise
        self._end(State.COMMITTED)

    def rollback(self) -> None:
        self._need(State.ACTIVE, State.ROLLBACK_REQUIRED)
        self.state = State.ROLLBACK_PENDING
        if self.engine._writer(self.table) is self:
            self.table.rollback()
        self._end(State.ROLLED_BACK)

    def _end(self, state: State) -> None:
        self.state = state
        self.engine._release(self)


@dataclass(frozen=True)
class ResultColumn:
    name: str
    type: ValueType
    nullable: bool
    #: Where a column comes from as it is; None for aggregates.
    source: L.ColumnRef | None


@dataclass(frozen=True)
class Rows:
    """A query's result: lazy rows and their declared columns."""

    columns: tuple[ResultColumn, ...]
    frame: DataFrame

    def collect(self) -> list[tuple]:
        """All rows, unsigned numbers as int."""
        with translated():
            return [self.python(r) for r in self.frame.collect()]

    def python(self, row: Sequence[Any]) -> tuple:
        return tuple(int(v) if v is not None and c.type.physical is Physical.UINT64 else v for c, v in zip(self.columns, row, strict=True))


@dataclass(frozen=True)
class Affected:
    rows: int


class translated:
    """Spark's overflow errors as this engine's."""

    def __enter__(self) -> None:
        return None

    def __exit__(self, kind: object, error: BaseException | None, trace: object) -> None:
        if isinstance(error, PySparkException):
            said = str(error)
            if OVERFLOW in said:
                raise AggregateOverflow(said.split(OVERFLOW, 1)[1].split("\n", 1)[0].split(" SQLSTATE", 1)[0]) from error
            if "ARITHMETIC_OVERFLOW" in said:
                raise AggregateOverflow("SUM") from error


_SESSIONS: dict[tuple[str, int], SparkSession] = {}


def _session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its SQL settings and those of SETTINGS; one for all engines of a session."""
    key = spark.sparkContext.applicationId, spark._jsparkSession.hashCode()
    if spark in _SESSIONS.values():
        return spark
    if key not in _SESSIONS:
        _SESSIONS[key] = spark.newSession()
    own = _SESSIONS[key]
    mine = own.conf.getAll
    for k, v in (spark.conf.getAll | SETTINGS).items():
        if mine.get(k) != v and k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


class Engine:
    """Tables by name.  Managed tables can be changed, external ones only read.

    Statements run in a session of the engine's own beside the given one; a
    frame to bind is best made by ``engine.spark``, as it is planned under the
    settings of the session that made it.
    """

    def __init__(self, spark: SparkSession):
        #: A session of the engine's own: its settings aren't the caller's.
        self.spark = _session(spark)
        self.tables: dict[int, ManagedTable | ExternalTable] = {}
        self.schema = Schema()
        self._transactions: list[Transaction] = []
        self._writers: dict[int, Transaction] = {}
        self.closed = False

    # Tables

    def _add(self, tables: Sequence[ManagedTable | ExternalTable]) -> None:
        self.schema = Schema([*self.schema.tables, *(t.table for t in tables)])
        self.tables |= {t.table.id: t for t in tables}

    def bind_parquet(self, table: TableDef, path: str, verify: bool = False) -> None:
        """``verify`` reads the files once to see that they hold what the definition says; see :class:`ExternalTable`."""
        self._add([ExternalTable(table, self.spark.read.parquet(path), verify)])

    def bind_frame(self, table: TableDef, frame: DataFrame, verify: bool = False) -> None:
        self._add([ExternalTable(table, frame, verify)])

    def create(self, tables: Sequence[tuple[TableDef, str]]) -> None:
        """Create all tables or none; a failure removes only what this call made."""
        self._distinct(tables)
        made: list[ManagedTable] = []
        try:
            for table, path in tables:
                made.append(ManagedTable.create(self.spark, table, path))
            self._add(made)
        except Exception:
            for t in made:
                t.store.delete()
            raise

    def open(self, tables: Sequence[tuple[TableDef, str]]) -> None:
        self._distinct(tables)
        self._add([ManagedTable.open(self.spark, table, path) for table, path in tables])

    def _distinct(self, tables: Sequence[tuple[TableDef, str]]) -> None:
        paths = [p.rstrip("/") for _, p in tables]
        if len(set(paths)) < len(paths):
            raise SchemaError("two tables with one path")
        Schema([*self.schema.tables, *(t for t, _ in tables)])

    def _managed(self, table_id: int) -> ManagedTable:
        found = self.tables.get(table_id)
        if found is None:
            raise SchemaError(f"there is no table {table_id}")
        if not isinstance(found, ManagedTable):
            raise EngineError(f"{found.table.name} is read-only")
        return found

    def _read(self, table_id: int) -> DataFrame:
        return self.tables[table_id].frame()

    def _located(self, table_id: int) -> tuple[DataFrame, str] | None:
        table = self.tables[table_id]
        return table.located() if isinstance(table, ManagedTable) and table.table.columns else None

    def locators(self, table_id: int) -> DataFrame:
        """All rows of a managed table with their locators: ``part``, ``file`` and ``row`` after the declared columns."""
        table = self._managed(table_id)
        self._fresh(table_id)
        rows, at = table.located()
        return rows.orderBy(at).select(*[F.col(f"`{c.name}`") for c in table.table.columns], f"{at}.part", f"{at}.file", f"{at}.row")

    def read_row(self, table_id: int, part: str, file: str, row: int) -> tuple | None:
        """The row at a locator, or None once it was changed or removed with its part."""
        table = self._managed(table_id)
        self._fresh(table_id)
        found = table.read_row(part, file, row).collect()
        types = [c.type.physical for c in table.table.columns]
        return tuple(int(v) if v is not None and t is Physical.UINT64 else v for t, v in zip(types, found[0], strict=True)) if found else None

    def _fresh(self, table_id: int) -> None:
        """Go on from what other engines have committed, unless a transaction here writes the table."""
        table = self.tables[table_id]
        if isinstance(table, ManagedTable) and table_id not in self._writers:
            table.refresh()

    # Compilation

    def compile(self, sql: str) -> L.Statement:
        if self.closed:
            raise EngineError("the engine is closed")
        return bind(self.schema, parse(sql))

    def diagnose(self, sql: str) -> CompileError | None:
        """The first error of a statement; nothing is planned or run."""
        try:
            self.compile(sql)
        except CompileError as e:
            return e
        return None

    def access(self, sql: str) -> tuple[list[int], list[int]]:
        """Tables read and tables written, by id."""
        s = self.compile(sql)
        return L.read_tables(s), L.write_tables(s)

    # Queries

    def query(self, sql: str) -> Rows:
        s = self.compile(sql)
        if not isinstance(s, L.Query):
            raise ExpectedQuery("this statement changes data")
        return self._rows(s)

    def _rows(self, q: L.Query) -> Rows:
        for table_id in L.read_tables(q):
            self._fresh(table_id)
        columns = tuple(ResultColumn(f.name, f.type, f.nullable, f if isinstance(f, L.ColumnRef) else None) for f in q.fields)
        return Rows(columns, lower.query(q, self._read, self._located))

    def execute(self, sql: str) -> Rows | Affected:
        """A query's rows, or the number of rows changed by a statement that is committed with it."""
        s = self.compile(sql)
        if isinstance(s, L.Query):
            return self._rows(s)
        t = self.begin(s.table_id)
        try:
            done = self._change(t, s)
        except BaseException:
            if t.state is State.ACTIVE:
                t.rollback()
            raise
        t.commit()
        return done

    # Changes

    def begin(self, table_id: int) -> Transaction:
        t = Transaction(self, self._managed(table_id))
        self._transactions.append(t)
        return t

    def execute_in(self, t: Transaction, sql: str) -> Rows | Affected:
        """As :meth:`execute`, as a part of a transaction; a failing change rolls all of it back."""
        self._own(t)
        t._need(State.ACTIVE)
        s = self.compile(sql)
        if isinstance(s, L.Query):
            return self._rows(s)
        if s.table_id != t.table.table.id:
            raise TransactionError(f"the transaction is bound to {t.table.table.name}")
        try:
            return self._change(t, s)
        except BaseException:
            if t.state is State.ACTIVE:
                t.rollback()
            raise

    def insert(self, table_id: int, rows: Sequence[Sequence[Any]]) -> int:
        """Append rows of Python values, all or none."""
        t = self.begin(table_id)
        try:
            n = self.insert_in(t, rows)
        except BaseException:
            if t.state is State.ACTIVE:
                t.rollback()
            raise
        t.commit()
        return n

    def insert_in(self, t: Transaction, rows: Sequence[Sequence[Any]]) -> int:
        self._own(t)
        t._need(State.ACTIVE)
        try:
            made = t.table.rows(rows)
            self._claim(t)
            t.table.append(made)
        except BaseException:
            t.rollback()
            raise
        return len(rows)

    def _own(self, t: Transaction) -> None:
        if t.engine is not self:
            raise TransactionError("the transaction belongs to another engine")

    def _writer(self, table: ManagedTable) -> Transaction | None:
        return self._writers.get(table.table.id)

    def _claim(self, t: Transaction) -> None:
        """The first change makes a transaction its table's only writer here; a change by another engine since then makes its commit fail."""
        self._fresh(t.table.table.id)
        holder = self._writers.setdefault(t.table.table.id, t)
        if holder is not t:
            raise TransactionError(f"{t.table.table.name} is being written by another transaction")

    def _release(self, t: Transaction) -> None:
        if t in self._transactions:
            self._transactions.remove(t)
        if self._writers.get(t.table.table.id) is t:
            del self._writers[t.table.table.id]

    def _change(self, t: Transaction, s: L.Insert | L.Update | L.Delete) -> Affected:
        self._claim(t)
        table = t.table
        with translated():
            if isinstance(s, L.Insert):
                one = self.spark.range(1).select([lower.expression(v).cast(c.type.physical.spark).alias(c.name, metadata=c.field().metadata) for v, c in zip(s.values, table.table.columns, strict=True)])
                table.append(one)
                return Affected(1)
            hit = lower.expression(s.predicate) if s.predicate else F.lit(True)
            found = table.hits(lambda rows: lower.scan(s.scan, lambda _: rows).where(hit))
            if found:
                new = {c.internal: F.col(c.internal) for c in s.scan.columns}
                if isinstance(s, L.Update):
                    # Every value is computed from the row as it was.
                    new |= {c.internal: F.when(hit, lower.expression(v)).otherwise(F.col(c.internal)) for c, v in s.assignments}

                def changed(rows: DataFrame) -> DataFrame:
                    rows = lower.scan(s.scan, lambda _: rows)
                    if isinstance(s, L.Delete):
                        rows = rows.where(~F.coalesce(hit, F.lit(False)))
                    return rows.select([new[c.internal].alias(c.name) for c in s.scan.columns])

                table.rewrite(list(found), changed)
            return Affected(sum(found.values()))

    # Upkeep

    def create_index(self, table_id: int, column: str) -> None:
        self._unwritten(table_id).create_index(column)

    def analyze(self, table_id: int) -> None:
        """Count the committed rows; refused while a transaction writes the table."""
        self._unwritten(table_id).analyze()

    def _unwritten(self, table_id: int) -> ManagedTable:
        table = self._managed(table_id)
        if table_id in self._writers:
            raise TransactionError(f"{table.table.name} is being written by a transaction")
        table.refresh()
        return table

    def flush(self) -> None:
        """Commits are durable at once; nothing is left to do."""

    def checkpoint(self) -> None:
        """Remove superseded parts of all tables."""
        self._idle()
        for t in self.tables.values():
            if isinstance(t, ManagedTable):
                t.checkpoint()

    def close(self) -> None:
        self._idle()
        self.closed = True

    def _idle(self) -> None:
        if self._transactions:
            raise TransactionError("a transaction is open")
